"""Functions paired with their documentation.

Method: the functions, comments and docstrings of a file are found by its grammar.  A docstring is a candidate for the
function it stands in, a comment for the one it stands directly before on its line, else for the functions that begin,
decorators included, within ``NEAR`` lines below it; texts that say nothing are no candidates.  A link is scored by its
distance, by the parameter tags that name the function's parameters or others, and by its name; code between the two
speaks against it.  A bipartite assignment of greatest score gives each function at most one text and each text at most
one function.  Links that score under ``PLAUSIBLE`` are rejected.

``documented_functions`` returns every pair with the kind of its text, its distance and its score; ``strict`` ones are
those of a docstring, or in the other languages of a comment that ends on the line above, assigned among themselves.

Defined cases
-------------
* Rows with a source extension count, files that don't parse are left out, cut-out functions and methods are read as
  such; of one that was cut off, what stands before the cut is read.  A null or empty content gives no pair.  Repeated
  rows of an entity_id give one pair each function; rows of one entity_id with other contents give the pairs of each.
* Not described: blank texts, placeholders, the name alone, tags alone, tool directives alone.
* Ties of the assignment go to the earlier function.  Very long texts are read whole; empty tables give none.
* Line numbers count from 1 and lines end at a line feed (a carriage return alone ends a line of Python, uncounted).  Other columns aren't read.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.handwritten import SOURCE
from quarryline.functions import ecma
from quarryline.llm.source.grammars import extension, parse_python, read_python
from quarryline.session import spread

#: Lines between the end of a comment and a function up to which they are candidates for each other.
NEAR = 3
#: Score of a link by its distance (0: a docstring), and the least score of a plausible one.
BY_DISTANCE, PLAUSIBLE = (2.0, 1.0, 0.45, 0.3), 0.6

_PLACEHOLDER = re.compile(
    r"(?:to-?do|fixme|xxx|tbd|wip|hack|n/?a|none|null|undocumented|no (?:docs?|description|documentation|comment)|docs?(?:tring)?|documentation|description|desc|comment|summary|placeholder|write (?:me|docs?|documentation)|add (?:docs?|description|documentation|docstring)s?(?: here)?"
    r"|missing (?:docs?|description|documentation|docstring)|(?:function|method|class|module) (?:docstring|description|documentation|comment|docs?)|description (?:here|goes here|missing|needed)|fill (?:me )?in|lorem ipsum.*|see above|same as above|self[- ]explanatory|_+|x+|\?+)",
    re.I,
)
_TODO = re.compile(r"(?:@?(?:to-?do|fixme|xxx|tbd|hack)\b)[\s:(\[-]*[^.\n]{0,40}$", re.I)
_DIRECTIVE = re.compile(
    r"(?:eslint|tslint|jshint|jslint|prettier|istanbul|stylelint|webpack\w*|flow(?:fixme|ignore)?|c8|v8|biome|deno|sonar|nosonar|cspell|codecov|spell-?checker)\b[\w-]*[: -]?.*"
    r"|@(?:ts-|flow|jsx|eslint|format|prettier|generated|internal|ignore|deprecated\b\s*$|inheritdoc|override|noinspection|preserve|vite-).*|\$Flow.*"
    r"|(?:noqa|type: ?ignore|pylint|flake8|mypy|pragma|fmt|isort|ruff|pyright|yapf|nosec|black|coverage|noinspection|pyre|pytype|bandit|region|endregion|#?region)\b[:\s]?.*|-\*-.*-\*-|!.*|<[\w/ =.\"]*/?>|global\b.*|exported\b.*|#__PURE__",
    re.I,
)
_TAG_LINE = re.compile(r"\s*(?:[@\\](?!code\b|link\b)\w+|:(?:param|type|return|returns|rtype|raises|raise|arg|argument|keyword|key|var|ivar|cvar|meta|yields?|yield)\b[^:]*:)")
_SECTION = re.compile(r"\s*(?:args|arguments|parameters|params|returns?|raises?|yields?|throws|keyword args|other parameters|attributes|examples?|notes?|see also|references|warnings?|параметры|аргументы|возвращает|parámetros|devuelve|parameter|rückgabe)\s*:?\s*$", re.I)
_UNDERLINE = re.compile(r"\s*[-=~]{3,}\s*$")


def prose(text: str) -> str:
    """The descriptive part of a documentation text: without tags, sections of parameters, directives and frames."""
    out = []
    skipping = False
    for line in text.split("\n"):
        bare = line.strip()
        if _TAG_LINE.match(line) or _SECTION.match(line) and bare:
            skipping = True
            continue
        if skipping and bare and not line[:1].isspace() and out and not out[-1]:
            skipping = False
        if not bare:
            if not skipping:
                out.append("")
            continue
        if skipping or _UNDERLINE.match(line) or _DIRECTIVE.fullmatch(bare) or re.fullmatch(r"[<>=|]{7}.*", bare):
            continue
        out.append(bare)
    return "\n".join(out).strip()


_PART = re.compile(r"[A-Z]+(?![a-zа-я])|[A-Z]?[a-zа-яё]+|\d+|[^\W\d_]+")


def _words(text: str) -> list[str]:
    return [w.lower() for w in _PART.findall(text)]


def described(text: str, name: str) -> bool:
    """Whether a documentation text says something about the function."""
    body = prose(text)
    plain = body.strip(" \t\r\n.:;,!-*#/_=~\"'`()[]{}<>")
    if not any(c.isalpha() for c in plain):
        return False
    if _PLACEHOLDER.fullmatch(plain) or _TODO.match(plain) or _DIRECTIVE.fullmatch(plain):
        return False
    words, own = _words(plain), "".join(_words(name))
    if "".join(words) == own:
        return False
    while words and words[-1] in ("function", "method", "func", "fn", "def", "component", "helper", "функция", "метод", "methode", "funktion", "función", "método"):
        words.pop()
    while words and words[0] in ("the", "a", "an", "function", "method", "this", "метод", "функция"):
        words.pop(0)
    return bool(words) and "".join(words) != own


def clean_comment(raw: str) -> str:
    """The text of comments, without their marks."""
    lines = []
    for block in re.finditer(r"/\*+([\s\S]*?)\*+/|//+([^\n]*)|/\*+([\s\S]*)", raw):
        if block.group(2) is not None:
            lines.append(block.group(2))
        else:
            inner = block.group(1) if block.group(1) is not None else block.group(3)
            lines += [re.sub(r"^[ \t]*\*+ ?", "", x).rstrip("\r") for x in inner.split("\n")]
    return "\n".join(x.strip("\r") if x[:1] != " " else x[1:].strip("\r") for x in lines)


def best_assignment(weights: dict[tuple[int, int], float]) -> dict[int, int]:
    """{left: right} of a bipartite assignment of greatest total weight (augmenting paths over positive weights)."""
    left = sorted({a for a, _ in weights})
    right = sorted({b for _, b in weights})
    n, m = len(left), len(right) + len(left)  # one dummy each: left alone
    big = 1e6
    cost = [[big] * m for _ in range(n)]
    place = {b: j for j, b in enumerate(right)}
    for i, a in enumerate(left):
        cost[i][len(right) + i] = 0.0
        for b in right:
            if (a, b) in weights:
                cost[i][place[b]] = -weights[a, b]
    # The Hungarian method with potentials.
    u, v, match, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    cur = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < least[j]:
                        least[j], way[j] = cur, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return {left[match[j] - 1]: right[j - 1] for j in range(1, len(right) + 1) if match[j] and cost[match[j] - 1][j - 1] < 0}


_TAG = re.compile(r"@param\s+(?:\{[^}]*\}\s*)?\[?(\w+)|:param(?:eter)?\s+(?:[^:\s]+\s+)?(\w+)\s*:")


def score(function: tuple[str, int, str], text: str, distance: int, code_between: bool) -> float:
    """How likely a text documents a function (name, line, parameters)."""
    name, _, parameters = function
    out = BY_DISTANCE[distance] - (1.0 if code_between else 0.0)
    tags = {a or b for a, b in _TAG.findall(text)} if "param" in text else None
    if tags:
        own = set(re.findall(r"\w+", parameters))
        out += min(0.5, 0.25 * len(tags & own)) - min(0.3, 0.15 * len(tags - own))
    return out + (0.2 if name in text and name in re.findall(r"[\w$]+", text) else 0.0)


def link_texts(functions: list[tuple[str, int, str, int]], texts: list[tuple[int, int, str]], lines: list[str], inside: dict[int, int] | None = None, says=described, alone: frozenset[int] | set[int] = frozenset(), above: bool = False) -> list[tuple[int, int, int, float]]:
    """(function, text, distance, score) of the plausible links.

    functions: name, line, parameters, line where it begins; texts: first line, last line, text; inside: {text: the
    function it stands in or directly before}; alone: texts that have their lines for themselves.  Only texts that say
    something about a function (``says``) compete for it; ``above``: only those that end on the line above its name.
    """
    weights: dict[tuple[int, int], float] = {}
    distances: dict[tuple[int, int], int] = {}
    inside = inside or {}
    by_line: dict[int, list[tuple[int, int]]] = {}
    by_end = {texts[c][1]: c for c in alone}
    for f, (name, line, _, begin) in enumerate(functions):
        by_line.setdefault(line, []).append((f, line))
        if above:
            continue
        # Decorators belong to the function, and comments that say nothing about it don't part it from one that does.
        while begin - 1 in by_end and not says(texts[by_end[begin - 1]][2], name):
            begin = texts[by_end[begin - 1]][0]
        if begin < line:
            by_line.setdefault(begin, []).append((f, begin))
    for c, (_, last, text) in enumerate(texts):
        if c in inside:
            near = {inside[c]: (0, last)}
        else:
            near = {f: (top - last, top) for top in range(last + (1 if above else NEAR), last, -1) for f, top in by_line.get(top, ())}
        for f, (distance, top) in near.items():
            if not says(text, functions[f][0]):
                continue
            between = any(x.strip() and not x.lstrip().startswith(("@", "#", "//")) for x in lines[last : top - 1]) if distance > 1 else False
            weights[f, c] = score(functions[f][:3], text, distance, between) - 1e-6 * f / (1 + len(functions))
            distances[f, c] = distance
    plausible = {k: w for k, w in weights.items() if w >= PLAUSIBLE - 1e-3}
    # Each connected part is assigned by itself.
    parts: dict[tuple[str, int], tuple[str, int]] = {}

    def root(x):
        while parts.setdefault(x, x) != x:
            parts[x] = x = parts[parts[x]]
        return x

    for f, c in plausible:
        parts[root(("f", f))] = root(("c", c))
    groups: dict[tuple[str, int], dict[tuple[int, int], float]] = {}
    for (f, c), w in plausible.items():
        groups.setdefault(root(("f", f)), {})[f, c] = w
    out = []
    for group in groups.values():
        chosen = [next(iter(group))] if len(group) == 1 else best_assignment(group).items()
        out += [(f, c, distances[f, c], round(plausible[f, c], 3)) for f, c in chosen]
    return out


#: name, line, description, kind of text, distance, score
Pair = tuple[str, int, str, str, int, float]


def _longest(text: str) -> tuple[ast.Module | None, int, str]:
    """The tree of the longest part of a cut-out text that can be read from its start, the lines set before it, and the part."""
    best: tuple[int, ast.Module | None, int, str] = (-1, None, 0, "")
    for head in ("if 1:\n", "class _:\n", "") if text[:1] in " \t" else ("", "if 1:\n", "class _:\n"):
        lines = text.split("\n")
        whole = len(lines)
        while lines:
            body = "\n".join(lines)
            tree, _, at = read_python(head + body)
            if tree is not None:
                if tree.body and len(lines) > best[0]:
                    best = len(lines), tree, 1 if head else 0, body
                break
            # What stands before the error may be whole: drop the rest.
            del lines[max(0, min(len(lines) - 1, (at or len(lines) + 1) - (1 if head else 0) - 1)) :]
        if best[0] == whole:
            break
    return best[1], best[2], best[3]


_BODIES = ("body", "orelse", "finalbody", "handlers", "cases")


def _functions(tree: ast.Module):
    """The functions of a tree, in its order; they stand in statements only."""
    stack = list(reversed(tree.body))
    while stack:
        node = stack.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield node
        for field in _BODIES:
            inner = getattr(node, field, None)
            if inner and isinstance(inner, list):
                stack += reversed(inner)


_CARRIAGE_RETURN = re.compile(r"\r(?!\n)")
_LINE = re.compile(r"\r\n|\r|\n")


def python_pairs(text: str, whole: bool, strict: bool = False) -> list[Pair]:
    """The described functions of a Python text; ``whole``: the text is a file, not a part of one."""
    if "\r" in text and _CARRIAGE_RETURN.search(text):
        # Python ends a line at a carriage return alone, too: read with its lines, counted by line feeds.
        feeds = [1]
        for m in _LINE.finditer(text):
            feeds.append(feeds[-1] + (m.group() != "\r"))
        return [(name, feeds[line - 1], *rest) for name, line, *rest in python_pairs(_LINE.sub("\n", text), whole, strict)]
    tree, shift, body = (parse_python(text), 0, text) if whole else _longest(text)
    if tree is None:
        return []
    lines = body.split("\n")
    functions, texts, inside = [], [], {}
    for node in _functions(tree):
        line, last = node.lineno - shift, node.body[0].lineno - shift
        while line < last and line <= len(lines) and node.name not in lines[line - 1]:
            line += 1
        a = node.args
        known = " ".join(x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))))
        doc = ast.get_docstring(node, clean=True)
        if doc is not None:
            inside[len(texts)] = len(functions)
            texts.append((last, node.body[0].end_lineno - shift, doc))
        functions.append((node.name, line, known, min(line, *(x.lineno - shift for x in (node, *node.decorator_list)))))
    if not functions:
        return []
    if strict:
        return [(*functions[f][:2], texts[c][2], "docstring", distance, w) for f, c, distance, w in link_texts(functions, texts, lines, inside)]
    # Comments of their own lines that end within NEAR lines above a function or its first decorator.
    blocks: dict[int, int] = {}
    for end in sorted({end for _, line, _, top in functions for x in {line, top} for end in range(x - 1, max(0, x - 1 - NEAR), -1)}, reverse=True):
        if not lines[end - 1].lstrip().startswith("#") or end < len(lines) and lines[end].lstrip().startswith("#"):
            continue
        begin = end
        while begin > 1 and lines[begin - 2].lstrip().startswith("#"):
            begin -= 1
        blocks[end] = begin
    if blocks and ('"""' in body or "'''" in body):
        blocked = {n for x in ast.walk(tree) if isinstance(x, ast.Constant) and isinstance(x.value, (str, bytes)) and x.end_lineno > x.lineno for n in range(x.lineno - shift, x.end_lineno - shift + 1)}
        blocks = {end: begin for end, begin in blocks.items() if end not in blocked}
    texts += [(begin, end, "\n".join(x.lstrip().lstrip("#").strip() for x in lines[begin - 1 : end])) for end, begin in sorted(blocks.items())]
    links = link_texts(functions, texts, lines, inside, alone=set(range(len(texts))) - set(inside))
    return [(*functions[f][:2], texts[c][2], "docstring" if c in inside else "comment", distance, w) for f, c, distance, w in links]


_BRACKET = re.compile(r"[()]|=>|[;{]")


def _parameters(text: str, at: int, stop: int) -> str:
    """The text from a function's name to the end of its parameters."""
    depth = 0
    for m in _BRACKET.finditer(text, at, stop):
        if m.group() == "(":
            depth += 1
        elif m.group() == ")":
            depth -= 1
            if depth <= 0:
                return text[at : m.end()]
        elif not depth and m.group() != ";":
            return text[at : m.start()]
    return text[at:stop]


_HEAD = re.compile(r"(?:[ \t]|\*|[a-z]+\b)*")


def ecma_pairs(text: str, ts: bool, jsx: bool, whole: bool, strict: bool = False) -> list[Pair]:
    """The described functions of a JavaScript or TypeScript text; a part may be the inside of a class or of an object."""
    parser = None
    best: ecma.Parser | None = None
    for inside in ("",) if whole else ("", "class", "object"):
        p, error = ecma.read(text, ts, jsx, inside)
        if error is None:
            if parser is None or p.functions:
                parser = p
            if p.functions:
                break
        elif p is not None and (best is None or p.s > best.s):
            best = p
    if parser is None:
        if whole or best is None:
            return []
        parser = best  # a part that was cut off: what was found up to there
    if not parser.functions or not parser.comments:
        return []
    starts = [0]
    at = text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    line_of = lambda o: bisect_right(starts, o)
    comments, ends = [], []
    for a, b in sorted(set(parser.comments)):
        # A stretch of blanks and comments: a block comment stands by itself, adjacent line comments are one.
        last = None
        for m in re.finditer(r"//[^\n]*|/\*[\s\S]*?\*/", text[a:b]):
            s, e = a + m.start(), a + m.end()
            own = not text[starts[line_of(s) - 1] : s].strip()
            line, end = line_of(s), line_of(e - 1)
            if m.group().startswith("//"):
                if last and last[3] and own and line == last[1] + 1:
                    last[1] = end
                    last[2] += "\n" + m.group()
                    continue
                last = [line, end, m.group(), own]
            else:
                last = [line, end, m.group(), False]
            if own or m.group().startswith("/*"):
                comments.append(last)
                ends.append((e, own))
    found = sorted(set(parser.functions), key=lambda x: x[1])
    stops = [o for _, o in found[1:]] + [len(text)]
    functions = [(n, line_of(o), _parameters(text, o, stop), line_of(parser.begins.get(o, o))) for (n, o), stop in zip(found, stops)]
    texts = [(a, b, clean_comment(t)) for a, b, t, _ in comments]
    lines = text.split("\n")
    # A comment with nothing but the declaration's words between it and the name stands directly before the function.
    before: dict[int, int] = {}
    at = [o for _, o in found]
    for c, (e, _) in enumerate(() if strict else ends):
        f = bisect_right(at, e)
        if f < len(found) and functions[f][1] == texts[c][1] and _HEAD.fullmatch(text, e, at[f]):
            before[c] = f
    alone = {c for c, (e, own) in enumerate(ends) if own and not text[e : starts[texts[c][1]] if texts[c][1] < len(starts) else len(text)].strip()}
    links = link_texts(functions, texts, lines, before, alone=alone, above=strict)
    return [(*functions[f][:2], texts[c][2], "comment", distance, w) for f, c, distance, w in links]


def pairs(path: str | None, text: str | None, whole: bool, strict: bool = False) -> list[Pair]:
    """The functions of a source text that have a description; ``strict``: by its docstring or the comment on the line above."""
    ext = extension(path)
    if not text or ext not in SOURCE:
        return []
    if ext == "py":
        return python_pairs(text, whole, strict)
    return ecma_pairs(text, ext in ("ts", "tsx"), ext in ("jsx", "tsx"), whole, strict)


_PAIR = "entity_id string, line_no bigint, function string, description string, kind string, distance int, score double"


def documented_functions(results: DataFrame, strict: bool = False) -> DataFrame:
    """(entity_id, line_no, function, description, kind, distance, score) of each described function of each row.

    ``strict`` reads docstrings in Python, and elsewhere comments that end on the line above; no other text competes.
    """
    rows = results.where(F.lower("file_path").rlike(r"\.(" + "|".join(sorted(SOURCE)) + r")$") & F.col("content").isNotNull()).select("entity_id", "entity_type", "file_path", "content")

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            kinds, paths = b.column(1).to_pylist(), b.column(2).to_pylist()
            for i, kind, path, text in zip(b.column(0).to_pylist(), kinds, paths, b.column(3)):
                for name, line, doc, sort, distance, w in pairs(path, text.as_py(), kind == "File", strict):
                    for column, x in zip(out, (i, line, name, doc, sort, distance, w)):
                        column.append(x)
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["entity_id", "line_no", "function", "description", "kind", "distance", "score"])

    return spread(rows).mapInArrow(run, _PAIR).distinct()
