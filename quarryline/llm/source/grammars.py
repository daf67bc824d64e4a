"""All supported grammars, and the token-based ranking of the languages a text may be in."""

from __future__ import annotations

import ast
import json
import re
import sys
import warnings

from quarryline.functions import ecma

#: Grammar by extension.
GRAMMARS = {"py": "python", "js": "javascript", "jsx": "jsx", "ts": "typescript", "tsx": "tsx", "json": "json"}
_WORD = re.compile(r"[A-Za-z_]\w*|=>|===|</|/>|[:;{}]$|^\s*[#\"@]|//|\"\s*:", re.M)
#: Tokens that speak for a grammar, with their weights; tokens of the ecma family count for all of it.
_MARKS = {
    "python": dict.fromkeys("def elif self None True False pass lambda except raise with as not and or is nonlocal".split(), 2.0) | {":": 1.0, "import": 0.5, "class": 0.5},
    "ecma": dict.fromkeys("const let var function => === export default new typeof null undefined this catch switch case break".split(), 2.0) | {";": 0.5, "{": 0.5, "}": 0.5, "//": 0.5},
    "typescript": dict.fromkeys("interface type readonly enum namespace declare implements private public any unknown string number".split(), 1.0),
    "jsx": {"</": 2.0, "/>": 2.0, "useState": 2.0, "className": 2.0, "React": 1.0},
}


def extension(path: str | None) -> str:
    name = (path or "").rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name else ""


def rank_languages(text: str) -> list[str]:
    """The grammars, likeliest first, by the marks among the text's tokens."""
    score = dict.fromkeys(_MARKS, 0.0)
    quotes = 0
    for token in _WORD.findall(text):
        token = token.strip()
        if token.startswith('"'):
            quotes += 1
        for name, marks in _MARKS.items():
            score[name] += marks.get(token, 0.0)
    base, ts, jsx = score["ecma"], score["typescript"], score["jsx"]
    total = {"python": score["python"], "javascript": base, "jsx": base + jsx - 1, "typescript": base + ts - 1, "tsx": base + ts + jsx - 2, "json": 4.0 * quotes if text.lstrip()[:1] in ("{", "[") else 0.0}
    if jsx:
        total["javascript"] = total["typescript"] = base - jsx
    return sorted(total, key=lambda g: -total[g])


def _no_constant(_):
    raise ValueError("constant")


def parse_python(text: str) -> ast.Module | None:
    return read_python(text)[0]


def read_python(text: str) -> tuple[ast.Module | None, bool, int | None]:
    """(tree or None, whether it failed because the text ends while something is still open, the line of the error)."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        digits = sys.get_int_max_str_digits()
        sys.set_int_max_str_digits(0)  # a long number is a number
        try:
            return ast.parse(text), False, None
        except SyntaxError as e:
            said, end = e.msg or "", text.rstrip()
            at_end = (e.lineno or 0) > end.count("\n") or e.lineno == end.count("\n") + 1 and (e.offset or 0) > len(end.rpartition("\n")[2])
            return None, "never closed" in said or "unterminated triple" in said or "unterminated string" in said and e.lineno == end.count("\n") + 1 or at_end, e.lineno
        except (ValueError, RecursionError, MemoryError):
            return None, False, None
        finally:
            sys.set_int_max_str_digits(digits)


_JSON = re.compile(r'[ \t\n\r]*(?:([\[{\]},:])|("(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))')


def read_json(text: str) -> tuple[bool, bool]:
    """(valid, whether a value is still open at the end): a scan with an explicit stack, so that depth doesn't matter."""
    stack: list[str] = []
    want, at, end = "value", 0, len(text.rstrip(" \t\n\r"))
    while want != "end":
        m = _JSON.match(text, at)
        if m is None:
            rest = text[at:end].lstrip(" \t\n\r")
            return False, not rest or rest.startswith('"') and "\n" not in rest and not re.match(r'"(?:[^"\\]|\\.)*"', rest)
        mark, string, scalar = m.groups()
        at = m.end()
        if want in ("value", "first_value") and (string or scalar):
            pass
        elif want in ("value", "first_value") and mark in ("[", "{"):
            stack.append(mark)
            want = "first_value" if mark == "[" else "first_key"
            continue
        elif mark in ("]", "}") and stack and stack[-1] == ("[" if mark == "]" else "{") and want in ("comma", "first_value" if mark == "]" else "first_key"):
            stack.pop()
        elif want in ("key", "first_key") and string:
            want = "colon"
            continue
        elif want == "colon" and mark == ":":
            want = "value"
            continue
        elif want == "comma" and mark == ",":
            want = "value" if stack[-1] == "[" else "key"
            continue
        else:
            return False, False
        want = "comma" if stack else "end"
    return at >= end, False


def accepts(grammar: str, text: str) -> bool:
    """Whether the text is valid in the grammar."""
    return attempt(grammar, text)[0]


def attempt(grammar: str, text: str) -> tuple[bool, bool]:
    """(valid, whether the parser failed because the text ends while something is open)."""
    if grammar == "python":
        tree, unfinished, _ = read_python(text)
        return tree is not None, unfinished
    if grammar == "json":
        try:
            json.loads(text, parse_constant=_no_constant, parse_int=len)
            return True, False
        except (ValueError, RecursionError):
            return read_json(text)
    parser, error = ecma.read(text, grammar in ("typescript", "tsx"), grammar in ("jsx", "tsx"))
    if error is None:
        return True, False
    rest = text[error.args[1] if len(error.args) > 1 else 0 :].rstrip()
    if not rest or parser is not None and parser.t == ecma.END or rest.startswith("/*"):
        return False, True
    # A string or template that is never closed: no token begins there, and none of its kind ends after it.
    return False, rest[0] in "\"'" and "\n" not in rest and not re.match(r"(['\"])(?:\\.|(?!\1).)*\1", rest) or rest.count("`") % 2 == 1


_CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7}|={7})(?: |\r?$)", re.M)
#: Grammars that are one and the same for a text without a ``<``.
_TWINS = {"jsx": "javascript", "tsx": "typescript"}


def accepted(text: str, order: list[str] | None = None) -> dict[str, tuple[bool, bool]]:
    """What ``attempt`` says of every supported grammar, in ranked order.

    Without a ``<`` there is no JSX and no angle-bracket cast, so that one parse speaks for both grammars of a family.
    """
    out: dict[str, tuple[bool, bool]] = {}
    plain = "<" not in text
    for grammar in order or rank_languages(text):
        base = _TWINS.get(grammar, grammar) if plain else grammar
        known = next((g for g in out if plain and _TWINS.get(g, g) == base), None)
        out[grammar] = out[known] if known else attempt(base, text)
    return out


def judge(path: str | None, text: str | None) -> tuple[str | None, bool, str | None, str | None]:
    """(declared grammar, valid, likeliest grammar the text is valid in, cause of a failure).

    Every supported grammar is tried, in ranked order.  The declared one decides validity; where it fails, a success of
    another tells a wrong extension and failure of all a corrupted file.
    cause: ``wrong_extension``, ``merge_conflict``, ``truncated`` (the declared or likeliest grammar's parser has
    something open at the end) or ``corrupt``.
    """
    declared = GRAMMARS.get(extension(path))
    if declared is None or text is None:
        return declared, True, None, None
    order = rank_languages(text)
    results = accepted(text, order)
    if results[declared][0]:
        return declared, True, declared, None
    foreign = next((g for g in order if results[g][0]), None)
    if foreign is not None:
        return declared, False, foreign, "wrong_extension"
    if _CONFLICT.search(text):
        return declared, False, None, "merge_conflict"
    return declared, False, None, "truncated" if results[declared][1] or results[order[0]][1] else "corrupt"
