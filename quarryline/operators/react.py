"""Entities of JavaScript and TypeScript by their syntax: imports, components, API calls and routes."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator

from quarryline.functions import ecma

HTTP_VERBS = frozenset(("get", "post", "put", "patch", "delete", "head", "options"))
_HOOK = re.compile(r"(?:React\.)?(use[A-Z]\w*)$")
_NAME = re.compile(r"[\w$]+$")
_TYPED = re.compile(r"\s*:\s*[\w.]*(?:FC|VFC|FunctionComponent)\s*<\s*([\w.]+)")
_FIRST_PARAMETER = re.compile(r"[^(=]*\(\s*(?:\{[^}]*\}|[\w$]+)\s*\??:\s*([\w.$]+)")
_WRAPPED = re.compile(r"(?:React\.)?(?:memo|forwardRef|observer)\s*(?:<[^>]*>)?\(")
_STRING = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"", re.S)
_PATHLIKE = re.compile(r"[`'\"]?(?:/|\./|\.\./|https?://)")
_ATTRIBUTE = re.compile(r"\s*([A-Za-z_][\w$:.-]*)\s*(=\s*)?")
_EXPORTED = re.compile(r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:const\s+|let\s+|var\s+)?$")


class Recorder(ecma.Parser):
    """A parser that notes where calls, elements, values, functions, classes and imports stand."""

    def __init__(self, src: str, ts: bool, jsx: bool):
        self.notes: list[tuple] = []
        super().__init__(src, ts, jsx)

    def save(self):
        return super().save(), len(self.notes)

    def load(self, state):
        super().load(state[0])
        del self.notes[state[1] :]

    def arguments(self):
        begin, parts = self.s, []
        self.need("(")
        while not self.eat(")"):
            self.eat("...")
            at = self.s
            self.assign()
            parts.append((at, self.e))
            if self.cover >= 0:
                self.fail("initialiser")
            if not self.at(")"):
                self.need(",")
        self.notes.append(("call", begin, self.e, tuple(parts)))

    def jsx_element(self):
        begin = self.s
        super().jsx_element()
        self.notes.append(("element", begin, self.pos))

    def on_value(self, kind, name, where, begin):
        if name:
            self.notes.append(("value", where, self.e, name, begin))

    def function(self, declared, named=True):
        begin = self.s
        super().function(declared, named)
        self.notes.append(("function", begin, self.e))

    def class_(self, named):
        begin = self.s
        super().class_(named)
        self.notes.append(("class", begin, self.e))

    def import_(self):
        begin = self.s
        super().import_()
        self.notes.append(("import", begin, self.e))


def callee(src: str, end: int) -> str:
    """The dotted name that ends before a call's parenthesis, type arguments left out; "" for any other callee."""
    i = end
    while i and src[i - 1].isspace():
        i -= 1
    if i and src[i - 1] == ">":
        depth = 0
        while i:
            i -= 1
            depth += (src[i] == ">") - (src[i] == "<")
            if not depth:
                break
    parts = []
    while True:
        m = _NAME.search(src, max(0, i - 200), i)
        if not m:
            break
        parts.append(m.group())
        i = m.start()
        while i and src[i - 1].isspace():
            i -= 1
        if i and src[i - 1] == ".":
            i -= 1 if src[i - 2 : i - 1] != "?" else 2
            while i and src[i - 1].isspace():
                i -= 1
        else:
            break
    return ".".join(reversed(parts))


def _plus(text: str) -> list[str]:
    """The operands of a sum, by the pluses outside of strings and brackets."""
    out, depth, at, i = [], 0, 0, 0
    while i < len(text):
        c = text[i]
        if c in "'\"`":
            j = i + 1
            while j < len(text) and text[j] != c:
                j += 2 if text[j] == "\\" else 1
            i = j
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "+" and not depth:
            out.append(text[at:i])
            at = i + 1
        i += 1
    return [x.strip() for x in [*out, text[at:]]]


def string_value(text: str, known: dict[str, str]) -> str | None:
    """The string an expression stands for: a literal, a template (as it is written), a known name, or a sum of them.

    Of a sum, operands that aren't known (hosts, variables) count as nothing.
    """
    text = text.strip()
    while text.startswith("(") and text.endswith(")"):
        text = text[1:-1].strip()
    if _STRING.fullmatch(text):
        return text[1:-1]
    if text.startswith("`") and text.endswith("`") and "`" not in text[1:-1]:
        return text
    if re.fullmatch(r"[\w$]+", text):
        return known.get(text)
    parts = _plus(text)
    if len(parts) < 2:
        return None
    values = [string_value(x, known) for x in parts]
    joined = "".join(re.sub(r"\$\{[^}]*\}", "{param}", v.strip("`")) for v in values if v)
    return joined or None


def api_url(text: str, known: dict[str, str]) -> str | None:
    """The URL of an argument, if it is a path or an address."""
    value = string_value(text, known)
    if not value or "/" not in value or value.strip() == "/" or not _PATHLIKE.match(value.strip()):
        return None
    return value


def _properties(text: str) -> dict[str, str]:
    """The plain properties of an object literal, by text."""
    if not text.lstrip().startswith("{"):
        return {}
    inner, out, depth, at, i = text.strip()[1:-1], {}, 0, 0, 0
    pieces = []
    while i <= len(inner):
        c = inner[i : i + 1]
        if c and c in "'\"`":
            j = i + 1
            while j < len(inner) and inner[j] != c:
                j += 2 if inner[j] == "\\" else 1
            i = j
        elif c and c in "([{":
            depth += 1
        elif c and c in ")]}":
            depth -= 1
        elif not c or c == "," and not depth:
            pieces.append(inner[at:i])
            at = i + 1
        i += 1
    for piece in pieces:
        key, colon, value = piece.partition(":")
        if colon:
            out[key.strip().strip("'\"")] = value.strip()
        elif re.fullmatch(r"\s*[\w$]+\s*", piece):
            out[piece.strip()] = piece.strip()
    return out


def api_call(name: str, arguments: list[str], known: dict[str, str]) -> tuple[str, str, str] | None:
    """(method, url, service) of a call of fetch, axios or a service's verb; None for any other call."""
    if not arguments:
        return None
    owner, _, last = name.rpartition(".")
    if name in ("fetch", "window.fetch"):
        url = api_url(arguments[0], known)
        method = string_value(_properties(arguments[1]).get("method", ""), known) if len(arguments) > 1 else None
        return ((method or "GET").strip("`").upper() or "GET", url, "fetch") if url else None
    if name == "axios" and arguments[0].lstrip().startswith("{"):
        options = _properties(arguments[0])
        url = api_url(options.get("url", ""), known)
        return ((string_value(options.get("method", ""), known) or "GET").upper(), url, "axios") if url else None
    if owner and last in HTTP_VERBS:
        url = api_url(arguments[0], known)
        return (last.upper(), url, owner.rpartition(".")[2]) if url else None
    return None


def attributes(src: str, begin: int, end: int) -> tuple[str, dict[str, str]]:
    """Name and attributes of the element that opens at ``begin``."""
    m = re.compile(r"<\s*([\w$.:-]*)").match(src, begin, end)
    name, at, out = m.group(1), m.end(), {}
    while at < end:
        while at < end and src[at].isspace():
            at += 1
        if src[at : at + 1] in (">", "/", ""):
            break
        if src[at] == "{":
            at = _closing(src, at, end)
            continue
        m = _ATTRIBUTE.match(src, at, end)
        if not m or m.end() == at:
            break
        at = m.end()
        if not m.group(2):
            out[m.group(1)] = ""
            continue
        stop = _closing(src, at, end) if src[at] == "{" else src.find(src[at], at + 1, end) + 1 if src[at] in "'\"" else at
        out[m.group(1)] = src[at:stop]
        if stop <= at:
            break
        at = stop
    return name, out


def _closing(src: str, at: int, end: int) -> int:
    """The place behind the brace that closes the one at ``at``."""
    depth = 0
    while at < end:
        c = src[at]
        if c in "'\"`":
            stop = at + 1
            while stop < end and src[stop] != c:
                stop += 2 if src[stop] == "\\" else 1
            at = stop
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    return end


def syntax_notes(path: str, text: str) -> list[tuple] | None:
    """The notes of a file that is valid as JSX or, by its extension or otherwise, as TypeScript; None if it isn't."""
    ext = path.rpartition(".")[2].lower()
    kinds = {"ts": [(True, False)], "tsx": [(True, True)]}.get(ext, [(False, True), (True, False)])
    for ts, jsx in kinds:
        p, error = ecma.read(text, ts, jsx, make=Recorder)
        if error is None:
            return sorted(set(p.notes), key=lambda n: (n[1], -n[2]))
    return None


def react_rows(path: str, text: str, row) -> Iterator[dict] | None:
    """Rows of a file by its syntax; ``row(kind, name, **more)`` makes one.  None if the file isn't valid."""
    notes = syntax_notes(path, text)
    return None if notes is None else _rows(text, notes, row)


def _rows(text: str, notes: list[tuple], row) -> Iterator[dict]:
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda o: bisect_right(starts, o)
    known: dict[str, str] = {}
    for n in notes:
        if n[0] == "import":
            m = re.search(r"(['\"])([^'\"]+)\1", text[n[1] : n[2]])
            if m:
                yield row("Import", m.group(2), start_line=line(n[1]))
        elif n[0] == "value":
            value = string_value(text[n[4] : n[2]], known)
            if value is not None:
                known.setdefault(n[3], value.strip("`"))
    elements = [(a, b, *attributes(text, a, b)) for kind, a, b, *_ in notes if kind == "element"]
    calls = [(a, callee(text, a), [text[i:j] for i, j in parts]) for kind, a, _, *rest in notes if kind == "call" for parts in rest]
    components = []
    for n in notes:
        name, begin = None, n[1]
        if n[0] == "function":
            m = re.compile(r"function\s*\*?\s*([A-Z][\w$]*)").match(text, n[1])
            name = m.group(1) if m else None
        elif n[0] == "class":
            m = re.compile(r"class\s+([A-Z][\w$]*)[^{]*\bextends\s+(?:React\.)?(?:Pure)?Component\b").match(text, n[1])
            name = m.group(1) if m else None
        elif n[0] == "value" and n[3][:1].isupper():
            head = text[n[4] : n[2]]
            if re.match(r"(?:async\s*)?(?:\(|function\b|[\w$]+\s*=>)", head) or _WRAPPED.match(head):
                name = n[3]
        if name and any(n[1] <= a and b <= n[2] for a, b, *_ in elements):
            components.append((name, begin, n[2]))
    for name, begin, end in components:
        inside = [(a, c, args) for a, c, args in calls if begin <= a < end]
        hooks = list(dict.fromkeys(m.group(1) for _, c, _ in inside if (m := _HOOK.fullmatch(c))))
        made = [(a, x) for a, c, args in inside if (x := api_call(c, args, known))]
        api = [{"method": m, "url": u, "service": s, "line": line(a)} for a, (m, u, s) in made]
        own = [x for a, b, _, x in elements if begin <= a and b <= end]
        handlers = list(dict.fromkeys(k for x in own for k in x if re.match(r"on[A-Z]", k)))
        functions = list(dict.fromkeys(v.strip("{} ") for x in own for k, v in x.items() if re.match(r"on[A-Z]", k) and re.fullmatch(r"\{\s*[\w$.]+\s*\}", v)))
        head = text[begin:end]
        typed = _TYPED.match(text, begin + len(name)) or _FIRST_PARAMETER.match(head)
        before = text[max(0, begin - 60) : begin]
        exported = bool(_EXPORTED.search(before)) or bool(re.search(rf"\bexport\s+(?:default\s+{name}\b|\{{[^}}]*\b{name}\b)", text))
        extra = {"props_type": typed.group(1) if typed else "", "hooks": hooks, "handlers": handlers, "handler_functions": functions, "api_calls": api, "exported": exported}
        yield row("Component", name, start_line=line(begin), end_line=line(end - 1), calls=[f"{c['method']} {c['url']}" for c in api], extra=json.dumps(extra, sort_keys=True))
    for a, _, name, x in elements:
        if name == "Route" and "path" in x:
            path = string_value(x["path"].strip("{} "), known)
            shown = re.search(r"<\s*([\w$.]+)", x.get("element", "")) or re.search(r"\{\s*([\w$.]+)", x.get("component", ""))
            if path is not None:
                yield row("Route", path.strip("`"), parent=shown.group(1) if shown else None, start_line=line(a), extra=None)
