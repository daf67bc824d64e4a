"""Lexing of any source file, canonical re-emission, and measures of how its layout differs from the canonical one."""

from __future__ import annotations

import re

#: Comments, strings, numbers, names, brackets and operators of Python and the ecma family.
_PYTHON = re.compile(
    r"(?P<c>#[^\n]*)|(?P<s>[rbfuRBFU]{0,2}(?:\"\"\"(?:[^\\\"]++|\\[\s\S]|\"(?!\"\"))*+(?:\"\"\"|\Z)|'''(?:[^\\']++|\\[\s\S]|'(?!''))*+(?:'''|\Z)|\"(?:[^\"\\\n]++|\\[\s\S])*+\"?|'(?:[^'\\\n]++|\\[\s\S])*+'?))"
    r"|(?P<d>\.?\d[\w.]*)|(?P<n>\w+)|(?P<l>\n)|(?P<w>[^\S\n]+)|(?P<p>[^\w\s])"
)
_ECMA = re.compile(
    r"(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|<!--[\s\S]*?-->)|(?P<s>\"(?:[^\"\\\n]++|\\[\s\S])*+\"?|'(?:[^'\\\n]++|\\[\s\S])*+'?|`(?:[^`\\]++|\\[\s\S])*+`?)"
    r"|(?P<d>\.?\d[\w.]*)|(?P<n>[\w$]+)|(?P<l>\n)|(?P<w>[^\S\n]+)|(?P<p>[^\w\s])"
)
_KEYWORDS = frozenset(
    "def class return if else elif for while import from as const let var function export default new await async type interface enum try catch except finally raise throw with in of not and or is switch case break continue pass lambda yield None null true false True False this self extends implements static".split()
)


#: Canonical lines of a window whose distinct shapes are counted.
WINDOW = 100


class Layout:
    """Measures of one file.

    header     text of the comments and the docstring before the first statement
    expansion  lines of the canonical form (a break after each ``{ } ;`` or line end) per line of code as it stands
    longest    characters of the longest line
    line       mean characters of a line of code
    literal    share of characters of code that stand in strings, numbers and the commas between them
    shapes     distinct shapes of canonical lines (names, strings and numbers replaced by their kind) per line, by windows
    lines      canonical lines
    """

    __slots__ = ("code_chars", "comment_chars", "expansion", "header", "line", "lines", "literal", "longest", "longest_literal", "shapes")

    def __init__(self, text: str, python: bool):
        lexer = _PYTHON if python else _ECMA
        header, in_header = [], True
        shape: list[str] = []
        shapes: list[str] = []
        literal = code = comment = breaks = 0
        self.longest_literal = 0
        depth = 0
        lines_with_code = 0
        fresh = True
        for m in lexer.finditer(text):
            kind = m.lastgroup
            if kind == "w":
                continue
            if kind == "l":
                if shape and not depth:
                    shapes.append(" ".join(shape))
                    shape = []
                fresh = True
                continue
            v = m.group()
            if kind == "c":
                comment += len(v)
                if in_header:
                    header.append(v)
                continue
            if in_header:
                if kind == "s" and not shape and (python and v.lstrip("rbfuRBFU")[:3] in ('"""', "'''") or v[1:-1] == "use strict"):
                    header.append(v)
                    comment += len(v)
                    continue
                if not (kind == "p" and v == ";"):
                    in_header = False
            if fresh:
                lines_with_code += 1
                fresh = False
            code += len(v)
            if kind == "s":
                literal += len(v)
                self.longest_literal = max(self.longest_literal, len(v))
                shape.append("S")
            elif kind == "d":
                literal += len(v)
                shape.append("0")
            elif kind == "n":
                shape.append(v if v in _KEYWORDS else "N")
            else:
                if v in "([":
                    depth += 1
                elif v in ")]":
                    depth = max(0, depth - 1)
                elif v == ",":
                    literal += 1 if shape and shape[-1] in ("S", "0") else 0
                shape.append(v)
                if v in "{};" and not (python and v != ";"):
                    breaks += 1
                    if not depth:
                        shapes.append(" ".join(shape))
                        shape = []
        if shape:
            shapes.append(" ".join(shape))
        rows = text.split("\n")
        self.header = "\n".join(header)
        self.lines = len(shapes)
        self.expansion = max(self.lines, breaks) / max(1, lines_with_code)
        self.longest = max(map(len, rows))
        self.line = code / max(1, lines_with_code)
        self.literal = literal / max(1, code)
        # Long files repeat shapes by chance: the share is taken of windows of as many lines, and averaged.
        cuts = [shapes[i : i + WINDOW] for i in range(0, max(1, self.lines), WINDOW)]
        if len(cuts) > 1 and len(cuts[-1]) < WINDOW // 2:
            cuts.pop()
        self.shapes = sum(len(set(c)) / max(1, len(c)) for c in cuts) / len(cuts)
        self.code_chars, self.comment_chars = code, comment
