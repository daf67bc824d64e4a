"""A parser of JavaScript modules, TypeScript and JSX: it decides validity and reports functions and comments.

Recursive descent over an on-demand lexer, so that regular expressions, templates, JSX and type arguments are told
apart by the grammar.  Nothing is built but the list of named functions.
"""

from __future__ import annotations

import re
import sys

_WS = re.compile(r"(?:[\s﻿]+|//[^\n\r  ]*|/\*[\s\S]*?\*/)+")
_TOKEN = re.compile(
    r"((?:[^\W\d]|\$|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))(?:[\w$‌‍]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))*)"  # 1 name
    r"|(0[xX][\da-fA-F][\da-fA-F_]*n?|0[oO][0-7][0-7_]*n?|0[bB][01][01_]*n?|(?:(?:0|[1-9][\d_]*)(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)"  # 2 number
    r'|("(?:[^"\\\n\r]++|\\(?:\r\n|[\s\S]))*+"|\'(?:[^\'\\\n\r]++|\\(?:\r\n|[\s\S]))*+\')'  # 3 string
    r"|(>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@`])"  # 4
    r"|(\#(?:[^\W\d]|\$)[\w$]*)"  # 5 private name
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*+\])++/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]++|\\[\s\S]|\$(?!\{))*+(`|\$\{)")
_JSX_NAME = re.compile(r"[^\W\d][\w$-]*(?:(?:\.[\w$-]+)+|:[\w$-]+)?")
_JSX_TEXT = re.compile(r"[^{}<>]*")
_JSX_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")
_AFTER_NUMBER = re.compile(r"[\w$]")

NAME, NUMBER, STRING, PUNCT, PRIVATE, END = 1, 2, 3, 4, 5, 6

RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
#: Reserved in strict code only, as modules are.
STRICT = frozenset("implements interface let package private protected public static yield await".split())
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8,
    "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
_UNARY_WORDS = frozenset(("typeof", "void", "delete", "await"))
_MODIFIERS = frozenset("public private protected readonly static abstract override declare async accessor".split())


class Invalid(Exception):
    """The text is not valid; args: message, offset."""


class Parser:
    def __init__(self, src: str, ts: bool = False, jsx: bool = False):
        self.src, self.ts, self.jsx = src, ts, jsx
        self.pos, self.functions, self.comments = 0, [], []
        self.depth_fn = self.depth_loop = self.depth_break = self.nest = self.ambient = 0
        self.cover = -1
        self.begins: dict[int, int] = {}  # where a decorated method begins, by the place of its name
        self.not_arrow: set[int] = set()
        if src.startswith("#!"):
            self.pos = (src.find("\n") + 1) or len(src)
        self.e = 0
        self.next()

    # -- lexer -------------------------------------------------------------------------------------------------
    def fail(self, why: str = "unexpected"):
        raise Invalid(why, self.s)

    def next(self):
        src, pos = self.src, self.pos
        self.e = pos
        self.nl = False
        m = _WS.match(src, pos)
        if m:
            end = m.end()
            gap = m.group()
            if "\n" in gap or "\r" in gap:
                self.nl = True
            if "/" in gap:
                self.comments.append((pos, end))
            pos = end
        self.s = pos
        m = _TOKEN.match(src, pos)
        if m is None:
            if pos >= len(src):
                self.t, self.v = END, ""
                return
            self.fail("character")
        self.t = kind = m.lastindex
        self.v = m.group()
        self.pos = end = m.end()
        if kind == NUMBER and _AFTER_NUMBER.match(src, end):
            self.fail("number")
        elif kind == PUNCT and self.v == "/" and src.startswith("/*", pos):
            self.fail("comment")

    def save(self):
        return self.pos, self.t, self.v, self.s, self.e, self.nl, len(self.functions), self.cover, len(self.comments)

    def load(self, state):
        self.pos, self.t, self.v, self.s, self.e, self.nl, n, self.cover, c = state
        del self.functions[n:], self.comments[c:]

    def at(self, v: str) -> bool:
        return self.v == v and self.t == PUNCT

    def word(self, v: str) -> bool:
        return self.v == v and self.t == NAME

    def eat(self, v: str) -> bool:
        if self.v == v and self.t == PUNCT:
            self.next()
            return True
        return False

    def eat_word(self, v: str) -> bool:
        if self.v == v and self.t == NAME:
            self.next()
            return True
        return False

    def need(self, v: str):
        if self.v != v or self.t != PUNCT:
            self.fail(f"expected {v}")
        self.next()

    def need_word(self, v: str):
        if self.v != v or self.t != NAME:
            self.fail(f"expected {v}")
        self.next()

    def close_angle(self):
        """A '>' that may be the first character of a longer operator."""
        if self.t != PUNCT or self.v[:1] != ">":
            self.fail("expected >")
        self.pos = self.s + 1
        self.next()

    def peek(self):
        state = self.save()
        self.next()
        out = self.t, self.v, self.nl
        self.load(state)
        return out

    def semicolon(self):
        if self.t == PUNCT:
            if self.v == ";":
                self.next()
                return
            if self.v == "}":
                return
        if self.t == END or self.nl:
            return
        self.fail("expected ;")

    # -- statements --------------------------------------------------------------------------------------------
    def program(self):
        while self.t != END:
            self.statement(True)

    def block(self):
        self.need("{")
        while not self.at("}"):
            if self.t == END:
                self.fail("end of file")
            self.statement()
        self.next()

    def statement(self, top: bool = False):
        self.nest += 1
        try:
            self.statement_(top)
        finally:
            self.nest -= 1
        if self.cover >= 0:
            self.fail("initialiser in an object")

    def body(self):
        self.statement()

    def statement_(self, top):
        v = self.v
        if self.t == PUNCT:
            if v == "{":
                return self.block()
            if v == ";":
                return self.next()
            if v == "@":
                self.decorators()
                if self.word("export"):
                    return self.export()
                if self.ts and self.word("abstract"):
                    self.next()
                return self.class_(True)
            self.expression()
            return self.semicolon()
        if self.t == NAME:
            f = _STATEMENTS.get(v)
            if f is not None:
                if f is _declare_like:
                    if self.ts and self.ts_declaration():
                        return None
                elif v == "let":
                    t, w, _ = self.peek()
                    if t == NAME and w not in ("in", "instanceof") or t == PUNCT and w in "[{":
                        return f(self)
                elif v == "async":
                    t, w, nl = self.peek()
                    if t == NAME and w == "function" and not nl:
                        self.next()
                        return self.function(True)
                elif v == "import":
                    t, w, _ = self.peek()
                    if not (t == PUNCT and w in ("(", ".")):
                        if not top:
                            self.fail("import inside")
                        return self.import_()
                elif v == "export":
                    if not top and not self.ts:
                        self.fail("export inside")
                    return self.export()
                elif v == "const" and self.ts and self.peek()[:2] == (NAME, "enum"):
                    self.next()
                    return self.enum()
                else:
                    return f(self)
            if v not in RESERVED:
                t, w, _ = self.peek()
                if t == PUNCT and w == ":":
                    self.next()
                    self.next()
                    return self.statement()
        self.expression()
        return self.semicolon()

    def variables(self, in_for: bool = False):
        kind = self.v
        self.next()
        while True:
            name, where = self.v if self.t == NAME else None, self.s
            simple = self.t == NAME
            self.binding()
            if self.ts:
                if self.at("!"):
                    self.next()
                if self.eat(":"):
                    self.type()
            if self.at("="):
                self.next()
                begin = self.s
                value = self.assign(in_for)
                if value in ("function", "arrow") and name:
                    self.functions.append((name, where))
                self.on_value(kind, name, where, begin)
            elif in_for and (self.word("of") or self.word("in")):
                return
            elif not in_for and not self.ambient and (kind == "const" or not simple):
                self.fail("missing initialiser")
            if not self.eat(","):
                break
        if not in_for:
            self.semicolon()

    def on_value(self, kind: str, name: str | None, where: int, begin: int):
        """Called behind the value, begun at ``begin``, of a declared name."""

    def if_(self):
        self.next()
        self.need("(")
        self.expression()
        self.need(")")
        self.body()
        if self.eat_word("else"):
            self.body()

    def loop_body(self):
        self.depth_loop += 1
        self.depth_break += 1
        self.body()
        self.depth_loop -= 1
        self.depth_break -= 1

    def for_(self):
        self.next()
        self.eat_word("await")
        self.need("(")
        if self.at(";"):
            pass
        elif self.t == NAME and (self.v in ("var", "const") or self.v == "let" and self.peek()[0] in (NAME, PUNCT) and self.peek()[1] not in ("of", "in", "=", ";", ".")):
            self.variables(True)
        else:
            self.expression(True)
            if self.word("of") or self.word("in"):
                self.cover = -1
        if self.eat_word("of"):
            self.assign()
        elif self.eat_word("in"):
            self.expression()
        else:
            self.need(";")
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.expression()
        self.need(")")
        self.loop_body()

    def while_(self):
        self.next()
        self.need("(")
        self.expression()
        self.need(")")
        self.loop_body()

    def do(self):
        self.next()
        self.loop_body()
        self.need_word("while")
        self.need("(")
        self.expression()
        self.need(")")
        self.eat(";")

    def return_(self):
        if not self.depth_fn:
            self.fail("return outside")
        self.next()
        if not (self.at(";") or self.at("}") or self.t == END or self.nl):
            self.expression()
        self.semicolon()

    def throw(self):
        self.next()
        if self.nl:
            self.fail("line after throw")
        self.expression()
        self.semicolon()

    def jump(self):
        word = self.v
        self.next()
        if self.t == NAME and not self.nl and self.v not in RESERVED:
            self.next()
        elif not (self.depth_loop if word == "continue" else self.depth_break):
            self.fail("jump outside")
        self.semicolon()

    def switch(self):
        self.next()
        self.need("(")
        self.expression()
        self.need(")")
        self.need("{")
        self.depth_break += 1
        while not self.eat("}"):
            if self.eat_word("case"):
                self.expression()
            else:
                self.need_word("default")
            self.need(":")
            while not (self.at("}") or self.word("case") or self.word("default")):
                if self.t == END:
                    self.fail("end of file")
                self.statement()
        self.depth_break -= 1

    def try_(self):
        self.next()
        self.block()
        some = False
        if self.eat_word("catch"):
            some = True
            if self.eat("("):
                self.binding()
                if self.ts and self.eat(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.eat_word("finally"):
            some = True
            self.block()
        if not some:
            self.fail("try alone")

    def debugger(self):
        self.next()
        self.semicolon()

    def with_(self):
        self.fail("with")

    def function_statement(self):
        self.function(True)

    def class_statement(self):
        self.class_(True)

    def expression_statement(self):
        self.expression()
        self.semicolon()

    def let(self):
        self.variables()

    # -- modules -----------------------------------------------------------------------------------------------
    def module_name(self):
        if self.t != STRING:
            self.fail("module")
        self.next()
        if self.t == NAME and self.v in ("with", "assert") and not self.nl:
            self.next()
            self.object_()
        self.semicolon()

    def specifiers(self):
        self.need("{")
        while not self.eat("}"):
            if self.ts and self.word("type"):
                t, w, _ = self.peek()
                if t in (NAME, STRING) and w != "as":
                    self.next()
            if self.t not in (NAME, STRING):
                self.fail("specifier")
            self.next()
            if self.eat_word("as"):
                if self.t not in (NAME, STRING):
                    self.fail("specifier")
                self.next()
            if not self.at("}"):
                self.need(",")

    def import_(self):
        self.next()
        if self.t == STRING:
            return self.module_name()
        if self.ts and self.word("type"):
            t, w, _ = self.peek()
            if t == NAME and w != "from" or t == PUNCT and w in "{*":
                self.next()
        if self.t == NAME:
            self.identifier()
            if self.ts and self.eat("="):
                self.expression()
                return self.semicolon()
            if self.eat(","):
                if not (self.at("{") or self.at("*")):
                    self.fail("import")
        if self.at("*"):
            self.next()
            self.need_word("as")
            self.identifier()
        elif self.at("{"):
            self.specifiers()
        self.need_word("from")
        return self.module_name()

    def export(self):
        self.next()
        if self.eat_word("default"):
            if self.word("function"):
                return self.function(True, False)
            if self.word("async") and self.peek()[:2] == (NAME, "function"):
                self.next()
                return self.function(True, False)
            if self.at("@"):
                self.decorators()
            if self.ts and self.word("abstract") and self.peek()[:2] == (NAME, "class"):
                self.next()
            if self.word("class"):
                return self.class_(False)
            if self.ts and self.word("interface"):
                return self.interface()
            self.assign()
            return self.semicolon()
        if self.eat("*"):
            if self.eat_word("as"):
                if self.t not in (NAME, STRING):
                    self.fail("export")
                self.next()
            self.need_word("from")
            return self.module_name()
        if self.ts:
            if self.word("type"):
                t, w, _ = self.peek()
                if t == PUNCT and w in "{*":
                    self.next()
                    return self.export_list() if self.at("{") else self.export_star()
            if self.at("="):
                self.next()
                self.expression()
                return self.semicolon()
            if self.eat_word("as"):
                self.need_word("namespace")
                self.identifier()
                return self.semicolon()
            if self.word("import"):
                return self.import_()
        if self.at("{"):
            return self.export_list()
        if self.at("@"):
            self.decorators()
        if self.t == NAME and self.v in ("var", "let", "const", "function", "class", "async") or self.ts and self.v in _TS_DECLARATIONS:
            return self.statement_(True)
        return self.fail("export")

    def export_star(self):
        self.next()
        if self.eat_word("as"):
            self.identifier()
        self.need_word("from")
        self.module_name()

    def export_list(self):
        self.specifiers()
        if self.eat_word("from"):
            return self.module_name()
        return self.semicolon()

    # -- functions and classes ---------------------------------------------------------------------------------
    def identifier(self):
        if self.t != NAME or self.v in RESERVED:
            self.fail("identifier")
        if self.v in STRICT and not self.ts and self.v != "await" and self.v != "yield":
            self.fail("identifier")
        self.next()

    def binding(self):
        if self.t == NAME:
            return self.identifier()
        if self.eat("["):
            while not self.eat("]"):
                if self.at(","):
                    self.next()
                    continue
                rest = self.eat("...")
                self.binding()
                if not rest and self.eat("="):
                    self.assign()
                if not self.at("]"):
                    if rest:
                        self.fail("rest")
                    self.need(",")
            return None
        self.need("{")
        while not self.eat("}"):
            if self.eat("..."):
                self.identifier()
                if not self.at("}"):
                    self.fail("rest")
                continue
            plain = self.t == NAME and self.v not in RESERVED
            if self.at("["):
                self.next()
                self.assign()
                self.need("]")
            elif self.t in (NAME, NUMBER, STRING):
                self.next()
            else:
                self.fail("pattern")
            if self.eat(":"):
                self.binding()
            elif not plain:
                self.fail("pattern")
            if self.eat("="):
                self.assign()
            if not self.at("}"):
                self.need(",")
        return None

    def parameters(self):
        self.need("(")
        while not self.eat(")"):
            if self.at("@"):
                self.decorators()
            if self.ts:
                while self.t == NAME and self.v in ("public", "private", "protected", "readonly", "override"):
                    t, w, _ = self.peek()
                    if t == NAME or t == PUNCT and w in "[{":
                        self.next()
                    else:
                        break
            rest = self.eat("...")
            if self.ts and self.word("this"):
                self.next()
            else:
                self.binding()
            if self.ts:
                self.eat("?")
                if self.eat(":"):
                    self.type()
            if self.at("="):
                if rest:
                    self.fail("rest")
                self.next()
                self.assign()
            if not self.at(")"):
                if rest:
                    self.fail("rest")
                self.need(",")

    def function_body(self):
        loop, brk = self.depth_loop, self.depth_break
        self.depth_loop = self.depth_break = 0
        self.depth_fn += 1
        self.block()
        self.depth_fn -= 1
        self.depth_loop, self.depth_break = loop, brk

    def signature(self, declared: bool = False):
        if self.ts and self.at("<"):
            self.type_parameters()
        self.parameters()
        if self.ts and self.eat(":"):
            self.type(True)
        if self.at("{"):
            self.function_body()
        elif declared and self.ts:
            self.semicolon()
        else:
            self.fail("body")

    def function(self, declared: bool, named: bool = True):
        self.next()
        self.eat("*")
        if self.t == NAME and self.v not in RESERVED:
            self.functions.append((self.v, self.s))
            self.identifier()
        elif declared and named:
            self.fail("name")
        self.signature(declared)

    def decorators(self):
        while self.eat("@"):
            if self.eat("("):
                self.expression()
                self.need(")")
            else:
                self.identifier()
                while self.eat("."):
                    self.next()
                while self.at("("):
                    self.arguments()

    def class_(self, named: bool):
        self.need_word("class")
        if self.t == NAME and self.v not in ("extends", "implements"):
            self.identifier()
        elif named:
            self.fail("name")
        if self.ts and self.at("<"):
            self.type_parameters()
        if self.eat_word("extends"):
            self.call_chain(self.primary(), False)
            if self.ts and self.at("<"):
                self.type_arguments()
        if self.ts and self.eat_word("implements"):
            self.type()
            while self.eat(","):
                self.type()
        self.need("{")
        self.class_body()
        self.need("}")

    def class_body(self, stop: int = PUNCT):
        while not (self.at("}") or self.t == END):
            if self.eat(";"):
                continue
            self.member()

    def member(self):
        begin = self.s
        decorated = self.at("@")
        if decorated:
            self.decorators()
        # Modifiers: words that are followed by another name on the way to the member's own.
        while self.t == NAME and (self.v in ("static", "async", "get", "set", "accessor") or self.ts and self.v in _MODIFIERS):
            word = self.v
            t, w, nl = self.peek()
            if word == "static" and t == PUNCT and w == "{":
                self.next()
                return self.function_body()
            if t in (NAME, STRING, NUMBER, PRIVATE) and not (nl and word not in ("static",)) or t == PUNCT and w in ("[", "*") and word not in ("readonly",) or t == PUNCT and w == "[" and word == "readonly":
                self.next()
                continue
            break
        self.eat("*")
        if self.ts and self.at("[") and self.index_signature():
            return None
        name, where = self.property_name()
        if decorated:
            self.begins[where] = begin
        if self.ts:
            self.eat("?")
            if self.at("!"):
                self.next()
        if self.at("(") or self.ts and self.at("<"):
            if name:
                self.functions.append((name, where))
            return self.signature(True)
        if self.ts and self.eat(":"):
            self.type()
        if self.eat("="):
            self.depth_fn += 1
            if self.assign() in ("function", "arrow") and name:
                self.functions.append((name, where))
            self.depth_fn -= 1
        return self.semicolon()

    def property_name(self):
        name, where = self.v, self.s
        if self.t == NAME or self.t == PRIVATE:
            self.next()
            return name, where
        if self.t == STRING or self.t == NUMBER:
            self.next()
            return name.strip("\"'"), where
        if self.eat("["):
            self.assign()
            self.need("]")
            return None, where
        return self.fail("property")

    # -- expressions -------------------------------------------------------------------------------------------
    def expression(self, in_for: bool = False):
        kind = self.assign(in_for)
        while self.at(","):
            self.next()
            kind = self.assign(in_for)
            kind = "sequence"
        return kind

    def assign(self, in_for: bool = False) -> str:
        self.nest += 1
        cover, self.cover = self.cover, -1
        kind = self.binary(0, in_for)
        if self.t == PUNCT:
            v = self.v
            if v == "?":
                self.next()
                self.conditional_rest(in_for)
                kind = "other"
            elif v in _ASSIGN:
                if kind == "pattern":
                    if v != "=":
                        self.fail("target")
                    self.cover = -1
                elif kind != "name" and kind != "member":
                    self.fail("target")
                name, where = (self.target if kind == "member" or kind == "name" else (None, 0))
                self.next()
                if self.assign(in_for) in ("function", "arrow") and name and kind == "member":
                    self.functions.append((name, where))
                kind = "other"
        if self.cover < 0:
            self.cover = cover
        self.nest -= 1
        return kind

    def conditional_rest(self, in_for):
        self.assign()
        self.need(":")
        self.assign(in_for)

    def binary(self, least: int, in_for: bool) -> str:
        kind = self.unary()
        while True:
            v = self.v
            rank = _BINARY.get(v) if self.t == PUNCT or self.t == NAME else None
            if rank is None:
                if self.ts and self.t == NAME and v in ("as", "satisfies") and not self.nl:
                    self.next()
                    if not self.eat_word("const"):
                        self.type()
                    kind = "member" if kind in ("name", "member") else kind if kind == "function" else "other"
                    continue
                return kind
            if rank <= least and not (v == "**" and rank == least) or in_for and v == "in" and self.t == NAME:
                return kind
            if kind == "arrow":
                return kind
            self.next()
            self.binary(rank, in_for)
            kind = "other"

    def unary(self) -> str:
        if self.t == PUNCT:
            v = self.v
            if v in ("!", "-", "+", "~"):
                self.next()
                self.unary()
                return "other"
            if v in ("++", "--"):
                self.next()
                if self.unary() not in ("name", "member"):
                    self.fail("target")
                return "other"
            if v == "<" and self.ts and not self.jsx:
                return self.angle()
        elif self.t == NAME and self.v in _UNARY_WORDS:
            if self.v == "await":
                t, w, _ = self.peek()
                if t == PUNCT and w in (")", ",", ";", "=", "=>", "."):
                    self.fail("await")
            self.next()
            self.unary()
            return "other"
        kind = self.call_chain(self.primary(), True)
        if self.t == PUNCT and self.v in ("++", "--") and not self.nl:
            if kind not in ("name", "member"):
                self.fail("target")
            self.next()
            return "other"
        return kind

    def angle(self) -> str:
        """In TypeScript without JSX: an arrow function with type parameters, or a type assertion."""
        state = self.save()
        try:
            self.type_parameters()
            return self.arrow(False)
        except Invalid:
            self.load(state)
        self.next()
        self.type()
        self.close_angle()
        self.unary()
        return "other"

    def call_chain(self, kind: str, calls: bool) -> str:
        while True:
            if self.t != PUNCT:
                return kind
            v = self.v
            if v == ".":
                if kind == "arrow":
                    return kind
                self.next()
                if self.t != NAME and self.t != PRIVATE:
                    self.fail("member")
                self.target = (self.v, self.s)
                self.next()
                kind = "member"
            elif v == "(":
                if kind == "arrow" or not calls:
                    return kind
                self.arguments()
                kind = "other"
            elif v == "[":
                if kind == "arrow":
                    return kind
                self.next()
                self.expression()
                self.need("]")
                self.target = (None, 0)
                kind = "member"
            elif v == "?.":
                self.next()
                if self.at("("):
                    self.arguments()
                elif self.at("["):
                    self.next()
                    self.expression()
                    self.need("]")
                elif self.t == NAME or self.t == PRIVATE:
                    self.next()
                elif not self.at("`"):
                    self.fail("optional")
                kind = "other"
            elif v == "`":
                if kind == "arrow":
                    return kind
                self.template()
                kind = "other"
            elif v == "!" and self.ts and not self.nl:
                self.next()
            elif (v == "<" or v == "<<") and self.ts and kind in ("name", "member", "other", "function"):
                state = self.save()
                try:
                    self.type_arguments()
                    if not (self.at("(") or self.at("`")) and not (self.t == END or self.nl or self.t == PUNCT and self.v in ");,]}:."):
                        raise Invalid("less", self.s)
                except Invalid:
                    self.load(state)
                    return kind
            else:
                return kind

    def arguments(self):
        self.need("(")
        while not self.eat(")"):
            self.eat("...")
            self.assign()
            if self.cover >= 0:
                self.fail("initialiser")
            if not self.at(")"):
                self.need(",")

    def primary(self) -> str:
        v = self.v
        if self.t == NAME:
            if v == "function":
                self.function(False)
                return "function"
            if v == "async":
                t, w, nl = self.peek()
                if t == NAME and w == "function" and not nl:
                    self.next()
                    self.function(False)
                    return "function"
                if not nl and (t == NAME and w not in RESERVED and w != "of" or t == PUNCT and w in ("(", "<")):
                    state, start = self.save(), self.s
                    self.next()
                    if t == NAME:
                        self.identifier()
                        if self.at("=>"):
                            return self.arrow_body()
                    elif start not in self.not_arrow:
                        try:
                            if self.at("<"):
                                self.type_parameters()
                            return self.arrow(True)
                        except Invalid:
                            self.not_arrow.add(start)
                    self.load(state)
                self.target = (v, self.s)
                self.next()
                return "name"
            if v == "class":
                self.class_(False)
                return "other"
            if v == "new":
                self.next()
                if self.eat("."):
                    self.need_word("target")
                    return "other"
                if self.word("import"):
                    self.fail("import")
                self.call_chain(self.primary(), False)
                if self.ts and self.at("<"):
                    self.type_arguments()
                if self.at("("):
                    self.arguments()
                return "other"
            if v == "import":
                self.next()
                if self.eat("."):
                    self.need_word("meta")
                    return "other"
                self.arguments()
                return "other"
            if v == "super":
                self.next()
                if not (self.at("(") or self.at(".") or self.at("[")):
                    self.fail("super")
                return "other"
            if v == "yield":
                self.next()
                if not self.nl and not (self.t == END or self.t == PUNCT and self.v in (")", "]", "}", ",", ";", ":")):
                    self.eat("*")
                    self.assign()
                return "other"
            if v in RESERVED:
                if v in ("this", "null", "true", "false"):
                    self.next()
                    return "other"
                self.fail("word")
            if v in STRICT and not self.ts:
                self.fail("word")
            self.target = (v, self.s)
            self.next()
            if self.at("=>") and not self.nl:
                return self.arrow_body()
            return "name"
        if self.t == STRING or self.t == NUMBER:
            self.next()
            return "other"
        if self.t == PUNCT:
            if v == "(":
                return self.parenthesis()
            if v == "[":
                self.next()
                while not self.eat("]"):
                    if self.at(","):
                        self.next()
                        continue
                    self.eat("...")
                    self.assign()
                    if not self.at("]"):
                        self.need(",")
                return "pattern"
            if v == "{":
                self.object_()
                return "pattern"
            if v == "`":
                self.template()
                return "other"
            if v == "/" or v == "/=":
                m = _REGEX.match(self.src, self.s)
                if m is None:
                    self.fail("regex")
                flags = m.group().rpartition("/")[2]
                if len(set(flags)) < len(flags) or set(flags) - set("dgimsuvy"):
                    self.fail("flags")
                self.pos = m.end()
                self.next()
                return "other"
            if v == "<" and self.jsx:
                if self.ts:
                    t, w, _ = self.peek()
                    if t == NAME:
                        state = self.save()
                        try:
                            self.type_parameters(True)
                            return self.arrow(False)
                        except Invalid:
                            self.load(state)
                self.jsx_element()
                self.next()
                return "other"
            if v == "@":
                self.decorators()
                self.class_(False)
                return "other"
        if self.t == PRIVATE:
            self.next()
            if not self.word("in"):
                self.fail("private")
            return "other"
        return self.fail()

    def parenthesis(self) -> str:
        start = self.s
        if start not in self.not_arrow:
            t, w, _ = self.peek()
            maybe = t == PUNCT and w in (")", "{", "[", "...") or t == NAME
            if maybe:
                state = self.save()
                try:
                    return self.arrow(False)
                except Invalid:
                    self.not_arrow.add(start)
                    self.load(state)
        self.next()
        kind = self.expression()
        self.need(")")
        return kind if kind in ("name", "member") else "function" if kind in ("function", "arrow") else "other"

    def arrow(self, is_async: bool) -> str:
        """An arrow function; raises Invalid where there is none.  Errors inside its body are final."""
        self.parameters()
        if self.ts and self.eat(":"):
            self.type(True)
        if not self.at("=>") or self.nl:
            raise Invalid("arrow", self.s)
        try:
            return self.arrow_body()
        except Invalid as e:
            raise _Final(*e.args) from None

    def arrow_body(self) -> str:
        self.next()
        if self.at("{"):
            self.function_body()
        else:
            self.depth_fn += 1
            self.assign()
            self.depth_fn -= 1
        return "arrow"

    def object_(self):
        self.need("{")
        while not self.eat("}"):
            if self.eat("..."):
                self.assign()
            else:
                self.object_member()
            if not self.at("}"):
                self.need(",")

    def object_body(self):
        while self.t != END:
            if self.eat("..."):
                self.assign()
            else:
                self.object_member()
            if self.t != END:
                self.need(",")

    def object_member(self):
        while self.t == NAME and self.v in ("async", "get", "set"):
            t, w, _ = self.peek()
            if t in (NAME, STRING, NUMBER) or t == PUNCT and w in ("[", "*"):
                self.next()
                continue
            break
        star = self.eat("*")
        plain = self.t == NAME and self.v not in RESERVED
        name, where = self.property_name()
        if self.at("(") or self.ts and self.at("<"):
            if name:
                self.functions.append((name, where))
            return self.signature()
        if star:
            self.fail("method")
        if self.eat(":"):
            if self.assign() in ("function", "arrow") and name:
                self.functions.append((name, where))
            return None
        if not plain:
            self.fail("property")
        if self.at("="):
            where = self.s
            self.next()
            self.assign()
            self.cover = where
        return None

    def template(self):
        """At a backtick: the whole template with its expressions."""
        src, pos = self.src, self.pos
        while True:
            m = _TEMPLATE.match(src, pos)
            if m is None:
                self.fail("template")
            if m.group(1) == "`":
                self.pos = m.end()
                return self.next()
            self.pos = m.end()
            self.next()
            self.expression()
            if not self.at("}"):
                self.fail("template")
            pos = self.pos

    # -- JSX ---------------------------------------------------------------------------------------------------
    def jsx_space(self, pos: int) -> int:
        m = _WS.match(self.src, pos)
        return m.end() if m else pos

    def jsx_fail(self, pos: int):
        self.s = pos
        self.fail("jsx")

    def jsx_expression(self, pos: int, empty: bool) -> int:
        """After '{': an expression up to '}'; the offset behind it."""
        self.pos = pos
        self.next()
        if self.at("}"):
            if not empty:
                self.fail("jsx")
            return self.pos
        if self.eat("..."):
            self.assign()
        else:
            self.expression()
        if not self.at("}"):
            self.fail("jsx")
        return self.pos

    def jsx_element(self):
        """At '<': the element; self.pos is left behind its end."""
        self.nest += 1
        src = self.src
        pos = self.jsx_space(self.s + 1)
        name = ""
        m = _JSX_NAME.match(src, pos)
        if m:
            name, pos = m.group(), m.end()
            if self.ts and src.startswith("<", pos):
                self.pos = pos
                self.next()
                self.next()
                self.type()
                while self.eat(","):
                    self.type()
                if self.t != PUNCT or self.v[:1] != ">":
                    self.fail("jsx")
                pos = self.s + 1
            while True:
                pos = self.jsx_space(pos)
                c = src[pos : pos + 1]
                if c == "/":
                    pos = self.jsx_space(pos + 1)
                    if not src.startswith(">", pos):
                        self.jsx_fail(pos)
                    self.pos = pos + 1
                    self.nest -= 1
                    return
                if c == ">":
                    pos += 1
                    break
                if c == "{":
                    pos = self.jsx_expression(pos + 1, False)
                    continue
                m = _JSX_NAME.match(src, pos)
                if not m:
                    self.jsx_fail(pos)
                pos = m.end()
                after = self.jsx_space(pos)
                if src.startswith("=", after):
                    pos = self.jsx_space(after + 1)
                    c = src[pos : pos + 1]
                    if c == "{":
                        pos = self.jsx_expression(pos + 1, False)
                    elif c == "<":
                        self.s = pos
                        self.jsx_element()
                        pos = self.pos
                    else:
                        m = _JSX_STRING.match(src, pos)
                        if not m:
                            self.jsx_fail(pos)
                        pos = m.end()
        else:
            if not src.startswith(">", pos):
                self.jsx_fail(pos)
            pos += 1
        while True:
            pos = _JSX_TEXT.match(src, pos).end()
            c = src[pos : pos + 1]
            if c == "{":
                pos = self.jsx_expression(pos + 1, True)
            elif c == "<":
                inner = self.jsx_space(pos + 1)
                if src.startswith("/", inner):
                    inner = self.jsx_space(inner + 1)
                    m = _JSX_NAME.match(src, inner)
                    closing, inner = (m.group(), m.end()) if m else ("", inner)
                    inner = self.jsx_space(inner)
                    if closing != name or not src.startswith(">", inner):
                        self.jsx_fail(inner)
                    self.pos = inner + 1
                    self.nest -= 1
                    return
                self.s = pos
                self.jsx_element()
                pos = self.pos
            else:
                self.jsx_fail(pos)

    # -- TypeScript --------------------------------------------------------------------------------------------
    def ts_declaration(self) -> bool:
        v = self.v
        t, w, nl = self.peek()
        if v == "interface" and t == NAME and not nl:
            self.interface()
        elif v == "type" and t == NAME and not nl:
            self.next()
            self.identifier()
            if self.at("<"):
                self.type_parameters()
            self.need("=")
            self.type()
            self.semicolon()
        elif v == "enum" and t == NAME:
            self.enum()
        elif v in ("namespace", "module") and t in (NAME, STRING) and not nl:
            self.next()
            self.next()
            while self.eat("."):
                self.identifier()
            if self.at("{"):
                self.block()
            else:
                self.semicolon()
        elif v == "global" and t == PUNCT and w == "{":
            self.next()
            self.block()
        elif v == "abstract" and t == NAME and w == "class":
            self.next()
            self.class_(True)
        elif v == "declare" and t == NAME and not nl:
            self.next()
            self.ambient += 1
            self.statement_(True)
            self.ambient -= 1
        else:
            return False
        return True

    def interface(self):
        self.next()
        self.identifier()
        if self.at("<"):
            self.type_parameters()
        if self.eat_word("extends"):
            self.type()
            while self.eat(","):
                self.type()
        self.object_type()

    def enum(self):
        self.need_word("enum")
        self.identifier()
        self.need("{")
        while not self.eat("}"):
            self.property_name()
            if self.eat("="):
                self.assign()
            if not self.at("}"):
                self.need(",")

    def type_parameters(self, strict: bool = False):
        self.need("<")
        comma = False
        while not (self.t == PUNCT and self.v[:1] == ">"):
            while self.t == NAME and self.v in ("in", "out", "const") and self.peek()[0] == NAME:
                self.next()
            self.identifier()
            if self.eat_word("extends"):
                comma = True
                self.type()
            if self.eat("="):
                self.type()
            if not (self.t == PUNCT and self.v[:1] == ">"):
                comma = True
                self.need(",")
        if strict and not comma:
            self.fail("jsx")
        self.close_angle()

    def type_arguments(self):
        if self.t != PUNCT or self.v[:1] != "<":
            self.fail("<")
        self.pos = self.s + 1
        self.next()
        self.type()
        while self.eat(","):
            self.type()
        self.close_angle()

    def type(self, returned: bool = False):
        self.nest += 1
        if returned and self.t == NAME:
            if self.v == "asserts" and self.peek()[0] == NAME and self.peek()[1] not in ("is",):
                self.next()
            t, w, nl = self.peek()
            if t == NAME and w == "is" and not nl:
                self.next()
                self.next()
        self.type_union()
        if self.word("extends") and not self.nl:
            self.next()
            self.type_union()
            self.need("?")
            self.type()
            self.need(":")
            self.type()
        self.nest -= 1

    def type_union(self):
        if self.t == PUNCT and self.v in ("|", "&"):
            self.next()
        self.type_operator()
        while self.t == PUNCT and self.v in ("|", "&"):
            self.next()
            self.type_operator()

    def type_operator(self):
        if self.t == NAME and self.v in ("keyof", "unique", "readonly", "infer"):
            t, w, _ = self.peek()
            if t in (NAME, STRING) or t == PUNCT and w in ("(", "[", "{"):
                word = self.v
                self.next()
                self.type_operator()
                if word == "infer" and self.word("extends"):
                    state = self.save()
                    self.next()
                    self.type_union()
                    if self.at("?"):
                        self.load(state)
                return
        self.type_primary()
        while True:
            if self.at("[") and not self.nl:
                self.next()
                if self.eat("]"):
                    continue
                self.type()
                self.need("]")
            elif self.at("!") and not self.nl:
                self.next()
            else:
                return

    def function_type(self):
        if self.at("<"):
            self.type_parameters()
        self.parameters()
        self.need("=>")
        self.type(True)

    def type_primary(self):
        v = self.v
        if self.t == NAME:
            if v == "new" or v == "abstract" and self.peek()[1] == "new":
                if v == "abstract":
                    self.next()
                self.next()
                return self.function_type()
            if v == "typeof":
                self.next()
                if self.word("import"):
                    return self.type_primary()
                self.next()
                while self.eat("."):
                    self.next()
                if self.at("<") and not self.nl:
                    self.type_arguments()
                return None
            if v == "import":
                self.next()
                self.need("(")
                self.type()
                self.need(")")
            elif v in RESERVED and v not in ("void", "null", "this", "true", "false"):
                self.fail("type")
            else:
                self.next()
            while self.eat("."):
                if self.t != NAME:
                    self.fail("type")
                self.next()
            if self.t == PUNCT and self.v in ("<", "<<") and not self.nl:
                self.type_arguments()
            return None
        if self.t == STRING or self.t == NUMBER:
            return self.next()
        if self.t == PUNCT:
            if v == "{":
                return self.object_type()
            if v == "[":
                self.next()
                while not self.eat("]"):
                    self.eat("...")
                    if self.t == NAME:
                        t, w, _ = self.peek()
                        if t == PUNCT and w in (":", "?"):
                            state = self.save()
                            self.next()
                            self.eat("?")
                            if not self.eat(":"):
                                self.load(state)
                    self.type()
                    self.eat("?")
                    if not self.at("]"):
                        self.need(",")
                return None
            if v == "(":
                state, start = self.save(), self.s
                if start not in self.not_arrow:
                    try:
                        return self.function_type()
                    except Invalid:
                        self.not_arrow.add(start)
                        self.load(state)
                self.next()
                self.type()
                return self.need(")")
            if v == "<":
                return self.function_type()
            if v == "-":
                self.next()
                if self.t != NUMBER:
                    self.fail("type")
                return self.next()
            if v == "`":
                src, pos = self.src, self.pos
                while True:
                    m = _TEMPLATE.match(src, pos)
                    if m is None:
                        self.fail("template")
                    self.pos = m.end()
                    self.next()
                    if m.group(1) == "`":
                        return None
                    self.type()
                    if not self.at("}"):
                        self.fail("template")
                    pos = self.pos
        return self.fail("type")

    def index_signature(self) -> bool:
        state = self.save()
        self.next()
        if self.t == NAME:
            self.next()
            if self.eat(":"):
                self.type()
                self.need("]")
                self.need(":")
                self.type()
                self.member_end()
                return True
        self.load(state)
        return False

    def member_end(self):
        if self.t == PUNCT and self.v in (";", ","):
            self.next()
        elif not (self.at("}") or self.nl):
            self.fail("member")

    def object_type(self):
        self.need("{")
        while not self.eat("}"):
            if self.t == END:
                self.fail("end of file")
            if self.at("(") or self.at("<"):
                self.call_signature()
                self.member_end()
                continue
            if self.word("new") and self.peek()[:2] in ((PUNCT, "("), (PUNCT, "<")):
                self.next()
                self.call_signature()
                self.member_end()
                continue
            if self.t == PUNCT and self.v in ("+", "-"):
                self.next()
            while self.t == NAME and self.v in ("readonly", "get", "set"):
                t, w, _ = self.peek()
                if t in (NAME, STRING, NUMBER) or t == PUNCT and w == "[":
                    self.next()
                else:
                    break
            if self.at("["):
                if self.index_signature():
                    continue
                state = self.save()
                self.next()
                if self.t == NAME and self.peek()[:2] == (NAME, "in"):
                    self.next()
                    self.next()
                    self.type()
                    if self.eat_word("as"):
                        self.type()
                    self.need("]")
                    if self.t == PUNCT and self.v in ("+", "-"):
                        self.next()
                    self.eat("?")
                    if self.eat(":"):
                        self.type()
                    self.member_end()
                    continue
                self.load(state)
            self.property_name()
            self.eat("?")
            if self.at("(") or self.at("<"):
                self.call_signature()
            elif self.eat(":"):
                self.type()
            self.member_end()

    def call_signature(self):
        if self.at("<"):
            self.type_parameters()
        self.parameters()
        if self.eat(":"):
            self.type(True)


class _Final(Exception):
    """An error inside an arrow function's body: no other reading of it can succeed."""


def _declare_like(_):
    """Marks words that only begin a declaration in TypeScript."""


_TS_DECLARATIONS = frozenset("interface type enum namespace module abstract declare global".split())
_STATEMENTS = {
    "var": Parser.variables, "const": Parser.variables, "let": Parser.let, "if": Parser.if_, "for": Parser.for_, "while": Parser.while_, "do": Parser.do,
    "return": Parser.return_, "throw": Parser.throw, "break": Parser.jump, "continue": Parser.jump, "switch": Parser.switch, "try": Parser.try_,
    "debugger": Parser.debugger, "with": Parser.with_, "function": Parser.function_statement, "class": Parser.class_statement,
    "async": Parser.expression_statement, "import": Parser.import_, "export": Parser.export, **dict.fromkeys(_TS_DECLARATIONS, _declare_like),
}


def read(src: str, ts: bool, jsx: bool, inside: str = "", make: type[Parser] = Parser) -> tuple[Parser | None, Invalid | None]:
    """The parser as far as it came, and the error it ended with; ``inside``: of what ("class", "object") the text is the inside.

    A text nested beyond the interpreter's usual recursion is read again without that bound (frames of Python functions
    live on the heap), so nesting alone never makes a text invalid.
    """
    p = None
    try:
        p = make(src, ts, jsx)
        {"": p.program, "class": p.class_body, "object": p.object_body}[inside]()
        if p.t != END:
            p.fail("after members")
        return p, None
    except (Invalid, _Final) as e:
        return p, Invalid(*e.args)
    except RecursionError:
        usual = sys.getrecursionlimit()
        if usual >= _NO_BOUND:
            raise
        sys.setrecursionlimit(_NO_BOUND)
        try:
            return read(src, ts, jsx, inside, make)
        finally:
            sys.setrecursionlimit(usual)


_NO_BOUND = 1_000_000_000


def parse(src: str, ts: bool, jsx: bool) -> Parser:
    """The parser after the whole module; raises Invalid."""
    p, error = read(src, ts, jsx)
    if error is not None:
        raise error
    return p


def parse_members(src: str, ts: bool, jsx: bool) -> Parser:
    """The same for the inside of a class, as methods cut out of their file are."""
    p, error = read(src, ts, jsx, "class")
    if error is not None:
        raise error
    return p
