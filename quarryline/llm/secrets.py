"""Credentials embedded in source code and configuration.

Method: file chunks get a trigram index; from each detection pattern the trigrams any match must contain are derived;
their postings are intersected, and patterns are verified on the candidate chunks alone.  Postings of a chunk concern
that chunk only, so each task indexes its own chunks and nothing is shuffled.

Defined cases
-------------
* A null or empty content holds no credential.  A very long content is read whole, in chunks of about ``CHUNK``
  characters cut at line ends: what a pattern requires stands on the line a match begins on, and a match that begins in a
  chunk is followed beyond its end.  Names and values may be of any length.
* A line is reported once however many credentials begin on it; repeated rows of an entity_id count once.
* Redaction replaces the credential's characters alone, within its quotes, so that the code still parses; a private key
  keeps its BEGIN and END lines; one without END ends before the first line that isn't base64 or a PEM header.  Empty tables give empty results; other columns aren't read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.trigrams import TrigramIndex
from quarryline.operators.sized import distinct_wide
from quarryline.session import spread

CHUNK = 4_000
MASK = "REDACTED"

#: The end of a name that holds a credential.
_KEY = r"(?:pass(?:word|wd|phrase|code)?|pwd|[_-]pw|[a-z]Pw|[ \n\t\"'.#]pw|secret|token|api[_-]?key|apikey|(?:secret|private|signing|encryption|access|auth|master|account|shared|client|deploy)[_-]?key|credentials?)s?\d*"
_QUOTED = r"(?P<q>\\?[\"'`]{1})(?P<v>(?:(?!(?P=q)).)+)(?P=q)"
RULES = {
    # name = "value", "name": "value", name: value, with brackets, type or a line break between
    "assigned": r"(?i:" + _KEY + r")(?:\s*:\s*[A-Za-z_][\w.\[\]| ]*(?==)|[\"'`])?\s*(?:=>|->|:=|=|:)\s*(?:\(\s*)?(?:[rbfu]?)" + _QUOTED,
    # unquoted, in configuration and comments
    "bare": r"(?i:" + _KEY + r")(?: (?:for|in|on|of|at) [\w-]+)?[ \t]*(?:->|=>|=|:)[ \t]*(?P<v>[^\s\"'`<>(),;{}\[\]]{6,})[ \t]*,?[ \t]*(?=[\r\n#;*\"]|$|\Z|-->|\*/)",
    # the default of a lookup in the environment
    "default": r"(?i:" + _KEY + r")[\"'`]?\)?\s*(?:,|\|\||\?\?|:-|\bor\b)\s*(?:default\s*=\s*)?" + _QUOTED,
    "flag": r"(?i:--?" + _KEY + r")[ =]+[\"']?(?P<v>[^\s\"'`<>(),;{}\[\]$]{6,})",
    "url": r"[a-zA-Z0-9+.-]://[^\s/:@\"'`<>]*+:(?P<v>[^\s/@\"'`<>]{3,})@[\w.-]",
    "parameter": r"[?&](?i:[\w-]*(?:token|api_?key|secret|password|passwd|pwd|signature|sig|auth))=(?P<v>[^\s&\"'`<>#{}$]{8,})",
    "bearer": r"(?i:\bbearer|\bbasic|\btoken)[ ]+(?P<v>[A-Za-z0-9_\-.=+/~]{16,})",
    "jwt": r"(?P<v>eyJ[\w-]{8,}\.eyJ[\w-]{4,}\.[\w-]{8,})",
    "pem": r"(?P<v>-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----)",
    "aws": r"\b(?P<v>(?:AKIA|ASIA)[0-9A-Z]{16})\b",
    "vendor": r"\b(?P<v>(?:[a-z]{2,8}_(?:sk|pk|pat|tok|key|live|test|secret)_|sk_live_|sk_test_|ghp_|gho_|ghs_|github_pat_|glpat-|xox[bpars]-|AIza|npm_|pypi-)[A-Za-z0-9_-]{16,})",
}

_PLACEHOLDER = re.compile(
    r"<.*>?$|.*\$\{|\$[A-Z(]|.*\{\{|%[({]|.*%\(|\[.*\]$|(?:your|my|the|some|insert|put|enter|replace)[-_ ]|(?:x{3,}|\*{3,}|\.{3,}|-+|_+|\?+)$|(?:changeme|change[-_]me|redacted|placeholder|example|dummy|none|null|nil|true|false|undefined|todo|tbd|test|secret|password|passwd|pwd|token|string|hidden|set[-_]me|fixme|n/?a|unset|empty|required|optional)$",
    re.I,
)
_REFERENCE = re.compile(r"(?:os|process|settings|config|env|self|this|conf|app|secrets|vault|import|get|System|ENV|props|ctx|state|options|args|params|request|req)\b[.\[(]|.*\(\)?$|[\w.-]*vault\b|(?:arn|secret|ssm|vault|op|gcp|aws)[:/]", re.I)
_PATHLIKE = re.compile(r"\.{0,2}/?(?:[a-z][a-z_-]*/)+[a-z._-]*$|/[\w/{}:.-]*$")
_NAME = re.compile(r"[A-Za-z_][A-Za-z_]*$|[a-z]+(?:[-_.][a-z]+)+$")


def usable(rule: str, value: str) -> bool:
    """Whether the text a pattern caught can be a credential rather than a placeholder, a reference or a label."""
    if rule in ("pem", "jwt", "aws"):
        return True
    v = value.strip()
    if rule == "url":
        return not (_PLACEHOLDER.match(v) or v[:1] in "$%{")
    if len(v) < 6 or any(c.isspace() for c in v) or _PLACEHOLDER.match(v):
        return False
    if rule in ("assigned", "bare", "default", "flag"):
        if "://" in v:
            return False  # the url rule tells
        if _PATHLIKE.match(v) or _REFERENCE.match(v):
            return False
        if rule == "bare" and (v[0] in "$%&|=*" or v.count(".") and v.split(".")[0] in ("os", "process", "settings", "config")):
            return False
    # A plain name or a word is a label; a credential has digits, mixed case with marks, or much length.
    if rule in ("parameter", "bearer", "vendor") and v.lower() != v and v.upper() != v:
        return True
    if _NAME.match(v) and not (len(v) >= 20 and v.lower() != v and v.upper() != v and "_" not in v):
        return False
    return True


_PEM_END = re.compile(r"-----END [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----")
_PEM_BEGIN = re.compile(RULES["pem"])
#: A line of a key as it stands in files, comments and string literals; the first is what follows BEGIN on its line.
_PEM_LINE = re.compile(r"[ \t]*+(?:(?:#|//|\*)[ \t]*+)?+[\"'`]?+(?:(?:Proc-Type|DEK-Info|Version|Comment|MessageID|Hash|Charset):[^\r\n\"'`\\]*+|[A-Za-z0-9+/]*+={0,2}+)(?:(?:\\[nr])++(?:[A-Za-z0-9+/]++={0,2}+)?+)*+[\"'`]?+[ \t+,;()\\]*+\r?+(?=\n|\Z)")


def key_end(text: str, begun: int) -> tuple[int, int]:
    """Where the body of the private key ends whose BEGIN ends at ``begun``, and where its END does (or the body again)."""
    after = _PEM_BEGIN.search(text, begun)
    limit = after.start() if after else len(text)
    if m := _PEM_END.search(text, begun, limit):
        return m.start(), m.end()
    at = begun
    while at < limit and (m := _PEM_LINE.match(text, at, limit)):
        at = m.end() + 1
    at = min(max(begun, at - 1), limit)
    return at, at


class Scanner:
    """The rules over an index of chunks."""

    def __init__(self):
        self.index = TrigramIndex(RULES)

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """Of each text the (start, end, rule) of its credentials, ascending and without overlaps."""
        chunks, origin = [], []
        for n, text in enumerate(texts):
            for at, end in split_chunks(text or ""):
                chunks.append(text[max(0, at - 1) : end])  # with the line end before it, which a pattern may begin on
                origin.append((n, max(0, at - 1), end))
        found: list[set] = [set() for _ in texts]
        if chunks:
            for rule, hits in self.index.candidates(chunks).items():
                pattern = self.index.rules[rule][0]
                for c in hits.tolist():
                    n, at, end = origin[c]
                    for m in pattern.finditer(texts[n], at, beyond(texts[n], end)):
                        if m.start() >= end:
                            break
                        if usable(rule, m.group("v")):
                            found[n].add((m.start("v"), m.end("v"), rule))
        return [self._settle(texts[n] or "", f) for n, f in enumerate(found)]

    @staticmethod
    def _settle(text: str, found: set) -> list[tuple[int, int, str]]:
        out: list[tuple[int, int, str]] = []
        keys = [(s, e) for s, e, r in found if r == "pem"]
        spans = []
        for s, e in keys:
            spans.append((s, key_end(text, e)[1]))
        for s, e, rule in sorted(found, key=lambda x: (x[0], -x[1])):
            if rule != "pem" and any(a <= s < b for a, b in spans):
                continue
            if out and s < out[-1][1]:
                continue
            out.append((s, e, rule))
        return out


def split_chunks(text: str, size: int = CHUNK) -> list[tuple[int, int]]:
    """Start and end of the pieces of about ``size`` characters of a text, cut at line ends."""
    out, at = [], 0
    while at < len(text):
        end = len(text) if at + size >= len(text) else (text.find("\n", at + size) + 1 or len(text))
        out.append((at, end))
        at = end
    return out


#: Lines with something on them that a match may go on over: a pattern has at most so many places for line breaks.
_BREAKS = 6
_LINES = re.compile(r"(?:\s*+\S[^\n]*+(?:\n|\Z)){0,%d}" % _BREAKS)


def beyond(text: str, end: int) -> int:
    """How far a match that begins before ``end`` can reach."""
    return _LINES.match(text, end).end()


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with its credentials masked; everything else, line ends included, stays."""
    parts, last = [], 0
    for s, e, rule in spans:
        if rule == "pem":
            stop, _ = key_end(text, e)
            parts += [text[last:e], re.sub(r"[^\s\"'`\\,;]+", MASK, text[e:stop])]
            last = stop
        else:
            parts += [text[last:s], MASK]
            last = e
    return "".join([*parts, text[last:]])


def _run(batches, emit):
    scanner = Scanner()
    for b in batches:
        for i in range(0, b.num_rows, 500):
            part = b.slice(i, 500)
            texts = part.column(part.num_columns - 1).to_pylist()
            yield emit(part, texts, scanner.scan(texts))


def secret_lines(results: DataFrame) -> DataFrame:
    """(entity_id, line_no, rule) of each line on which a credential begins."""
    rows = results.where(F.col("content").isNotNull()).select("entity_id", "content")

    def emit(part, texts, found):
        ids, lines, rules = [], [], []
        for i, text, spans in zip(part.column(0).to_pylist(), texts, found):
            for s, _, rule in spans:
                ids.append(i)
                lines.append(text.count("\n", 0, s) + 1)
                rules.append(rule)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(lines, pa.int64()), pa.array(rules, pa.string())], ["entity_id", "line_no", "rule"])

    return spread(rows).mapInArrow(lambda b: _run(b, emit), "entity_id string, line_no bigint, rule string")


def redacted(results: DataFrame) -> DataFrame:
    """(entity_id, content, n_redacted) of every distinct row, credentials masked."""
    rows = distinct_wide(spread(results.select("entity_id", "content")), ["entity_id"], "content")

    def emit(part, texts, found):
        out = [None if t is None else redact(t, s) for t, s in zip(texts, found)]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string()), pa.array([len(s) for s in found], pa.int32())], ["entity_id", "content", "n_redacted"])

    return rows.mapInArrow(lambda b: _run(b, emit), "entity_id string, content string, n_redacted int")
