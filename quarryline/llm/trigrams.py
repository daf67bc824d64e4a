"""Trigrams that any match of a regular expression must contain, and a trigram index of text chunks."""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser

import numpy as np

#: A clause is a list of alternatives, an alternative a set of trigrams; every clause needs one whole alternative.
Clauses = list[list[frozenset[str]]]
_MOST = 64


def _grams(run: str) -> frozenset[str]:
    return frozenset(run[i : i + 3] for i in range(len(run) - 2))


def required_trigrams(pattern: str) -> Clauses:
    """Clauses that hold for the lower-cased form of every text the pattern matches; [] if nothing is required."""
    return _walk(_parser.parse(pattern))


def _walk(tree) -> Clauses:
    clauses: Clauses = []
    # Literal runs so far: the texts that may stand just before this place.
    runs: list[str] = [""]

    def close():
        nonlocal runs
        alternatives = [_grams(r) for r in runs]
        if all(alternatives):
            clauses.append(alternatives)
        runs = [""]

    for op, arg in tree:
        texts = _texts(op, arg)
        if texts is not None and len(texts) * len(runs) <= _MOST:
            runs = [a + b for a in runs for b in texts]
            continue
        close()
        if texts is not None:
            runs = texts
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, getattr(sre, "POSSESSIVE_REPEAT", None)):
            if arg[0] > 0:
                clauses += _walk(arg[2])
        elif op is sre.SUBPATTERN:
            clauses += _walk(arg[3])
        elif op is sre.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(parts):
                clauses.append([min(p, key=len)[0] if len(p[0]) == 1 else p[0][0] for p in parts] if all(len(p[0]) == 1 for p in parts) else [g for p in parts for g in p[0]])
    close()
    return clauses


def _texts(op, arg) -> list[str] | None:
    """All texts a small node matches, or None."""
    if op is sre.LITERAL:
        return [chr(arg).lower()]
    if op is sre.IN and all(o in (sre.LITERAL, sre.RANGE) for o, _ in arg):
        codes = {c for o, a in arg for c in ((a,) if o is sre.LITERAL else range(a[0], a[1] + 1))}
        return sorted({chr(c).lower() for c in codes}) if len(codes) <= 32 else None
    if op is sre.AT:
        return [""]
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1:
        inner = _sequence(arg[2])
        return None if inner is None else sorted({*inner, *([""] if arg[0] == 0 else [])})
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])
    if op is sre.BRANCH:
        out: set[str] = set()
        for x in arg[1]:
            t = _sequence(x)
            if t is None:
                return None
            out.update(t)
        return sorted(out) if len(out) <= _MOST else None
    return None


def _sequence(tree) -> list[str] | None:
    out = [""]
    for op, arg in tree:
        t = _texts(op, arg)
        if t is None or len(t) * len(out) > _MOST:
            return None
        out = [a + b for a in out for b in t]
    return out


class TrigramIndex:
    """Postings (trigram -> chunk numbers) over chunks, for the trigrams some rules require."""

    def __init__(self, rules: dict[str, str]):
        self.rules = {name: (re.compile(p), required_trigrams(p)) for name, p in rules.items()}
        if missing := [n for n, (_, c) in self.rules.items() if not c]:
            raise ValueError(f"no trigram is required by {missing}")
        grams = sorted({g for _, c in self.rules.values() for alts in c for alt in alts for g in alt})
        self.number = {g: i for i, g in enumerate(grams)}
        self.table = np.full(1 << 21, -1, np.int32)
        for g, i in self.number.items():
            if g.isascii():
                a, b, c = g.encode()
                self.table[(a << 14) | (b << 7) | c] = i

    def postings(self, chunks: list[str]) -> list[np.ndarray]:
        """For each trigram the ascending numbers of the chunks that hold it."""
        raw = [c.lower().encode("ascii", "replace") for c in chunks]
        flat = np.frombuffer(b"\0\0".join(raw) + b"\0\0", np.uint8).astype(np.int32)
        owner = np.repeat(np.arange(len(raw)), [len(r) + 2 for r in raw])
        code = (flat[:-2] << 14) | (flat[1:-1] << 7) | flat[2:]
        gram = self.table[code]
        hit = np.flatnonzero(gram >= 0)
        pairs = np.unique(gram[hit].astype(np.int64) * len(raw) + owner[hit])
        gram, chunk = pairs // len(raw), pairs % len(raw)
        return np.split(chunk, np.searchsorted(gram, np.arange(1, len(self.number))))

    def candidates(self, chunks: list[str]) -> dict[str, np.ndarray]:
        """For each rule the chunks whose postings meet all its clauses."""
        lists = self.postings(chunks)
        out, met = {}, {}
        for name, (_, clauses) in self.rules.items():
            found = None
            for alternatives in clauses:
                clause = frozenset(alternatives)  # rules share clauses: each is met once
                if clause not in met:
                    some = [self._all([lists[self.number[g]] for g in alt]) for alt in alternatives]
                    met[clause] = np.unique(np.concatenate(some)) if len(some) > 1 else some[0]
                mine = met[clause]
                found = mine if found is None else np.intersect1d(found, mine, assume_unique=True)
            out[name] = found
        return out

    @staticmethod
    def _all(lists: list[np.ndarray]) -> np.ndarray:
        lists = sorted(lists, key=len)
        out = lists[0]
        for x in lists[1:]:
            if not len(out):
                break
            out = np.intersect1d(out, x, assume_unique=True)
        return out
