"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Method: contiguous rank array.  A pre-token's bytes are cut at every byte; two parallel lists hold the part
boundaries and the rank of each adjacent pair.  The smallest rank is found by scanning the array, its boundary is
deleted, and only the two neighbouring ranks are looked up again.  Results are remembered per distinct pre-token.

Defined cases
-------------
* A null text and an empty text both have the ids ``[]``; blanks are encoded like any other text.
* Strings that look like special tokens are ordinary text.  Very long texts are encoded whole; a pre-token longer
  than ``LONG_WORD`` bytes is merged through a heap instead of by scanning, with the same result.
* Repeated rows are encoded once each.  Other columns are kept out of the Python step.
"""

from __future__ import annotations

import base64
import heapq
import os
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.session import spread

#: Folder of the public vocabularies; a parameter of every function below.
TOKENIZERS = os.environ.get("QUARRYLINE_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: The vocabulary's own pre-token pattern (fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes above which a pre-token is merged through a heap, and pre-tokens remembered per worker.
LONG_WORD, REMEMBERED = 256, 400_000

_NONE = 1 << 60


class _Memo(dict):
    """Ids by pre-token; a missing one is merged, and the memo starts anew when it is full."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[word] = self.merge(word.encode("utf-8", "surrogatepass"))
        return ids


class RankEncoder:
    """Byte-level BPE over one rank table."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(PATTERN).findall
        self.known = _Memo(self.merge)

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one pre-token by the contiguous rank array."""
        ranks = self.ranks
        whole = ranks.get(word)
        if whole is not None:
            return (whole,)
        if len(word) > LONG_WORD:
            return self.merge_long(word)
        get = ranks.get
        bounds = list(range(len(word) + 1))
        near = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
        while near:
            low = min(near)
            if low == _NONE:
                break
            i = near.index(low)
            del bounds[i + 1], near[i]
            if i < len(near):
                near[i] = get(word[bounds[i] : bounds[i + 2]], _NONE)
            if i:
                near[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], _NONE)
        return tuple([ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])])

    def merge_long(self, word: bytes) -> tuple[int, ...]:
        """The same merges for a very long pre-token, in n log n."""
        get, n = self.ranks.get, len(word)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j], end[i], after[i] = False, end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if b < n and (r := get(word[a : end[b]])) is not None:
                    heapq.heappush(heap, (r, a, end[b]))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : end[i]]])
            i = after[i]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.known.__getitem__, self.split(text))))


@lru_cache(maxsize=4)
def encoder(path: str) -> RankEncoder:
    return RankEncoder(path)


def vocabulary(folder: str | None = None, file: str = BYTE_BPE) -> str:
    return os.path.join(folder or TOKENIZERS, file)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): the token ids of every row's text."""
    path = path or vocabulary()
    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        e = encoder(path)
        for b in batches:
            values, offsets = [], [0]
            for t in b.column(1):
                values.extend(e.encode(t.as_py()))
                offsets.append(len(values))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    kind = dict(rows.dtypes)["doc_id"]
    return spread(rows).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def token_counts(documents: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the length of the text in tokens."""
    path = path or vocabulary()
    rows = documents.select(*keep, F.col(text).alias("_text"))

    def run(batches):
        e = encoder(path)
        for b in batches:
            n = pa.array([len(e.encode(t.as_py())) for t in b.column(len(keep))], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), n], [*keep, "n_tokens"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1]) + ", n_tokens bigint"
    return spread(rows).mapInArrow(run, schema)
