"""Long exact spans that stand verbatim in more than one document.

Method: content-defined chunking with a gear rolling hash.  The gear hash of ``GEAR`` characters is taken at every
position; cut points are the positions whose hash is the least of some window of ``reach`` neighbouring ones, so they
depend on near content alone, move along with it when text is inserted before them, and are never further apart than
``reach``.  A chunk runs from a cut point to the first cut point at least ``least`` characters on, so its length varies;
chunks are deduplicated by digest.  Within a common span of ``span`` characters the cut points at reach - 1 from both
ends on are decided by the span alone, the first lies within 2 * reach - 2, and a chunk is at most least + reach - 1
long, so with least <= span - GEAR - 4 * reach + 4 some chunk of both texts lies in the span: no pair is missed.

Chunks of one text only are dropped.  A window of ``span`` characters can be shared only if every chunk whose cut
points it decides is shared; that leaves few places (``candidate_starts``).  Two results are made of them:

* ``document_pairs``: the candidate places are chunked again with a small reach, so that chunks are nearly as long as
  the span.  Chunks with one and the same set of texts are one class.  Each member of a class is compared with the
  class's representative, which tells how far the two agree around the chunk; two members that both agree with it far
  enough are a pair without being compared, and only the other pairs of a class are compared themselves.
* ``portions``: every candidate window has a 128-bit digest; windows of more than one text are shared, and a text's
  shared portion is their union.  No pairs are made: the work grows with the characters in candidate places.

Defined cases
-------------
* Null, empty, blank texts and texts shorter than the span share nothing and have a shared portion of 0.
* Copies of one text (128-bit hash) are one class: their pairs come from the class, their shared portion is the whole
  text.  If rows of one doc_id differ in text, the text of least hash counts.
* Characters are Unicode code points; blanks and case count.  Very long texts are read whole, in overlapping pieces.
* A repeated row of one doc_id isn't another document.  Empty tables give empty results; other columns aren't read.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.sized import pairs_in_groups, small_bytes, small_side
from quarryline.session import cut_lineage, spread

MIN_SPAN = 200
GEAR = 6
#: Reach of the second chunking, whose chunks are nearly as long as the span.
FINE = 8
#: Characters that are chunked at once; a longer text is cut into pieces that overlap by a span.
PIECE = 400_000

_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def reach_of(span: int) -> int:
    """The reach of the first chunking: chunks are then at least a quarter of the span long."""
    if span < 40:
        raise ValueError("a span has at least 40 characters")
    return max(2, span * 9 // 50)


def least_of(span: int, reach: int) -> int:
    return span - GEAR - 4 * reach + 4


def _words(codes: np.ndarray, salt: int = 0) -> np.ndarray:
    """A fixed pseudo-random 64-bit word for each code point (the splitmix finaliser)."""
    x = codes.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 + salt * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _sliding(x: np.ndarray, width: int, join) -> np.ndarray:
    """Least or greatest of every window of ``width``, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = join(x[:-step], x[step:])
        done += step
    return x


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, at least n + 1 of each."""
    known = _POWERS.get(which)
    if known is None or len(known[0]) <= n:
        size = max(n + 1, 2 * PIECE)
        up, down = np.full(size, _BASES[which], np.uint64), np.full(size, pow(_BASES[which], -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        known = _POWERS[which] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return known


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Stretch:
    """Pieces of texts laid end to end, with gaps between; every position below is one of the whole stretch.

    owner[i], offset[i]: of piece i its text and its place in that; first[i], last[i]: where it begins and ends here.
    """

    def __init__(self, parts: list[tuple[int, int, np.ndarray]], gap: int):
        self.owner = np.array([o for o, _, _ in parts], np.int64)
        self.offset = np.array([o for _, o, _ in parts], np.int64)
        sizes = np.array([len(c) for _, _, c in parts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes + gap)])[:-1].astype(np.int64)
        self.last = self.first + sizes
        blank = np.zeros(gap, np.uint32)
        self.codes = np.concatenate([x for _, _, c in parts for x in (c, blank)]) if parts else np.zeros(0, np.uint32)
        self._words: dict[int, np.ndarray] = {}
        self._sums: dict[int, np.ndarray] = {}

    def words(self, which: int) -> np.ndarray:
        if which not in self._words:
            self._words[which] = _words(self.codes, which)
        return self._words[which]

    def piece(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1

    def digest(self, start: np.ndarray, stop: np.ndarray, which: int = 0) -> np.ndarray:
        """Digests of parts, from prefix sums."""
        up, down = _powers(len(self.codes), which)
        if which not in self._sums:
            sums = np.zeros(len(self.codes) + 1, np.uint64)
            np.cumsum(self.words(which) * up[: len(self.codes)], out=sums[1:], dtype=np.uint64)
            self._sums[which] = sums
        sums = self._sums[which]
        x = (sums[stop] - sums[start]) * down[start]
        return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)

    def cuts(self, reach: int) -> np.ndarray:
        """The cut points, ascending."""
        n = len(self.codes) - GEAR + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        table = self.words(0)
        gear = np.zeros(n, np.uint64)
        for i in range(GEAR):
            gear = (gear << np.uint64(1)) + table[i : n + i]
        gear ^= gear >> np.uint64(29)
        inside = np.zeros(n + 1, np.int8)
        inside[self.first[self.first < n]] += 1
        ends = np.minimum(np.maximum(self.last - GEAR + 1, self.first), n)
        np.subtract.at(inside, ends, 1)
        outside = np.cumsum(inside[:-1]) <= 0
        gear[outside] = _MAX
        edge = np.full(reach - 1, _MAX)
        low = _sliding(np.concatenate([edge, gear, edge]), reach, np.minimum)  # of each window that meets the stretch
        most = _sliding(low, reach, np.maximum)
        return np.flatnonzero((most == gear) & ~outside)

    def chunks(self, reach: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and stop of each chunk."""
        cuts = self.cuts(reach)
        at = np.searchsorted(cuts, cuts + least)
        keep = at < len(cuts)
        start, stop = cuts[keep], cuts[at[keep]]
        same = self.piece(start) == self.piece(stop)
        return start[same], stop[same]

    def candidates(self, start: np.ndarray, stop: np.ndarray, shared: np.ndarray, span: int, reach: int) -> np.ndarray:
        """Starts of the windows of ``span`` characters all of whose decided chunks are shared."""
        bad = ~shared
        piece = self.piece(start[bad])
        first = np.maximum(stop[bad] - span + GEAR + reach - 1, self.first[piece])
        last = np.minimum(start[bad] - reach + 2, self.last[piece] - span + 1)  # exclusive
        there = first < last
        n = len(self.codes) + 1
        steps = np.bincount(first[there], minlength=n) - np.bincount(last[there], minlength=n)
        wide = self.last - self.first >= span
        steps -= np.bincount(self.first[wide], minlength=n) - np.bincount(self.last[wide] - span + 1, minlength=n)
        return np.flatnonzero(np.cumsum(steps) == -1)


def pieces(text: str, span: int):
    """(offset, code points) of the pieces of a text; every window of ``span`` characters lies in exactly one."""
    codes = _codes(text)
    for at in range(0, max(1, len(codes) - span + 1), PIECE):
        yield at, codes[at : at + PIECE + span - 1]


def stretches(cids: list[int], texts, span: int):
    """Stretches of about ``PIECE`` characters of a batch of texts."""
    parts, size = [], 0
    for cid, text in zip(cids, texts):
        for at, codes in pieces(text.as_py(), span):
            parts.append((cid, at, codes))
            size += len(codes)
            if size >= PIECE:
                yield Stretch(parts, span)
                parts, size = [], 0
    if parts:
        yield Stretch(parts, span)


def _first_chunks(span: int):
    reach = reach_of(span)
    least = least_of(span, reach)

    def run(batches):
        for batch in batches:
            for s in stretches(batch.column(0).to_pylist(), batch.column(1), span):
                a, b = s.chunks(reach, least)
                cid, digest = s.owner[s.piece(a)], s.digest(a, b).view(np.int64)
                order = np.lexsort((digest, cid))
                cid, digest = cid[order], digest[order]
                new = np.ones(len(cid), bool)
                new[1:] = (cid[1:] != cid[:-1]) | (digest[1:] != digest[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(cid[new]), pa.array(digest[new])], ["cid", "digest"])

    return run


def _places(batch, span: int):
    """Stretches of a batch of (cid, text, shared digests), and their candidate starts."""
    reach = reach_of(span)
    least = least_of(span, reach)
    # A digest that is shared at all is in the list of every text that has it: the lists of a batch can be one.
    known = np.unique(batch.column(2).flatten().to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0, np.int64)
    for s in stretches(batch.column(0).to_pylist(), batch.column(1), span):
        a, b = s.chunks(reach, least)
        yield s, s.candidates(a, b, np.isin(s.digest(a, b).view(np.int64), known), span, reach)


def _fine_chunks(span: int):
    """(cid, digest, at, size) of the fine chunks in candidate places."""
    least = least_of(span, FINE)

    def run(batches):
        for batch in batches:
            for s, starts in _places(batch, span):
                if not len(starts):
                    continue
                a, b = s.chunks(FINE, least)
                # Chunks within a candidate window: the last candidate start at or before a reaches b.
                before = np.searchsorted(starts, a, "right") - 1
                inside = (before >= 0) & (b <= starts[before] + span)
                a, b = a[inside], b[inside]
                piece = s.piece(a)
                at = a - s.first[piece] + s.offset[piece]
                yield pa.RecordBatch.from_arrays([pa.array(s.owner[piece]), pa.array(s.digest(a, b).view(np.int64)), pa.array(at.astype(np.int32)), pa.array((b - a).astype(np.int32))], ["cid", "digest", "at", "size"])

    return run


def _window_digests(span: int):
    """(cid, at, d, e) of every candidate window."""

    def run(batches):
        for batch in batches:
            for s, starts in _places(batch, span):
                if len(starts):
                    piece = s.piece(starts)
                    at = starts - s.first[piece] + s.offset[piece]
                    d, e = (s.digest(starts, starts + span, which) for which in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(s.owner[piece]), pa.array(at.astype(np.int32)), pa.array(d.view(np.int64)), pa.array(e.view(np.int64))], ["cid", "at", "d", "e"])

    return run


def share_span(a: str, b: str, span: int = MIN_SPAN) -> bool:
    """Whether two texts have a common span: digests of all windows, then the characters themselves."""
    if len(a) < span or len(b) < span:
        return False
    ha, hb = Stretch([(0, 0, _codes(a))], 0), Stretch([(0, 0, _codes(b))], 0)
    sa, sb = np.arange(len(a) - span + 1), np.arange(len(b) - span + 1)
    da, db = ha.digest(sa, sa + span), hb.digest(sb, sb + span)
    return any(a[i : i + span] in b for i in np.flatnonzero(np.isin(da, db)).tolist())


def agreement(a: str, i: int, b: str, j: int, size: int, span: int) -> tuple[int, int]:
    """How far a and b agree left and right of a chunk that begins at i and j, at most ``span`` each; (-1, -1): not even there."""
    if a[i : i + size] != b[j : j + size]:
        return -1, -1
    left = 0
    while left < span and i > left and j > left and a[i - left - 1] == b[j - left - 1]:
        left += 1
    right, u, v = 0, i + size, j + size
    while right < span and u + right < len(a) and v + right < len(b) and a[u + right] == b[v + right]:
        right += 1
    return left, right


def _compare_with_first(span: int):
    """Rows of (class, cid, at, size, surroundings, those of the representative, place in them): how far each member agrees with the representative."""

    def run(batches):
        for batch in batches:
            group, cid, at, size, _, _, first_at = (batch.column(i).to_pylist() if i not in (4, 5) else None for i in range(7))
            far = [agreement(x.as_py(), i, y.as_py(), j, n, span) for x, i, y, j, n in zip(batch.column(4), at, batch.column(5), first_at, size)]
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(cid, pa.int64()), pa.array(size, pa.int32()), pa.array([x for x, _ in far], pa.int32()), pa.array([x for _, x in far], pa.int32())], ["class", "cid", "size", "left", "right"])

    return run


def _compare_pairs(span: int):
    def run(batches):
        for batch in batches:
            keep = pa.array([share_span(x.as_py(), y.as_py(), span) for x, y in zip(batch.column(2), batch.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


class SharedSpans:
    """The shared spans of a corpus of at least ``span`` characters: links between text classes, and portions."""

    def __init__(self, documents: DataFrame, key: str = "doc_id", text: str = "text", span: int = MIN_SPAN):
        reach_of(span)
        self.span = span
        self.rows = spread(documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")))
        long = self.rows.where(F.length("text") >= span).withColumn("hash", F.unhex(F.md5("text")))
        # A text class is named by its least doc_id; only narrow rows are shuffled to find it.
        named = cut_lineage(long.select("doc_id", "hash"))
        each = named.groupBy("doc_id").agg(F.min("hash").alias("hash"))
        first = each.groupBy("hash").agg(F.min("doc_id").alias("cid"))
        self.members = cut_lineage(each.join(first, "hash"))
        surplus = named.join(self.members.where("doc_id = cid").select("doc_id", "hash"), ["doc_id", "hash"], "left_anti").distinct()
        #: One row a class (repeated rows of it aside): cid, text.
        self.texts = long.join(small_side(cut_lineage(surplus)), ["doc_id", "hash"], "left_anti").select(F.col("doc_id").alias("cid"), "text")
        chunks = self.texts.mapInArrow(_first_chunks(span), "cid bigint, digest bigint")
        # Partial sums before the shuffle: a hot chunk is one row a task.
        shared = cut_lineage(chunks.groupBy("digest").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo < hi").select("digest"))
        hits = cut_lineage(chunks.join(small_side(shared), "digest").groupBy("cid").agg(F.collect_set("digest").alias("digests")))
        #: Texts with shared chunks, and their shared digests.
        self.open = self.texts.join(small_bytes(hits, F.size("digests") * 8 + 32), "cid").select("cid", "text", "digests")

    @cached_property
    def classes(self) -> DataFrame:
        """(class, cid, at, size) of the members of each set of texts that share a fine chunk; the chunk of least digest stands for a set."""
        fine = cut_lineage(self.open.mapInArrow(_fine_chunks(self.span), "cid bigint, digest bigint, at int, size int").dropDuplicates(["digest", "cid"]))
        marks = fine.groupBy("digest").agg(F.count("*").alias("n"), F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("x"))
        kept = marks.where("n > 1").groupBy("n", "s", "x").agg(F.min("digest").alias("digest")).select("digest")
        return cut_lineage(fine.join(small_side(cut_lineage(kept)), "digest").select(F.col("digest").alias("class"), "cid", "at", "size"))

    @cached_property
    def links(self) -> DataFrame:
        """(a < b) of text classes with a common span."""
        first = self.classes.groupBy("class").agg(F.min("cid").alias("first"))
        # Of each member the surroundings of the chunk, cut out before anything is shuffled.
        start = F.greatest(F.lit(0), F.col("at") - self.span)
        near = F.substring("text", start + 1, F.col("at") - start + F.col("size") + self.span)
        around = self.texts.join(small_side(self.classes), "cid").select("class", "cid", (F.col("at") - start).alias("at"), "size", near.alias("near"))
        around = cut_lineage(around.dropDuplicates(["class", "cid"]).join(first, "class"))
        heads = around.where("cid = first").select("class", F.col("near").alias("first_near"), F.col("at").alias("first_at"))
        rows = around.select("class", "cid", "size", "first")
        both = around.where("cid <> first").join(heads, "class").select("class", "cid", "at", "size", "near", "first_near", "first_at")
        far = both.mapInArrow(_compare_with_first(self.span), "class bigint, cid bigint, size int, left int, right int")
        own = rows.where("cid = first").select("class", "cid", "size", F.lit(self.span).alias("left"), F.lit(self.span).alias("right"))
        members = cut_lineage(far.unionByName(own).withColumn("far", F.struct("size", "left", "right")))
        pairs = pairs_in_groups(members, "class", "cid", carry="far")
        known = (F.least("far_a.left", "far_b.left") >= 0) & (F.col("far_a.size") + F.least("far_a.left", "far_b.left") + F.least("far_a.right", "far_b.right") >= self.span)
        pairs = cut_lineage(pairs.groupBy("a", "b").agg(F.max(known).alias("known")))
        open_pairs = pairs.where(~F.col("known")).select("a", "b")
        wanted = cut_lineage(open_pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
        texts = self.texts.join(small_side(wanted), "cid", "left_semi").dropDuplicates(["cid"])
        compared = (
            open_pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b")
            .select("a", "b", "ta", "tb")
            .mapInArrow(_compare_pairs(self.span), "a bigint, b bigint")
        )
        return pairs.where("known").select("a", "b").unionByName(compared)

    def document_pairs(self) -> DataFrame:
        """(doc_id_a < doc_id_b) of all documents that share a span, copies expanded."""
        m = self.members.select("doc_id", "cid")
        across = (
            self.links.join(m.select(F.col("cid").alias("a"), F.col("doc_id").alias("x")), "a")
            .join(m.select(F.col("cid").alias("b"), F.col("doc_id").alias("y")), "b")
            .select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
        )
        copies = pairs_in_groups(m, "cid", "doc_id").select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))
        return across.unionByName(copies).distinct()

    def portions(self) -> DataFrame:
        """Per document: its class, length, characters it shares with others, links and copies.

        ``links`` counts, over the sets of texts that share a passage with the document's text, their other members: a
        partner is counted once a set, so that no pairs have to be made.
        """
        windows = self.open.mapInArrow(_window_digests(self.span), "cid bigint, at int, d bigint, e bigint")
        shared = cut_lineage(windows.groupBy("d", "e").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo < hi").select("d", "e"))
        w = Window.partitionBy("cid").orderBy("at")
        fresh = F.least(F.lit(self.span), F.coalesce(F.col("at") - F.lag("at").over(w), F.lit(self.span)))
        covered = windows.join(small_side(shared), ["d", "e"], "left_semi").select("cid", fresh.alias("fresh")).groupBy("cid").agg(F.sum("fresh").alias("covered"))
        sizes = self.classes.groupBy("class").agg((F.count("*") - 1).alias("others"))
        links = self.classes.join(sizes, "class").groupBy("cid").agg(F.sum("others").alias("links"))
        about = self.members.groupBy("cid").agg(F.count("*").alias("copies")).join(links, "cid", "left").join(covered, "cid", "left")
        chars = self.rows.groupBy("doc_id").agg(F.min_by(F.coalesce(F.length("text"), F.lit(0)), F.coalesce(F.md5("text"), F.lit(""))).alias("chars"))
        whole = F.when(F.col("copies") > 1, F.col("chars").cast("bigint")).otherwise(F.coalesce("covered", F.lit(0)))
        return (
            chars.join(self.members.select("doc_id", "cid"), "doc_id", "left")
            .join(about, "cid", "left")
            .select(
                "doc_id",
                F.coalesce("cid", "doc_id").alias("class_id"),
                "chars",
                F.coalesce(whole, F.lit(0)).cast("bigint").alias("shared_chars"),
                F.when(F.col("covered") > 0, F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).alias("links"),
                F.coalesce("copies", F.lit(1)).alias("copies"),
            )
        )
