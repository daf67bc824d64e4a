"""Lexical and vector search: BM25, exact cosine top-k, hybrid fusion, reranking, diversity caps and de-duplication."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.sized import small_side
from quarryline.session import cut_lineage, spread


def tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))


def _weights(documents: DataFrame, key: str, text: str, terms: DataFrame, k1: float, b: float) -> DataFrame:
    """(term, _key, weight): the BM25 weight of each posting of the terms (term, or term and its number t, which then stands for it).

    Only postings of query terms leave the scan; document lengths and the corpus mean are counted over all rows.
    """
    doc = spread(documents.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))).select("_key", tokens(F.col("_text")).alias("_tokens"))
    doc = doc.select("_key", F.size("_tokens").alias("len"), "_tokens")
    corpus = doc.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"))
    words, known = doc.select("_key", "len", F.explode("_tokens").alias("term")), small_side(terms.distinct())
    hits = words.join(known, "term").select("_key", "len", F.col("t").alias("term")) if "t" in terms.columns else words.join(known, "term", "left_semi")
    posting = cut_lineage(hits.groupBy("term", "_key").agg(F.count("*").alias("tf"), F.first("len").alias("len")))  # used twice: texts are split once for it
    df = small_side(cut_lineage(posting.groupBy("term").agg(F.count("*").alias("df"))))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return posting.join(df, "term").crossJoin(F.broadcast(corpus)).select("term", "_key", weight.alias("weight"))


def bm25(documents: DataFrame, key: str, text: str, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, key, bm25) for a few queries (query_id, query); many go through ``bm25_top_k``."""
    terms = _terms(queries)
    scored = _weights(documents, key, text, terms.select("term"), k1, b).join(small_side(terms), "term")
    return scored.groupBy("query_id", F.col("_key").alias(key)).agg(F.sum("weight").alias("bm25"))


def _bm25_blocks(documents: DataFrame, key: str, text: str, queries: DataFrame, choose: Callable, paired: tuple[DataFrame, DataFrame] | None, k1: float, b: float, query_block: int, document_block: int) -> DataFrame:
    """(query_id, key, bm25) of the hits that ``choose`` takes from each pair of a query block and a document block.

    choose(scores, hits, pairs, terms): positions for one query; pairs marks documents that ``paired`` (query ids, keys)
    asks for, terms is the number of the query's words.
    """
    types = dict(documents.dtypes)
    terms = cut_lineage(_terms(queries).distinct())
    vocabulary = cut_lineage(terms.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))
    posting = _weights(documents, key, text, vocabulary, k1, b).select(F.col("_key").cast("bigint").alias("i"), F.col("term").alias("t"), "weight")
    asked = terms.join(small_side(vocabulary), "term").select(F.col("query_id").cast("bigint").alias("i"), "t")

    def packed(df: DataFrame, count: int, size: int, marked: DataFrame | None, name: str, *values: str) -> DataFrame:
        blocks = max(1, -(-count // size))
        flagged = df.join(small_side(marked.select(F.col(marked.columns[0]).cast("bigint").alias("i"), F.lit(True).alias("m")).distinct()), "i", "left") if marked is not None else df.withColumn("m", F.lit(False))
        row = F.struct("i", F.coalesce("m", F.lit(False)).alias("m"), *values)
        return flagged.groupBy(F.pmod(F.xxhash64("i"), F.lit(blocks)).alias("_b")).agg(F.collect_list(row).alias("_r")).select(*(F.col(f"_r.{c}").alias(f"{name}_{c}") for c in ("i", "m", *values)))

    left = packed(posting, documents.count(), document_block, paired and paired[1], "d", "t", "weight")
    right = packed(asked, queries.count(), query_block, paired and paired[0], "q", "t")

    def product(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                di, dm, dt, dw, qi, qm, qt = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in range(7))
                ids, first, d = np.unique(di, return_index=True, return_inverse=True)
                asks, of, q = np.unique(qi, return_index=True, return_inverse=True)
                marks, q_marks, count = dm[first].astype(bool), qm[of].astype(bool), np.bincount(q)
                common = np.intersect1d(dt, qt)
                scores = np.zeros((len(asks), len(ids)))
                for c in range(0, len(common), 1024):
                    part = common[c : c + 1024]
                    x, y = np.isin(dt, part), np.isin(qt, part)
                    w, has = np.zeros((len(part), len(ids))), np.zeros((len(asks), len(part)))
                    w[np.searchsorted(part, dt[x]), d[x]] = dw[x]
                    has[q[y], np.searchsorted(part, qt[y])] = 1
                    scores += has @ w
                out: list[list] = [[], [], []]
                for n, line in enumerate(scores):
                    if len(hits := np.flatnonzero(line > 0)):
                        value, taken = choose(line[hits], marks[hits] & q_marks[n], count[n])
                        out[0].append(np.full(len(taken), asks[n]))
                        out[1].append(ids[hits[taken]])
                        out[2].append(value[taken])
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], ["query_id", "i", "bm25"])

    found = left.crossJoin(right).mapInArrow(product, "query_id bigint, i bigint, bm25 double")
    return found.select(F.col("query_id").cast(dict(queries.dtypes)["query_id"]).alias("query_id"), F.col("i").cast(types[key]).alias(key), "bm25")


def bm25_top_k(documents: DataFrame, key: str, text: str, queries: DataFrame, k: int, digits: int = 6, k1: float = 1.2, b: float = 0.75, query_block: int = 256, document_block: int = 2048) -> DataFrame:
    """(query_id, key, bm25, rank): the k best documents of each of many queries, exactly, ties by key.

    As in ``vector_top_k`` blocks meet in one product each; scores are rounded before they are ranked.
    """

    def choose(scores, pairs, terms):
        scores = np.round(scores, digits)
        return scores, np.argsort(-scores, kind="stable")[:k]  # in order of the keys

    return top_k(_bm25_blocks(documents, key, text, queries, choose, None, k1, b, query_block, document_block), key, "bm25", k)


def bm25_for_fusion(documents: DataFrame, key: str, text: str, queries: DataFrame, k: int, vectors: DataFrame, vector_queries: DataFrame, k1: float = 1.2, b: float = 0.75, query_block: int = 256, document_block: int = 2048) -> DataFrame:
    """(query_id, key, bm25): the rows of ``bm25`` that the k best of ``hybrid`` can depend on.

    These are each query's least score and its k best (both of every block), and all pairs of a query of
    ``vector_queries`` (first column: ids) and a row of ``vectors`` (first column: keys).  Another hit has no cosine to be
    added to, and at least k hits with a better score stand before it.  What rounding the fused score to 6 digits can
    make equal goes on too: a score is at most (k1 + 1) * 45 a word.
    """

    def choose(scores, pairs, terms):
        best = np.partition(scores, -k)[-k] if len(scores) > k else 0.0
        taken = pairs | (scores >= best - 1e-5 * (k1 + 1) * 45 * terms)
        taken[scores.argmin()] = True
        return scores, np.flatnonzero(taken)

    return _bm25_blocks(documents, key, text, queries, choose, (vector_queries, vectors), k1, b, query_block, document_block)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def vector_scores(vectors: DataFrame, key: str, vector: str, queries: DataFrame) -> DataFrame:
    """(query_id, key, cosine): a few stated queries (query_id, vector) against all vectors, exactly.

    The queries are broadcast behind a check of their number; many queries go through ``vector_top_k``.
    """
    q = small_side(queries.select("query_id", F.col("vector").alias("_q")), 10_000)
    return vectors.select(key, F.col(vector).alias("_v")).crossJoin(q).select("query_id", key, cosine(F.col("_v"), F.col("_q")).alias("cosine"))


def _vector_blocks(vectors: DataFrame, key: str, vector: str, queries: DataFrame, score: Callable, query_block: int, vector_block: int) -> DataFrame:
    """(query_id, key, cosine) from pairs of bounded blocks: score(query ids, vector ids, cosines) yields their columns."""
    types = dict(vectors.dtypes)

    def packed(df: DataFrame, id_column: str, value: str, size: int, name: str) -> DataFrame:
        blocks = F.greatest(F.lit(1), F.ceil(F.col("_n") / size)).cast("int")
        rows = df.select(F.col(id_column).cast("bigint").alias("i"), F.col(value).cast("array<float>").alias("v")).where("i is not null and v is not null")
        counted = rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("_n"))))
        return counted.groupBy(F.pmod(F.xxhash64("i"), blocks).alias("_b")).agg(F.collect_list("i").alias(f"{name}_ids"), F.flatten(F.collect_list("v")).alias(f"{name}_values")).drop("_b")

    left, right = packed(vectors, key, vector, vector_block, "v"), packed(queries, "query_id", "vector", query_block, "q")

    def product(batches):
        for b in batches:
            for row in range(b.num_rows):
                vi, vv, qi, qv = (b.column(c)[row].values.to_numpy(zero_copy_only=False) for c in range(4))
                v, q = (x.reshape(len(i), -1).astype(np.float64) for x, i in ((vv, vi), (qv, qi)))
                unit = lambda x: np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
                order = np.argsort(vi)
                vi, v = vi[order], v[order]
                for out in score(qi, vi, unit(q) @ unit(v).T):
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "i", "cosine"])

    # A stated query set against all rows, block by block.
    pairs = left.crossJoin(right).select("v_ids", "v_values", "q_ids", "q_values").mapInArrow(product, "query_id bigint, i bigint, cosine double")
    return pairs.select(F.col("query_id").cast(dict(queries.dtypes)["query_id"]).alias("query_id"), F.col("i").cast(types[key]).alias(key), "cosine")


def vector_block_scores(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_block: int = 1024, vector_block: int = 8192) -> DataFrame:
    """(query_id, key, cosine) of all pairs, as ``vector_scores`` but for any number of queries."""

    def score(qi, vi, scores):
        for n in range(0, len(qi), 32):
            part = scores[n : n + 32]
            yield np.repeat(qi[n : n + 32], len(vi)), np.tile(vi, len(part)), part.ravel()

    return _vector_blocks(vectors, key, vector, queries, score, query_block, vector_block)


def vector_top_k(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, exclude_same: bool = False, digits: int = 6, query_block: int = 1024, vector_block: int = 8192) -> DataFrame:
    """(query_id, key, cosine, rank): the k nearest vectors of each stated query, exactly, ties by key.

    Both sides are packed into blocks of bounded size; each pair of blocks is one matrix product, of which only the k
    best of each query go on.  Scores are rounded to ``digits`` before they are ranked.
    """

    def score(qi, vi, scores):
        out: list[list] = [[], [], []]
        scores = np.round(scores, digits) + 0.0
        if exclude_same:
            scores[qi[:, None] == vi[None, :]] = -9
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        for n, cols in enumerate(best):
            cols = cols[scores[n, cols] > -9]
            out[0] += [qi[n]] * len(cols)
            out[1] += vi[cols].tolist()
            out[2] += scores[n, cols].tolist()
        yield out

    return top_k(_vector_blocks(vectors, key, vector, queries, score, query_block, vector_block), key, "cosine", k)


def top_k(scores: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """Of each query the k best, ties by key; with rank."""
    w = Window.partitionBy("query_id").orderBy(F.col(score).desc(), F.col(key))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hybrid(lexical: DataFrame, vector: DataFrame, key: str, alpha: float = 0.5) -> DataFrame:
    """Relative-score fusion: each list scaled to 0..1 within its query, alpha * vector + (1 - alpha) * lexical."""
    w = Window.partitionBy("query_id")

    def scaled(df: DataFrame, c: str) -> DataFrame:
        low, high = F.min(c).over(w), F.max(c).over(w)
        return df.select("query_id", key, F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(1.0).alias(c))

    both = scaled(lexical, "bm25").join(scaled(vector, "cosine"), ["query_id", key], "full")
    return both.select("query_id", key, (alpha * F.coalesce("cosine", F.lit(0.0)) + (1 - alpha) * F.coalesce("bm25", F.lit(0.0))).alias("score"))


def reciprocal_rank_fusion(lists: list[DataFrame], key: str, constant: int = 60) -> DataFrame:
    """Fusion of ranked lists (query_id, key, rank)."""
    parts = [x.select("query_id", key, (1.0 / (constant + F.col("rank"))).alias("_s")) for x in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("query_id", key).agg(F.sum("_s").alias("score"))


def overlap_score(query: Column, text: Column) -> Column:
    """The default reranker: the share of the query's words that the text has."""
    q, t = F.array_distinct(tokens(query)), F.array_distinct(tokens(text))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0)


def rerank(rows: DataFrame, query: Column, text: str, key: str, k: int, scorer: Callable[[Column, Column], Column] = overlap_score, budget: int | None = None) -> DataFrame:
    """Rows by the score of a pluggable pair scorer (a column function or a pandas UDF), best k of each query.

    The whole text is scored.  ``budget`` is for a model with an input window: a longer text is then scored in windows
    of so many characters that overlap by a quarter, and the best of them counts.  A key stands once in a query.
    """
    if budget is None:
        return top_k(rows.withColumn("rerank_score", scorer(query, F.col(text))), key, "rerank_score", k)
    overlap = budget // 4
    step, length = budget - overlap, F.length(F.col(text))
    last = F.when(length > budget, F.ceil((length - overlap) / step) - 1).otherwise(0).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda n: F.substring(F.col(text), n * step + 1, F.lit(budget)))
    scored = rows.select("*", F.posexplode(windows).alias("_at", "_window")).withColumn("rerank_score", scorer(query, F.col("_window")))
    best = Window.partitionBy("query_id", key).orderBy(F.col("rerank_score").desc(), "_at")
    return top_k(scored.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "_at", "_window"), key, "rerank_score", k)


def diversity_caps(rows: DataFrame, group: str, pos: str, file: str, name: str, per_file: int, per_name: int) -> DataFrame:
    """Greedy scan in order of ``pos`` with two joint caps: a row one cap rejects doesn't use up the other.

    The lists are the bounded hits of one query each; blank names aren't capped, and a cap of 0 is none.
    """
    item = F.struct(F.col(pos).alias("p"), F.coalesce(F.col(file), F.lit("")).alias("f"), F.coalesce(F.col(name), F.lit("")).alias("n"))
    kind = "struct<kept:array<bigint>,files:array<string>,names:array<string>>"
    start = F.struct(F.array().cast("array<bigint>").alias("kept"), F.array().cast("array<string>").alias("files"), F.array().cast("array<string>").alias("names")).cast(kind)

    def count(values: Column, x: Column) -> Column:
        return F.size(F.filter(values, lambda v: v == x))

    def step(s: Column, x: Column) -> Column:
        ok = F.lit(True)
        if per_file:
            ok = ok & (count(s["files"], x["f"]) < per_file)
        if per_name:
            ok = ok & ((x["n"] == "") | (count(s["names"], x["n"]) < per_name))
        return F.struct(
            F.when(ok, F.array_append(s["kept"], x["p"].cast("bigint"))).otherwise(s["kept"]).alias("kept"),
            F.when(ok, F.array_append(s["files"], x["f"])).otherwise(s["files"]).alias("files"),
            F.when(ok & (x["n"] != ""), F.array_append(s["names"], x["n"])).otherwise(s["names"]).alias("names"),
        ).cast(kind)

    kept = rows.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("_items")).select(group, F.explode(F.aggregate("_items", start, step)["kept"]).alias("_p"))
    return rows.join(kept, (rows[group] == kept[group]) & (rows[pos] == kept["_p"]), "left_semi")


def first_seen(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Of the rows with equal keys the first one in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def hash_embeddings(rows: DataFrame, key: str, text: str, dimension: int = 64) -> DataFrame:
    """(key, embedding): the default embedder, signed feature hashing of words, normalised to length 1."""
    t = rows.select(key, F.explode_outer(tokens(F.col(text))).alias("_t"))
    slot = F.pmod(F.xxhash64("_t"), F.lit(dimension)).cast("int")
    sign = F.when(F.pmod(F.xxhash64("_t", F.lit(7)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    cells = t.groupBy(key, F.when(F.col("_t").isNotNull(), slot).alias("_i")).agg(F.sum(sign).alias("_w"))
    maps = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_i", "_w")))).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0)))
    raw = maps.select(key, dense.alias("_v"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    return raw.select(key, F.transform("_v", lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float")).alias("embedding"))


def cap_per_source(context: DataFrame, score: str, caps: dict[str, int], small: int = 8) -> DataFrame:
    """Context rows with at most ``caps[source]`` of a source by score; sources of up to ``small`` rows stay whole."""
    w = Window.partitionBy("source")
    ranked = context.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.col(score).desc(), "id")))
    keep = F.col("_n") <= small
    for source, most in caps.items():
        keep = keep | ((F.col("source") == source) & (F.col("_r") <= most))
    return ranked.where(keep | ~F.col("source").isin(*caps)).drop("_n", "_r")


def source_counts(context: DataFrame) -> DataFrame:
    """One row: rows of context by source."""
    return context.agg(*(F.count(F.when(F.col("source") == s, 1)).alias(s) for s in ("primary", "graph", "grep", "cypher")))
