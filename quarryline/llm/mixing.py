"""Mixing sources to target weights.

Method: soft-membership mixing.  A classifier fitted on a bounded table of labelled documents gives each document a
posterior over the sources; the written label, normalised, is evidence with a known error rate.  Nonnegative document
rates r are then fitted by distributed projected-gradient least squares, so that the expected tokens of each source meet
the targets: with t the tokens and p the posterior of a document, the error is e = sum(r t p) - goal, and its gradient in
the metric that weighs documents by their tokens is p . e; it is taken after scaling by the inverse of M = sum(t p p'),
for which 1 is the greatest safe step.  Each step sums r t p over all documents (partial sums in each task, k rows to the
driver) and moves every rate by -p . inv(M) e, cut at 0 and at the repeats its source allows.  ``converged``, ``steps``
and ``error`` tell how the fit ended.

Rates become whole repeats by a hash of the key: a document gets the whole part, and one more if its hash falls below the
fraction.  What that leaves of a source's goal, by the tokens of the documents it is likeliest for, is mended in a few
rounds: documents no longer than the rest of the goal are added (or taken out) in the order of another hash until it is
used up; a round sums tokens by hash buckets, at most ``BUCKETS`` rows a source to the driver.  Neither depends on
partitions, and no source is sorted or walked through by one task.

The size of the mixture is ``ROOM`` of the largest at which no source has to be repeated more than its ``max_repeats``; targets of
sources without a document can't be met, and the others keep their proportions.

Defined cases
-------------
* Null and empty texts have no tokens, are never part of the mixture, and count as documents of 0 tokens.
* A label is matched without case, blanks and marks; a null or unknown label leaves the text to decide.
* Very long texts are encoded whole.  Repeated rows of a doc_id are one document.  Empty tables give an empty mixture
  and shares of 0.  Other columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.tokenizer import encoder, vocabulary
from quarryline.session import cut_lineage, spread

#: Labelled documents the classifier is fitted on: about as many of each source, those with the least hash of their key,
#: so that rare sources are in it.  The corpus's own label counts correct for the even sampling.
LABELLED_ROWS = 10_000
#: Share of written labels that are taken to be wrong.
LABEL_ERROR = 0.03
#: Steps of the projected gradient, at most, and the relative error at which they end.
STEPS, TOLERANCE = 30, 1e-3
#: Share of the largest possible size that is aimed at, so that rates have room below their bounds.
ROOM = 0.97
#: Buckets of the features: tokens, openings of lines, the first and the last token.
TOKENS, OPENINGS, EDGES = 256, 256, 32
#: Hash buckets a round of the rounding sums by, and rounds at most.
BUCKETS, ROUNDS = 4096, 12

N_FEATURES = 8 + TOKENS + OPENINGS + 2 * EDGES


def normal_label(label):
    """Column: a source name without case, blanks and marks."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def _bag(hashes: np.ndarray, buckets: int) -> np.ndarray:
    counts = np.log1p(np.bincount(hashes % buckets, minlength=buckets))
    return 3 * counts / max(1e-9, float(np.sqrt(counts @ counts)))


def features(text: str, ids: list[int]) -> np.ndarray:
    """Shape of a document, and hashed bags of its tokens and of the two bytes its lines open with."""
    x = np.zeros(N_FEATURES, np.float32)
    lines, n = text.count("\n") + 1, len(ids)
    x[:8] = (1.0, math.log1p(n), math.log1p(lines), math.log1p(len(text) / lines), len(text) / max(1, n) / 4, math.log1p(n) ** 2 / 20, text[-1:].isalnum(), len(set(ids)) / max(1, n))
    if not ids:
        return x
    tokens = np.array(ids, np.int64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    starts = np.flatnonzero(raw == 10) + 1
    starts = np.concatenate([[0], starts[starts < len(raw)]])
    at = 8
    for part in (_bag(tokens * 2654435761 >> 13, TOKENS), _bag(raw[starts] * 31 + raw[np.minimum(starts + 1, len(raw) - 1)] * 7, OPENINGS)):
        x[at : at + len(part)] = part
        at += len(part)
    x[at + (ids[0] * 2654435761 >> 7) % EDGES] = 1
    x[at + EDGES + (ids[-1] * 2654435761 >> 7) % EDGES] = 1
    return x


def fit_classifier(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 250, ridge: float = 3e-4) -> np.ndarray:
    """Weights of a softmax regression (full-batch gradient with momentum)."""
    w, v = np.zeros((x.shape[1], classes), x.dtype), np.zeros((x.shape[1], classes), x.dtype)
    one = np.eye(classes, dtype=x.dtype)[y]
    for step in range(steps):
        s = x @ w
        s -= s.max(1, keepdims=True)
        p = np.exp(s)
        p /= p.sum(1, keepdims=True)
        g = x.T @ (p - one) / len(x) + ridge * w
        v = 0.9 * v - (0.2 if step < steps * 0.7 else 0.06) * g
        w += v
    return w


def posteriors(w: np.ndarray, prior: np.ndarray, x: np.ndarray, label: np.ndarray, error: float = LABEL_ERROR, shift: np.ndarray | float = 0.0) -> np.ndarray:
    """Rows of membership: classifier times the evidence of the label (-1: none); ``shift``: the corpus's log prior over the sample's."""
    s = x @ w + shift
    s -= s.max(1, keepdims=True)
    p = np.exp(s) * (prior > 0)
    p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
    has = label >= 0
    if has.any():
        evidence = np.full((int(has.sum()), p.shape[1]), error / max(1, p.shape[1] - 1))
        evidence[np.arange(len(evidence)), label[has]] = 1 - error
        p[has] = p[has] * evidence + 1e-12 * evidence
        p[has] /= p[has].sum(1, keepdims=True)
    return p


class Mixture:
    """The fitted mixture: ``documents`` (doc_id, source, n_tokens, rate, repeats) and ``shares``."""

    def __init__(self, documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str | None = None):
        path = path or vocabulary()
        goal = sorted((r.s, float(r.t or 0.0), int(r.m if r.m is not None else 1)) for r in targets.select(normal_label(F.col("source")).alias("s"), F.col("target_share").alias("t"), F.col("max_repeats").alias("m")).where("s is not null").collect())
        self.names = names = [s for s, _, _ in goal]
        share, most = np.array([t for _, t, _ in goal]), np.array([m for _, _, m in goal], float)
        self.targets = [(s, float(a), int(m)) for s, a, m in goal]
        self.spark = documents.sparkSession
        k = len(names)
        number = F.create_map(*[F.lit(v) for i, s in enumerate(names or [""]) for v in (s, i if names else -1)])
        rows = documents.select(F.col(key).alias("doc_id"), F.coalesce(number[normal_label(F.col(source))], F.lit(-1)).alias("label"), F.col(text).alias("text"))
        kind = dict(rows.dtypes)["doc_id"]
        self.schema = f"doc_id {kind}, source string, n_tokens bigint, rate double, repeats int"
        counts = np.zeros(k)
        if k:
            for r in rows.where("label >= 0 and length(text) > 0").groupBy("label").count().collect():
                counts[r.label] = r["count"]

        def featured(batches):
            e = encoder(path)
            for b in batches:
                x = [features(t, e.encode(t)).tobytes() for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], ["label", "x"])

        w, shift = np.zeros((N_FEATURES, max(1, k))), np.zeros(max(1, k))
        if counts.any():
            quota = LABELLED_ROWS / max(1, int((counts > 0).sum()))
            part = F.create_map(*[F.lit(v) for i in range(k) for v in (i, float(quota / max(counts[i], 1.0)))])
            chance = (F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)) < part[F.col("label")]
            sample = spread(rows.where("label >= 0 and length(text) > 0").where(chance).select("label", "text")).mapInArrow(featured, "label int, x binary").limit(2 * LABELLED_ROWS).toPandas()
            y = sample["label"].to_numpy()
            if len(y):
                w = fit_classifier(np.stack([np.frombuffer(v, np.float32) for v in sample["x"]]), y, k).astype(np.float64)
                seen = np.bincount(y, minlength=k)
                shift = np.where(seen > 0, np.log(np.maximum(counts, 1e-9)) - np.log(np.maximum(seen, 1)), 0.0)
        self.weights = w
        there = counts > 0

        def member(batches):
            e = encoder(path)
            for b in batches:
                sizes, feats = [], []
                for t in b.column(2).to_pylist():
                    ids = e.encode(t or "")
                    sizes.append(len(ids))
                    feats.append(features(t or "", ids))
                x = np.stack(feats).astype(np.float64) if feats else np.zeros((0, N_FEATURES))
                p = posteriors(w, there, x, b.column(1).to_numpy(), shift=shift).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * k), pa.array(p.reshape(-1), pa.float32()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), lists], ["doc_id", "n_tokens", "p"])

        members = cut_lineage(spread(rows).mapInArrow(member, f"doc_id {kind}, n_tokens bigint, p array<float>").where("n_tokens > 0").dropDuplicates(["doc_id"])) if k else None
        self._fit(members, share, most)

    def _fit(self, members, share, most):
        names, k = self.names, len(self.names)

        def sums(width: int, of) -> np.ndarray:
            """``of(tokens, memberships)``, ``width`` numbers, summed over all documents."""

            def run(batches):
                out = np.zeros(width)
                for b in batches:
                    t = b.column(1).to_numpy().astype(float)
                    out += of(t, b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, k).astype(float))
                yield pa.RecordBatch.from_arrays([pa.array(range(width)), pa.array(out)], ["i", "v"])

            out = np.zeros(width)
            for r in members.mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
                out[r.i] = r.v
            return out

        first = sums(k + k * k, lambda t, p: np.concatenate([t @ p, ((t[:, None] * p).T @ p).reshape(-1)])) if k else np.zeros(0)
        self.mass = mass = first[:k]
        metric = first[k:].reshape(k, k)
        there = (mass >= 1) & (share > 0)
        history, start = np.zeros((0, k)), np.zeros(k)
        self.size, self.goal, self.error = 0.0, np.zeros(k), 0.0
        if there.any():
            part = np.where(there, share, 0) / share[there].sum()
            self.size = size = float((most[there] * mass[there] / part[there]).min()) * ROOM
            self.goal = goal = part * size
            start = np.where(there, np.minimum(goal / np.maximum(mass, 1e-9), most), 0.0)
            inverse = np.linalg.pinv(metric, rcond=1e-9, hermitian=True)
            while True:
                error = sums(k, lambda t, p: (t * rates(p, history, start, most)) @ p) - goal
                self.error = float(np.abs(error).max() / size)
                if self.error <= TOLERANCE or len(history) == STEPS:
                    break
                history = np.vstack([history, inverse @ error])
        self.steps, self.converged = len(history), self.error <= TOLERANCE
        if not there.any():
            self.documents = self.spark.createDataFrame([], self.schema)
            return

        def rate(batches):
            for b in batches:
                p = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, k).astype(float)
                r, s = rates(p, history, start, most), p.argmax(1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.int32()), b.column(1), pa.array(r)], ["doc_id", "s", "n_tokens", "rate"])

        kind = self.schema.split(",")[0]
        rated = members.mapInArrow(rate, f"{kind}, s int, n_tokens bigint, rate double")
        self.documents = whole_repeats(rated, self.goal, most).select("doc_id", F.element_at(F.array(*map(F.lit, names)), F.col("s") + 1).alias("source"), "n_tokens", "rate", "repeats")

    def mixture(self) -> DataFrame:
        """The documents of the mixture and how often each is taken."""
        return self.documents.where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")

    def shares(self) -> DataFrame:
        """Per source: target and reached share, tokens at hand and in the mixture, documents, greatest repeats."""
        per = self.documents.groupBy("source").agg(
            F.sum("n_tokens").alias("tokens"),
            F.count("*").alias("documents"),
            F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"),
            F.max("repeats").alias("most_repeats"),
        )
        goal = self.spark.createDataFrame(self.targets, "source string, target_share double, max_repeats int")
        joined = goal.join(F.broadcast(per), "source", "left")
        total = per.agg(F.sum("mixed_tokens").alias("all"))
        return joined.crossJoin(F.broadcast(total)).select(
            "source",
            "target_share",
            "max_repeats",
            *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "tokens", "mixed_tokens", "most_repeats")),
            F.coalesce(F.round(F.col("mixed_tokens") / F.col("all"), 6), F.lit(0.0)).alias("reached_share"),
            F.lit(bool(self.converged)).alias("converged"),
        )


def whole_repeats(rated: DataFrame, goal: np.ndarray, most: np.ndarray, rounds: int = ROUNDS) -> DataFrame:
    """``rated`` (doc_id, s, n_tokens, rate) with whole ``repeats`` whose tokens come to the goal of each source."""
    per = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("s") + 1)
    top = per([int(m) for m in most], "int")
    chance = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    whole = F.floor("rate").cast("int") + (chance < F.col("rate") - F.floor("rate")).cast("int")
    rows = cut_lineage(rated.withColumn("repeats", F.least(whole, top)))
    for n in range(rounds):
        taken = np.zeros(len(goal))
        for r in rows.groupBy("s").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("t")).collect():
            taken[r.s] = r.t
        rest = goal - taken
        if np.abs(rest).max() <= TOLERANCE * max(1.0, goal.sum()):
            break
        left = per([float(x) for x in rest], "double")
        can = F.when(left > 0, F.col("repeats") < top).otherwise(F.col("repeats") > 0)
        # Documents that fit into the rest; where there is none, one that is less than twice as long still brings it nearer.
        fits, near = can & (F.col("n_tokens") <= F.abs(left)), can & (F.col("n_tokens") > F.abs(left)) & (F.col("n_tokens") < 2 * F.abs(left))
        bucket = F.pmod(F.xxhash64("doc_id", F.lit(n)), F.lit(BUCKETS)).cast("int")
        sums = np.zeros((2, len(goal), BUCKETS))
        for r in rows.where(fits | near).groupBy("s", near.cast("int").alias("w"), bucket.alias("b")).agg(F.sum("n_tokens").alias("t")).collect():
            sums[r.w, r.s, r.b] = r.t
        cuts, single = [], []
        for s in range(len(goal)):
            cuts.append(int((np.cumsum(sums[0, s]) <= abs(rest[s])).sum()))
            alone = np.flatnonzero((sums[1, s] > 0) & (sums[1, s] < 2 * abs(rest[s])))
            single.append(int(alone[0]) if len(alone) and not sums[0, s].any() else -1)
        chosen = fits & (bucket < per(cuts, "int")) | near & (bucket == per(single, "int"))
        step = F.when(chosen, F.when(left > 0, 1).otherwise(-1)).otherwise(0)
        rows = rows.withColumn("repeats", (F.col("repeats") + step).cast("int"))
        if n % 3 == 2:
            rows = cut_lineage(rows)
    return rows


def rates(p: np.ndarray, history: np.ndarray, start: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Rates of documents with memberships ``p``: the start, moved by each step and cut to what is allowed."""
    top = most[p.argmax(1)]
    r = np.clip(p @ start, 0, top)
    for step in history:
        r = np.clip(r - p @ step, 0, top)
    return r
