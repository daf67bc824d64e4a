"""The answering loop: collect context, grep, graph, rerank, judge, rewrite; models are pluggable callables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.code_text import IDENTIFIER_STOPWORDS
from quarryline.operators import lines, retrieval

CONTEXT = "id string, name string, type string, file string, code string, score double, source string"


@dataclass
class Models:
    """What a deployment plugs in; the defaults are deterministic and need no network."""

    judge: Callable[[str, list], tuple[float, str]] = lambda q, rows: (min(1.0, len(rows) / 20), "more context")
    rewrite: Callable[[str, str], str] = lambda q, feedback: q
    answer: Callable[[str, list], str] = lambda q, rows: "\n".join(f"{r.file}: {r.name}" for r in rows[:10])


@dataclass
class Trace:
    iterations: int = 0
    scores: list[float] = field(default_factory=list)
    queries: list[str] = field(default_factory=list)
    answer: str = ""


def question_identifiers(question: str, most: int = 5) -> list[str]:
    import re

    from quarryline.functions.code_text import CAMEL, CONSTANT, SNAKE

    found: dict[str, None] = {}
    for p in (SNAKE, CAMEL, CONSTANT):
        for m in re.finditer(p, question):
            if len(m.group()) >= 4 and m.group().lower() not in IDENTIFIER_STOPWORDS and len(found) < most:
                found.setdefault(m.group())
    return sorted(found)


def collect_context(chunks: DataFrame, question: str, top: int = 40) -> DataFrame:
    """Primary chunks by BM25; chunks: id, name, type, file, code."""
    q = chunks.sparkSession.createDataFrame([(0, question)], "query_id int, query string")
    scores = retrieval.bm25(chunks, "id", "code", q)
    best = retrieval.top_k(scores, "id", "bm25", top)
    return chunks.join(F.broadcast(best.select("id", F.col("bm25").alias("score"))), "id").select("id", "name", "type", "file", F.substring("code", 1, 2000).alias("code"), "score", F.lit("primary").alias("source"))


def grep_context(chunks: DataFrame, question: str, total: int = 40, around: int = 10) -> DataFrame:
    found = question_identifiers(question)
    if not found:
        return chunks.sparkSession.createDataFrame([], CONTEXT)
    hits = lines.first_token_per_line(lines.cap_per_file(lines.grep(chunks, "id", "code", found), "id", 10), "id")
    rows = lines.with_context(chunks.select("id", "code", "name", "type", "file"), "id", "code", lines.diversify(hits, "id", total), around)
    meta = chunks.select("id", "name", "type", "file")
    return rows.join(meta, "id").select("id", "name", "type", "file", F.col("context").alias("code"), F.lit(0.95).alias("score"), F.lit("grep").alias("source"))


def answer(chunks: DataFrame, question: str, models: Models | None = None, most: int = 3, enough: float = 0.6, plateau: float = 0.05) -> Trace:
    """Runs the loop until the score is enough, gains stay under the plateau twice, or ``most`` iterations are done.

    At most 100 rows of context come to the driver in an iteration.
    """
    models, trace, query, flat = models or Models(), Trace(), question, 0
    rows: list = []
    while trace.iterations < most:
        trace.iterations += 1
        trace.queries.append(query)
        context = collect_context(chunks, query).unionByName(grep_context(chunks, query))
        first = retrieval.first_seen(context, ["id", "source"], [F.col("score").desc(), F.col("code")])
        rows = first.withColumn("_s", retrieval.overlap_score(F.lit(question), F.col("code"))).orderBy(F.col("_s").desc(), "source", "id").limit(100).collect()
        score, feedback = models.judge(question, rows)
        gain = score - trace.scores[-1] if trace.scores else score
        trace.scores.append(score)
        flat = flat + 1 if gain < plateau else 0
        if score >= enough or flat >= 2:
            break
        query = models.rewrite(query, feedback) or query
    trace.answer = models.answer(question, rows)
    return trace
