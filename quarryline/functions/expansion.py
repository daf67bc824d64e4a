"""Query expansion: synonyms, framework terms, abbreviations and case variants of questions, as a join with a dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.code_text import camel_to_snake, snake_to_camel
from quarryline.functions.fixed_values import ABBREVIATIONS, FRAMEWORK_TERMS, SYNONYMS


def dictionary(framework: str | None = None) -> list[tuple[int, str, str, bool]]:
    """(rank, term, replacement, whether the term must stand as a whole word), in the order variants come."""
    rows = [(t, x, False) for t, xs in SYNONYMS.items() for x in xs[:3]]
    rows += [(t, x, False) for t, xs in FRAMEWORK_TERMS.get((framework or "").lower(), {}).items() for x in xs[:2]]
    rows += [(t, x, True) for t, x in ABBREVIATIONS.items()]
    return [(n, *row) for n, row in enumerate(rows)]


def expand(questions: DataFrame, key: str, text: str, framework: str | None = None, most: int = 5) -> DataFrame:
    """(key, pos, variant): the question, then synonyms, framework terms, abbreviations and case variants of its words.

    Variants come in the dictionary's order and the words' order, each text once, at most ``most`` in all.
    """
    words = questions.sparkSession.createDataFrame(dictionary(framework), "rank int, term string, replacement string, whole boolean")
    q = questions.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(text).alias("_q"), F.lower(text).alias("_l")).distinct()
    hit = F.when(F.col("whole"), F.array_contains(F.split("_l", r"\s+"), F.col("term"))).otherwise(F.contains("_l", F.col("term")))
    replaced = q.join(F.broadcast(words), hit).select("_k", "_q", F.col("rank").cast("long").alias("_rank"), F.replace("_l", F.col("term"), F.col("replacement")).alias("_v"))
    cased = q.select("_k", "_q", F.posexplode(F.regexp_extract_all("_q", F.lit(r"(?U)\b\w{3,}\b"), 0)).alias("_i", "_w"))
    w = F.col("_w")
    forms = F.array(F.when(w.rlike("[a-z][A-Z]"), camel_to_snake(w)), F.when(w.contains("_"), snake_to_camel(w)))
    cased = cased.select("_k", "_q", "_i", "_w", F.posexplode(forms).alias("_j", "_form")).where("_form is not null")
    cased = cased.select("_k", "_q", (F.lit(1_000_000) + F.col("_i") * 2 + F.col("_j")).cast("long").alias("_rank"), F.replace("_q", F.col("_w"), F.col("_form")).alias("_v"))
    own = q.select("_k", "_q", F.lit(-1).cast("long").alias("_rank"), F.col("_q").alias("_v"))
    first = own.unionByName(replaced).unionByName(cased).groupBy("_k", "_q", "_v").agg(F.min("_rank").alias("_rank"))
    order = Window.partitionBy("_k", "_q").orderBy("_rank")
    return first.withColumn("pos", F.row_number().over(order) - 1).where(F.col("pos") < most).select(F.col("_k").alias(key), "pos", F.col("_v").alias("variant"))
