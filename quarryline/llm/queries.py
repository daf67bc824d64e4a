"""Registered queries of the text problems."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from quarryline.llm import broken_files, doc_pairs, handwritten, mixing, pair_defects, personal, secrets, shared_spans, tokenizer
from quarryline.session import table


def p1_found(spark, d):
    return pair_defects.pair_defects(table(spark, d, "chat_logs"))


def p1_report(spark, d):
    """Pairs and defects by question type and month."""
    logs = table(spark, d, "chat_logs")
    kinds = logs.select("id", F.coalesce("question_type", F.lit("none")).alias("question_type"), F.date_format("created_at", "yyyy-MM").alias("month")).groupBy("id").agg(F.min("question_type").alias("question_type"), F.min("month").alias("month"))
    found = kinds.join(pair_defects.pair_defects(logs), "id", "left")
    return found.groupBy("question_type", "month").agg(F.count("*").alias("pairs"), F.count("defect").alias("broken"), *(F.sum((F.col("defect") == x).cast("bigint")).alias(x) for x in pair_defects.DEFECTS)).fillna(0, list(pair_defects.DEFECTS))


def p3_found(spark, d):
    return broken_files.broken_files(table(spark, d, "search_results"))


def p3_rates(spark, d):
    return broken_files.failure_rates(table(spark, d, "search_results"), table(spark, d, "repositories"))


def p4_found(spark, d):
    return handwritten.not_handwritten(table(spark, d, "search_results"))


def p4_report(spark, d):
    return handwritten.origin_report(table(spark, d, "search_results"), table(spark, d, "repositories"))


_PERSONAL = (("chat_logs", "id", "question"), ("tracebacks", "traceback_id", "raw_text"))
#: The key of the pseudonyms; a deployment sets its own.
PSEUDONYM_KEY = os.environ.get("QUARRYLINE_PSEUDONYM_KEY", "development key").encode()


def p5_found(spark, d):
    names = personal.known_first_names(table(spark, d, "users"))
    parts = [personal.personal_kinds(table(spark, d, t), key, text, names).select(F.lit(t).alias("source_table"), "record_id", "kind") for t, key, text in _PERSONAL]
    return parts[0].unionByName(parts[1])


def p5_masked(spark, d):
    names = personal.known_first_names(table(spark, d, "users"))
    parts = [personal.masked_texts(table(spark, d, t), key, text, names, PSEUDONYM_KEY).select(F.lit(t).alias("source_table"), "record_id", "text") for t, key, text in _PERSONAL]
    return parts[0].unionByName(parts[1])


def p6_found(spark, d):
    return secrets.secret_lines(table(spark, d, "search_results")).select("entity_id", "line_no").distinct()


def p6_redacted(spark, d):
    return secrets.redacted(table(spark, d, "search_results"))


def p7_found(spark, d):
    return doc_pairs.documented_functions(table(spark, d, "search_results"), strict=True).select("entity_id", "line_no").distinct()


def p7_pairs(spark, d):
    return doc_pairs.documented_functions(table(spark, d, "search_results"))


def p8_ids(spark, d):
    return tokenizer.encode_corpus(table(spark, d, "documents"))


def _mixture(spark, d):
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_mixture(spark, d):
    return _mixture(spark, d).mixture()


def p9_shares(spark, d):
    return _mixture(spark, d).shares()


def p9_bounds(spark, d):
    """Per source of the targets: whether no document is repeated too often, and whether the share is within two points
    of the target (of the sources that have documents, in proportion); a long document of the smallest data is one alone."""
    shares = _mixture(spark, d).shares()
    there = shares.where("documents > 0").agg(F.sum("target_share").alias("all"))
    near = F.abs(F.col("reached_share") - F.col("target_share") / F.col("all")) <= 0.02
    return shares.crossJoin(F.broadcast(there)).select("source", (F.col("most_repeats") <= F.col("max_repeats")).alias("capped"), F.when(F.col("documents") > 0, near).otherwise(F.col("reached_share") == 0).alias("on_target"))


def p10_found(spark, d):
    return shared_spans.SharedSpans(table(spark, d, "documents")).document_pairs()


def p10_portions(spark, d):
    return shared_spans.SharedSpans(table(spark, d, "documents")).portions()


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p3_found": p3_found, "p3_rates": p3_rates, "p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found, "p5_masked": p5_masked, "p6_found": p6_found, "p6_redacted": p6_redacted, "p7_found": p7_found, "p7_pairs": p7_pairs, "p8_ids": p8_ids, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_bounds": p9_bounds, "p10_found": p10_found, "p10_portions": p10_portions}
ORACLES: dict[str, str] = {"p9_bounds": "SELECT source, true AS capped, true AS on_target FROM mix_targets"}
