"""Python tracebacks in text, and their frames matched to files and functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.code_text import trace_path

FRAME = r'File "([^"]+)", line (\d+), in (\w+)'
EXCEPTION = r"^([\w.]+):\s*(.*)$"
BARE_EXCEPTION = r"^([\w.]+)$"


def parse_tracebacks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, frames array<struct>, exception_type, exception_message): frames with the four-blank code line below.

    The exception is that of the last line that has the form; a bare type needs a dot.
    """
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", ""), "\n"), lambda line: F.regexp_replace(line, "\r$", ""))
    base = rows.select(key, lines.alias("_l"))
    frames = F.filter(
        F.transform(
            "_l",
            lambda line, i: F.when(
                line.rlike(FRAME),
                F.struct(
                    F.regexp_extract(line, FRAME, 1).alias("file_path"),
                    F.regexp_extract(line, FRAME, 2).cast("int").alias("line_number"),
                    F.regexp_extract(line, FRAME, 3).alias("function_name"),
                    F.when(F.get("_l", i + 1).rlike(r"^\s{4}.+") & ~F.get("_l", i + 1).rlike(FRAME), F.trim(F.get("_l", i + 1))).otherwise("").alias("code_line"),
                ),
            ),
        ),
        lambda f: f.isNotNull(),
    )
    plain = F.filter("_l", lambda x: (x != "") & ~x.startswith(" ") & ~x.rlike(FRAME))
    typed = F.filter(plain, lambda x: x.rlike(EXCEPTION) | (x.rlike(BARE_EXCEPTION) & x.contains(".")))
    message = F.filter(plain, lambda x: x.rlike(EXCEPTION))
    last = F.when(F.size(typed) > 0, F.try_element_at(typed, F.lit(-1)))
    last_message = F.when(F.size(message) > 0, F.try_element_at(message, F.lit(-1)))
    return base.select(
        key,
        frames.alias("frames"),
        F.coalesce(F.regexp_extract(last, r"^([\w.]+)", 1), F.lit("")).alias("exception_type"),
        F.coalesce(F.regexp_extract(last_message, EXCEPTION, 2), F.lit("")).alias("exception_message"),
    )


def valid(parsed: DataFrame) -> DataFrame:
    return parsed.where((F.size("frames") > 0) & (F.col("exception_type") != ""))


def match_frames(frames: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, pos, file_id): each frame (key, pos, file_path) with the first file (id, path) whose path ends like it.

    The suffixes of every file path up to three parts become the keys of an equality join.
    """
    parts = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.size(parts))), lambda n: F.array_join(F.slice(parts, -n, n), "/"))
    by_suffix = files.select(F.col("id").alias("file_id"), F.explode(suffixes).alias("_suffix"))
    hit = frames.withColumn("_suffix", trace_path(F.col("file_path"))).join(by_suffix, "_suffix")
    w = Window.partitionBy(key, "pos").orderBy("file_id")
    return hit.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, "pos", "file_id")


def match_functions(frames: DataFrame, nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``frames`` (key, pos, file_id, function_name) with ``entity_id``: the function of that name in the file, else the
    method of a class in it; the first by id."""
    inside = edges.where("type = 'CONTAINS'").select("src", "dst")
    named = nodes.where(F.col("type").isin("Function", "Method")).select(F.col("id").alias("dst"), F.col("name").alias("function_name"))
    direct = inside.join(named, "dst").select(F.col("src").alias("file_id"), "function_name", F.col("dst").alias("entity_id"), F.lit(0).alias("_level"))
    classes = nodes.where(F.col("type").isin("Class", "Model")).select(F.col("id").alias("_c"))
    owners = inside.join(classes, F.col("dst") == F.col("_c")).select(F.col("src").alias("file_id"), "_c")
    methods = direct.select(F.col("file_id").alias("_c"), "function_name", "entity_id").join(owners, "_c").select("file_id", "function_name", "entity_id", F.lit(1).alias("_level"))
    best = direct.unionByName(methods).groupBy("file_id", "function_name").agg(F.min(F.struct("_level", "entity_id")).alias("_b"))
    return frames.join(best.select("file_id", "function_name", F.col("_b.entity_id").alias("entity_id")), ["file_id", "function_name"], "left")
