"""Text as lines: literal grep, context windows, slices, per-file caps, diversification and sub-chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def line_table(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): one row a line, numbered from 1, lines ending at a line feed."""
    return texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("_p", "line")).select(key, (F.col("_p") + 1).alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"))


def grep(texts: DataFrame, key: str, text: str, tokens: list[str]) -> DataFrame:
    """(key, token, line_no, line) of the lines that hold a token literally; texts without any token aren't split."""
    any_token = F.lit(False)
    for t in tokens:
        any_token = any_token | F.col(text).contains(t)
    hits = F.filter(F.array(*[F.struct(F.lit(n).alias("pos"), F.lit(t).alias("token")) for n, t in enumerate(tokens)]), lambda t: F.contains(F.col("line"), t["token"]))
    lines = line_table(texts.where(any_token), key, text)
    return lines.select(key, "line_no", "line", F.explode(hits).alias("t")).select(key, F.col("t.pos").alias("token_pos"), F.col("t.token").alias("token"), "line_no", "line")


def first_token_per_line(hits: DataFrame, key: str) -> DataFrame:
    """Of several tokens on one line the first one."""
    return hits.groupBy(key, "line_no").agg(F.min_by(F.struct("token", "line", "token_pos"), "token_pos").alias("h")).select(key, "line_no", "h.*")


def cap_per_file(hits: DataFrame, key: str, most: int) -> DataFrame:
    """The first ``most`` lines of each token and file."""
    w = Window.partitionBy("token", key).orderBy("line_no")
    return hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def diversify(hits: DataFrame, key: str, total: int) -> DataFrame:
    """Round robin over files up to ``total`` hits; a file has at most max(1, ceil(total / sqrt(files))) turns."""
    w = Window.partitionBy(key).orderBy("line_no", "token")
    slotted = hits.withColumn("slot", F.row_number().over(w))
    files = hits.agg(F.count_distinct(key).alias("_files"))
    quota = F.greatest(F.lit(1), F.ceil(F.lit(total) / F.sqrt(F.greatest(F.col("_files"), F.lit(1)))))
    return slotted.crossJoin(F.broadcast(files)).where(F.col("slot") <= quota).orderBy("slot", key).limit(total).drop("_files")


def with_context(texts: DataFrame, key: str, text: str, hits: DataFrame, around: int = 10) -> DataFrame:
    """Hits with the lines from ``around`` before to ``around`` after them, cut from the text by its array of lines."""
    joined = hits.join(texts.select(key, F.split(text, "\n").alias("_lines")), key)
    start = F.greatest(F.lit(1), F.col("line_no") - around)
    window = F.slice("_lines", start, F.col("line_no") + around - start + 1)
    return joined.withColumn("context", F.array_join(window, "\n")).drop("_lines")


def slice_lines(text, start, end):
    """Column: lines start..end of a text, from 1 and inclusive; an end under 1 or beyond the text is its end."""
    lines = F.split(text, "\n")
    first = F.greatest(F.lit(1), start)
    last = F.when((end <= 0) | (end > F.size(lines)), F.size(lines)).otherwise(end)
    return F.when(first > last, "").otherwise(F.array_join(F.slice(lines, first, F.greatest(F.lit(0), last - first + 1)), "\n"))


def sub_chunks(rows: DataFrame, key: str, text: str, limit: int = 32_000, window: int = 8_000, overlap: int = 1_000) -> DataFrame:
    """(key, part, parts, chunk_id, chunk): one chunk up to ``limit`` characters, else windows that overlap."""
    step = window - overlap
    n = F.length(text)
    parts = F.when(n <= limit, 1).otherwise(F.ceil((n - overlap) / step)).cast("int")
    out = rows.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_t"), parts.alias("parts")).select(key, "_t", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    piece = F.when(F.col("parts") == 1, F.col("_t")).otherwise(F.substr(F.col("_t"), F.col("part") * step + 1, F.lit(window)))
    name = F.when(F.col("parts") == 1, F.col(key).cast("string")).otherwise(F.concat(F.col(key).cast("string"), F.lit("#part"), F.col("part").cast("string")))
    return out.select(key, "part", "parts", name.alias("chunk_id"), piece.alias("chunk"))
