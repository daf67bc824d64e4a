"""Source files that do not parse.

Method: each file is parsed by every supported grammar, in the order of a token-based language ranking.  The grammar of
its extension decides; where that one fails, a foreign success tells a wrong extension, and universal failure a corrupted
file (truncated, with merge conflict marks, or otherwise).

Defined cases
-------------
* Only rows of type File with one of the extensions of ``grammars.GRAMMARS`` are judged; others give no row.
* A null content can't be judged and gives no row.  An empty text is a valid module, but no JSON value.
* Repeated rows of an entity_id give one row.  Very long texts are parsed whole.  Empty tables give empty results.
* Neither nesting nor the length of numbers makes a JavaScript, TypeScript or JSON text invalid; Python is what its own
  parser accepts.  Other columns aren't read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.source.grammars import GRAMMARS, judge
from quarryline.session import spread

_EXTENSION = r"\.(" + "|".join(GRAMMARS) + r")$"


def repository_of(entity_id: str | Column = "entity_id") -> Column:
    """The repository named in an id ``repo:<repository>:<path>``."""
    return F.split_part(F.col(entity_id) if isinstance(entity_id, str) else entity_id, F.lit(":"), F.lit(2))


def judge_files(results: DataFrame) -> DataFrame:
    """One row per judged file: entity_id, repository, extension, valid, parsed_as, cause."""
    files = results.where((F.col("entity_type") == "File") & F.lower("file_path").rlike(_EXTENSION) & F.col("content").isNotNull())
    rows = files.select("entity_id", "file_path", "content")
    names = ["entity_id", "extension", "valid", "parsed_as", "cause"]

    def run(batches):
        for b in batches:
            out = [judge(p, t.as_py()) for p, t in zip(b.column(1).to_pylist(), b.column(2))]
            cols = [b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out]), pa.array([x[2] for x in out], pa.string()), pa.array([x[3] for x in out], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names)

    judged = spread(rows).mapInArrow(run, "entity_id string, extension string, valid boolean, parsed_as string, cause string")
    return judged.distinct().withColumn("repository", repository_of())


def broken_files(results: DataFrame) -> DataFrame:
    return judge_files(results).where(~F.col("valid")).select("entity_id").distinct()


_FAMILY = {"python": "python", "javascript": "javascript", "jsx": "javascript", "typescript": "typescript", "tsx": "typescript", "json": "json"}


def latest_repositories(repositories: DataFrame) -> DataFrame:
    """One row per name: the snapshot with the latest last_updated."""
    w = Window.partitionBy("name").orderBy(F.col("last_updated").desc_nulls_last(), F.col("commit_hash").asc_nulls_last())
    return repositories.where(F.col("name").isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def failure_rates(results: DataFrame, repositories: DataFrame) -> DataFrame:
    """Files and failures per repository and language; ``listed`` tells whether RepositoryInfo.languages names it."""
    family = F.create_map(*[F.lit(x) for kv in _FAMILY.items() for x in kv])
    per = (
        judge_files(results)
        .withColumn("language", family[F.col("extension")])
        .groupBy("repository", "language")
        .agg(
            F.count("*").alias("files"),
            F.sum((~F.col("valid")).cast("bigint")).alias("broken"),
            F.sum((F.col("cause") == "wrong_extension").cast("bigint")).alias("wrong_extension"),
        )
    )
    names = {"js": "javascript", "node": "javascript", "ts": "typescript", "py": "python", "python3": "python"}
    alias = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    clean = F.transform(F.coalesce("languages", F.array().cast("array<string>")), lambda x: F.coalesce(alias[F.lower(F.trim(x))], F.lower(F.trim(x))))
    listed = latest_repositories(repositories).select(F.col("name").alias("repository"), clean.alias("_languages"))
    return per.join(listed, "repository", "left").select(
        "repository",
        "language",
        "files",
        "broken",
        F.coalesce("wrong_extension", F.lit(0)).alias("wrong_extension"),
        F.round(F.col("broken") / F.col("files"), 6).alias("rate"),
        F.coalesce(F.array_contains("_languages", F.col("language")), F.lit(False)).alias("listed"),
    )
