"""Structured Streaming: log ingest without repeats, usage in event-time windows, and re-index triggers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100, glob: str = "*.parquet") -> DataFrame:
    """Rows of parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(path)


def deduplicated(events: DataFrame, keys: list[str], at: str, lateness: str = "1 hour") -> DataFrame:
    """Events once each: state is kept for the allowed lateness only."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def windowed_usage(events: DataFrame, at: str, group: str, value: str, width: str = "1 day", lateness: str | None = "1 hour") -> DataFrame:
    """Counts and sums per tumbling window and group; late rows beyond the watermark are left out.

    lateness is None where the events have their watermark already.
    """
    marked = events if lateness is None else events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)
    agg = marked.groupBy(F.window(at, width), group).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return agg.select(F.col("window.start").alias("start"), group, "n", "total")


def sessions(events: DataFrame, at: str, user: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: runs of events without a silence of ``gap``."""
    marked = events.withColumn(at, F.col(at).cast("timestamp"))
    return marked.groupBy(F.session_window(at, gap), user).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_once(stream: DataFrame, folder: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Everything at hand into a parquet table in ``folder``, as a scheduled job does; the table.

    Results of mode "complete" or "update" are kept as the rows of the last batch, or with ``keys`` as the last of each.
    """
    table, checkpoint = f"{folder}/table", f"{folder}/checkpoint"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return stream.sparkSession.read.schema(stream.schema).parquet(table)

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("append").parquet(table)

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(table)
    if keys:
        return rows.groupBy(*keys).agg(*(F.max_by(c, "_batch").alias(c) for c in stream.columns if c not in keys)).select(stream.columns)
    return rows.join(F.broadcast(rows.agg(F.max("_batch").alias("_batch"))), "_batch").select(stream.columns)


def named_repositories(triggers: DataFrame, known: DataFrame) -> DataFrame:
    """(url, event, repository): push events matched to known repositories (name), by the last part of the URL, else by a name in it."""
    last = F.lower(F.regexp_replace(F.element_at(F.split(F.regexp_replace("url", "/+$", ""), "/"), -1), r"\.git$", ""))
    names = known.select(F.col("name").alias("_n"), F.lower("name").alias("_l")).distinct()
    t = triggers.withColumn("_last", last)
    exact = t.join(F.broadcast(names), F.col("_last") == F.col("_l"), "left")
    # A name that is part of the other: the list of repositories is small and bounded by what is configured.
    part = exact.where("_n is null").drop("_n", "_l").join(F.broadcast(names.limit(100_000)), F.contains(F.col("_last"), F.col("_l")) | F.contains(F.col("_l"), F.col("_last")))
    best = part.groupBy("url", "event").agg(F.min_by("_n", F.struct(-F.length("_n"), "_n")).alias("repository"))
    return exact.where("_n is not null").select("url", "event", F.col("_n").alias("repository")).unionByName(best.select("url", "event", "repository"))


def due(state: DataFrame, now, hours: float = 24.0) -> DataFrame:
    """(name, reason): repositories a scheduled check rebuilds: another commit, never indexed, or indexed too long ago."""
    old = F.col("indexed_at") < F.lit(now) - F.make_dt_interval(hours=F.lit(int(hours)))
    reason = F.when(F.col("indexed_at").isNull(), "new").when(~F.col("commit_hash").eqNullSafe(F.col("indexed_hash")), "changed").when(old, "old")
    return state.select("name", reason.alias("reason")).where("reason is not null")


def on_trigger(triggers: DataFrame, rebuild: Callable[[list[str]], None], checkpoint: str) -> StreamingQuery:
    """Calls ``rebuild`` with the distinct repositories of each batch of push events (a bounded list of names)."""

    def each(batch: DataFrame, _: int) -> None:
        names = sorted(r.repository for r in batch.where(F.col("event").isin("push", "merge", "release")).select("repository").distinct().limit(10_000).collect())
        if names:
            rebuild(names)

    return triggers.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
