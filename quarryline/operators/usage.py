"""Usage logs: statistics, history, user upserts, caches and re-index states."""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delivered_once(logs: DataFrame, key: str = "id", by: str = "ingested_at") -> DataFrame:
    """One row a key: the first delivery."""
    w = Window.partitionBy(key).orderBy(F.col(by).asc_nulls_last())
    return logs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def usage_stats(logs: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Requests, successes, mean milliseconds (truncated), success rate in percent and distinct users."""
    ok = F.sum((F.col("success") == 1).cast("bigint"))
    n = F.count("*")
    aggs = [
        n.alias("requests"),
        F.coalesce(ok, F.lit(0)).alias("successes"),
        F.coalesce(F.floor(F.avg("response_time_ms")), F.lit(0)).cast("bigint").alias("avg_ms"),
        F.when(n > 0, F.round(F.coalesce(ok, F.lit(0)) * 100.0 / n, 4)).otherwise(0.0).alias("success_rate"),
        F.count_distinct("user_id").alias("users"),
    ]
    return logs.groupBy(*group).agg(*aggs) if group else logs.agg(*aggs)


def in_window(logs: DataFrame, at: str, as_of: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` before ``as_of``."""
    return logs.where((F.col(at) > as_of - F.expr(f"INTERVAL {days} DAYS")) & (F.col(at) <= as_of))


def history(logs: DataFrame, user_id: int, question_type: str | None = None, limit: int = 50) -> DataFrame:
    rows = logs.where(F.col("user_id") == user_id)
    rows = rows if question_type is None else rows.where(F.col("question_type") == question_type)
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def latest_per_user(logs: DataFrame, each: int) -> DataFrame:
    """The last ``each`` interactions of every user."""
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return logs.where(F.col("user_id").isNotNull()).withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= each)


def upsert_users(users: DataFrame, seen: DataFrame) -> DataFrame:
    """Users after interactions (user_id, username, seen_at): known ones get the time and a missing name, new ones a row."""
    last = seen.groupBy("user_id").agg(F.max("seen_at").alias("_seen"), F.max_by("username", "seen_at").alias("_name"), F.min("seen_at").alias("_first"))
    both = users.join(last, "user_id", "full")
    return both.select(
        "user_id",
        F.coalesce("username", "_name").alias("username"),
        F.coalesce("created_at", "_first").alias("created_at"),
        F.greatest("last_seen_at", "_seen").alias("last_seen_at"),
    )


def needs_reindex(current: DataFrame, state: DataFrame) -> DataFrame:
    """(name, commit_hash, reason) of repositories never indexed or with another hash than the indexed one."""
    joined = current.select("name", "commit_hash").join(state.select("name", F.col("commit_hash").alias("_old"), F.lit(True).alias("_known")), "name", "left")
    reason = F.when(F.col("_known").isNull(), "new").when(~F.col("commit_hash").eqNullSafe(F.col("_old")), "changed")
    return joined.select("name", "commit_hash", reason.alias("reason")).where("reason is not null")


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two snapshots (path, hash): added, removed or modified."""
    a, b = old.select("path", F.col("hash").alias("_a")), new.select("path", F.col("hash").alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "modified")
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change is not null")


def cache_hits(events: DataFrame, key: str, at: str, ttl_seconds: int) -> DataFrame:
    """(key, event_id, hit): each access of a key is a hit if the miss that filled its entry is younger than the ttl.

    Accesses are cut into runs at silences of at least the time to live, where every entry has expired; runs are
    co-partitioned, sorted and scanned in one pass that holds one fill time, so no group is collected.
    """
    ttl = ttl_seconds * 1_000_000
    items = events.select(F.col(key).cast("string").alias("k"), "event_id", F.unix_micros(F.col(at).cast("timestamp")).alias("t"))
    order = Window.partitionBy("k").orderBy("t", "event_id")
    gap = F.coalesce((F.col("t") - F.lag("t").over(order) >= ttl).cast("int"), F.lit(1))
    runs = items.withColumn("_g", gap).withColumn("run", F.sum("_g").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ready = runs.select("k", "run", "t", "event_id").repartition("k", "run").sortWithinPartitions("k", "run", "t", "event_id")

    def scan(batches):
        last, filled = None, 0
        for b in batches:
            hits = []
            for k, run, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                hit = (k, run) == last and t - filled < ttl
                if not hit:
                    last, filled = (k, run), t
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(hits, pa.bool_())], ["k", "event_id", "hit"])

    out = ready.mapInArrow(scan, "k string, event_id bigint, hit boolean")
    return out.select(F.col("k").cast(dict(events.dtypes)[key]).alias(key), "event_id", "hit")


def live_entries(cache: DataFrame, now: datetime | Column, expires: str = "expires_at") -> DataFrame:
    return cache.where(F.col(expires) > (F.lit(now) if isinstance(now, datetime) else now))


def least_recently_used(cache: DataFrame, at: str, capacity: int) -> DataFrame:
    """The entries that stay when the least recently used ones beyond the capacity are dropped."""
    return cache.orderBy(F.col(at).desc(), "key").limit(capacity)
