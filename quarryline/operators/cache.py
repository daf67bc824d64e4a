"""Caches as tables: entries with a namespace, a lifetime and a repository, so that they can be invalidated by one.

An entry is (key, namespace, repository, value, created_at, expires_at, last_used_at); a key is ``namespace:md5``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators import retrieval

#: Lifetimes of the namespaces in seconds.
LIFETIMES = {"query": 24 * 3600, "tool": 3600, "llm": 3600}


def cache_key(namespace: str, text: Column) -> Column:
    return F.concat(F.lit(f"{namespace}:"), F.md5(text))


def entries(rows: DataFrame, namespace: str, text: str, value: str, at: str, repository: str | None = None) -> DataFrame:
    """Entries made of rows: the text they are asked by, the value they give, when they were made."""
    end = F.col(at).cast("timestamp") + F.make_dt_interval(secs=F.lit(LIFETIMES[namespace]))
    repo = F.col(repository) if repository else F.lit(None).cast("string")
    return rows.where(F.col(text).isNotNull()).select(cache_key(namespace, F.col(text)).alias("key"), F.lit(namespace).alias("namespace"), repo.alias("repository"), F.col(value).alias("value"), F.col(at).cast("timestamp").alias("created_at"), end.alias("expires_at"), F.col(at).cast("timestamp").alias("last_used_at"))


def put(cache: DataFrame, new: DataFrame, capacity: int | None = None) -> DataFrame:
    """The cache with new entries, the latest of each key; beyond ``capacity`` the least recently used of a namespace go."""
    w = Window.partitionBy("key").orderBy(F.col("created_at").desc(), F.col("value"))
    latest = cache.unionByName(new).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    if capacity is None:
        return latest
    order = Window.partitionBy("namespace").orderBy(F.col("last_used_at").desc(), "key")
    return latest.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= capacity).drop("_r")


def get(cache: DataFrame, asked: DataFrame, namespace: str, text: str, now: datetime | Column) -> DataFrame:
    """``asked`` with ``value`` and ``hit``: the live entry of each text."""
    at = F.lit(now) if isinstance(now, datetime) else now
    live = cache.where((F.col("namespace") == namespace) & (F.col("expires_at") > at)).select(F.col("key").alias("_key"), "value")
    return asked.withColumn("_key", cache_key(namespace, F.col(text))).join(live, "_key", "left").withColumn("hit", F.col("value").isNotNull()).drop("_key")


def drop(cache: DataFrame, keys: DataFrame | None = None, repository: str | None = None, namespace: str | None = None) -> DataFrame:
    """The cache without the given keys, or without the entries of a repository or a namespace."""
    if keys is not None:
        cache = cache.join(keys.select("key").distinct(), "key", "left_anti")
    if repository is not None:
        cache = cache.where(~F.col("repository").eqNullSafe(F.lit(repository)))
    return cache if namespace is None else cache.where(F.col("namespace") != namespace)


def hit_rate(asked: DataFrame, by: str | None = None) -> DataFrame:
    """Requests, hits and their share, of all or by a column."""
    agg = [F.count("*").alias("requests"), F.sum(F.col("hit").cast("bigint")).alias("hits"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("rate")]
    return asked.groupBy(by).agg(*agg) if by else asked.agg(*agg)


def similar(cache: DataFrame, asked: DataFrame, now: datetime | Column, threshold: float = 0.95, capacity: int = 1_000) -> DataFrame:
    """(query_id, key, cosine): of each asked vector the most similar live entry, if it is similar enough.

    cache: key, vector, expires_at, last_used_at; the latest ``capacity`` live entries are searched, as the cache keeps no more.
    """
    at = F.lit(now) if isinstance(now, datetime) else now
    live = cache.where(F.col("expires_at") > at).orderBy(F.col("last_used_at").desc(), "key").limit(capacity)
    numbered = live.select("key", "vector", F.row_number().over(Window.orderBy("key")).cast("bigint").alias("n"))
    best = retrieval.vector_top_k(numbered, "n", "vector", asked.select("query_id", "vector"), 1)
    return best.where(F.col("cosine") >= threshold).join(numbered.select("n", "key"), "n").select("query_id", "key", "cosine")


def reindex_rollup(current: DataFrame, state: DataFrame) -> DataFrame:
    """(repositories, new, changed, indexing, current) of all repositories; state: name, commit_hash, status."""
    s = state.select("name", F.col("commit_hash").alias("_old"), "status", F.lit(True).alias("_known"))
    j = current.select("name", "commit_hash").join(s, "name", "left")
    new, same = F.col("_known").isNull(), F.col("commit_hash").eqNullSafe(F.col("_old"))
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return j.agg(F.count("*").alias("repositories"), count(new).alias("new"), count(~new & ~same).alias("changed"), count(F.coalesce(F.col("status") == "in_progress", F.lit(False))).alias("indexing"), count(~new & same).alias("current"))


def job_status(events: DataFrame) -> DataFrame:
    """(job_id, status, progress, started_at, ended_at) of jobs from their events (job_id, status, progress, at)."""
    return events.groupBy("job_id").agg(
        F.max_by("status", "at").alias("status"),
        F.max("progress").alias("progress"),
        F.min(F.when(F.col("status") == "in_progress", F.col("at"))).alias("started_at"),
        F.max(F.when(F.col("status").isin("completed", "failed"), F.col("at"))).alias("ended_at"),
    )


def role_update(users: DataFrame, user_id: int, role: str) -> DataFrame:
    return users.withColumn("role", F.when(F.col("user_id") == user_id, role).otherwise(F.col("role")))


def feedback_insert(feedback: DataFrame, new: DataFrame) -> DataFrame:
    """Feedback with new rows numbered on from the greatest id."""
    last = feedback.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    order = Window.orderBy("created_at", "user_id", "log_id")
    numbered = new.crossJoin(F.broadcast(last)).withColumn("id", F.col("_last") + F.row_number().over(order)).drop("_last")
    return feedback.unionByName(numbered.select(feedback.columns))
