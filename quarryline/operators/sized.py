"""Joins that broadcast only behind a check of size, and pairs of a group without one task holding it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.session import cut_lineage

#: Rows of narrow keys (at most some 32 bytes each) up to which a side is broadcast; beyond it, a shuffle join.
BROADCAST_ROWS = 1_000_000
#: Bytes up to which a side with rows of any width is broadcast.
BROADCAST_BYTES = 32 << 20
#: Members of a group that meet in one task when pairs are built.
BLOCK = 512


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows; ``df`` should be materialised and narrow."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def small_bytes(df: DataFrame, row_bytes: Column, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows, ``row_bytes`` each, take at most ``max_bytes``; it should be materialised."""
    total = df.agg(F.sum(row_bytes.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if total <= max_bytes else df


def distinct_wide(df: DataFrame, keys: list[str], wide: str) -> DataFrame:
    """Distinct rows of ``keys`` and a wide text column, without shuffling the text of rows that aren't repeated.

    Rows are counted by a 128-bit hash; only those that occur more than once are moved to drop their repeats.
    """
    columns = df.columns
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys]
    hashed = df.withColumn("_h", F.unhex(F.md5(F.concat_ws("\u0001", *parts, F.coalesce(F.md5(wide), F.lit("null"))))))
    repeated = small_side(cut_lineage(hashed.groupBy("_h").count().where("count > 1").select("_h")))
    once = hashed.join(repeated, "_h", "left_anti")
    more = hashed.join(repeated, "_h", "left_semi").dropDuplicates(["_h"])
    return once.select(columns).unionByName(more.select(columns))


def pairs_in_groups(rows: DataFrame, group: str, member: str, block: int = BLOCK, carry: str | None = None) -> DataFrame:
    """Pairs (a < b) of members that share a group: distinct, or with ``carry`` one row a group and both values of that column.

    A group of n members is cut into ceil(n / block) blocks by the member's hash, and each pair of blocks is joined by
    itself, so that a hot group is spread over many tasks and no group is collected.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n")).where("_n > 1")
    parts = rows.join(sizes, group).withColumn("_parts", F.ceil(F.col("_n") / block).cast("int"))
    mine = parts.withColumn("_mine", F.pmod(F.xxhash64(member), F.col("_parts")).cast("int"))
    cells = mine.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    lo, hi = F.least("_mine", "_other"), F.greatest("_mine", "_other")
    more = lambda side: [F.col(carry).alias(f"{carry}_{side}")] if carry else []
    left = cells.select(F.col(group).alias("_g"), lo.alias("_i"), hi.alias("_j"), F.col("_mine").alias("_ma"), F.col(member).alias("a"), *more("a"))
    right = cells.select(F.col(group).alias("_g"), lo.alias("_i"), hi.alias("_j"), F.col("_mine").alias("_mb"), F.col(member).alias("b"), *more("b"))
    # Within the cell (i, j), one member comes from block i and the other from block j.
    joined = left.join(right, ["_g", "_i", "_j"]).where((F.col("a") < F.col("b")) & (F.col("_i") == F.least("_ma", "_mb")) & (F.col("_j") == F.greatest("_ma", "_mb")))
    return joined.select("a", "b", f"{carry}_a", f"{carry}_b") if carry else joined.select("a", "b").distinct()
