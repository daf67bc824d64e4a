"""References to records that do not exist.

Method: references and parent keys are co-partitioned by (key, time slice), sorted by time, and merged in one linear
pass (a running window).  Parents enter the merge as validity events: +1 where an interval starts, -1 where it ends.
The state a slice begins with is one carry row per (key, slice), computed from per-slice sums, so a hot key is spread
over its slices and no group grows with the whole history of a key.

Defined cases
-------------
* A null reference is no reference and gives no row.  Any other value is one.
* A parent row with a null key is ignored.  A parent row whose start is null makes the key known but never valid.
* An interval that ends at or before its start is never valid.  At equal times parents come before references.
* A reference whose own time is null can only be ``missing``.
* Repeated rows give one result row per record.  Empty tables give an empty result.
* Other columns of either table, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time slice in seconds, and references of one key in one slice up to which it isn't made narrower: a slice of
#: one key is merged by one task.
SLICE_SECONDS, SLICE_ROWS = 86400, 1_000_000


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


@dataclass(frozen=True)
class Reference:
    """References of child rows to parent rows that are valid from one time to another."""

    children: DataFrame
    record_id: str
    reference: str
    at: str
    parents: DataFrame
    parent_key: str
    valid_from: str
    valid_to: str | None = None


def find_orphans(children: DataFrame, record_id: str, reference: str, at: str, parents: DataFrame, parent_key: str, valid_from: str, valid_to: str | None = None, slice_seconds: int = SLICE_SECONDS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(record_id, at, reason) of every reference without a parent valid at its time.

    reason: ``missing`` (no parent row with the key), ``late`` (every parent row with the key starts later), else
    ``deleted``.
    """
    found = find_all_orphans([Reference(children, record_id, reference, at, parents, parent_key, valid_from, valid_to)], slice_seconds, slice_rows)
    return found.select(F.col("rid").cast(dict(children.dtypes)[record_id]).alias("record_id"), "at", "reason").distinct()


def find_all_orphans(references: list[Reference], slice_seconds: int = SLICE_SECONDS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(n, rid, at, reason) of the orphans of several references, n the number of the reference, rid the record's id as text.

    All of them are one merge, keyed by reference, key and time slice.  Where a key has more than ``slice_rows`` references
    in a slice, slices are made narrower by as much.
    """
    refs, parents = [], []
    for n, r in enumerate(references):
        refs.append(r.children.select(F.lit(n).alias("n"), F.col(r.record_id).cast("string").alias("rid"), F.col(r.reference).cast("string").alias("k"), _micros(F.col(r.at)).alias("t")).where(F.col("k").isNotNull()))
        end = _micros(F.col(r.valid_to)) if r.valid_to else F.lit(None).cast("bigint")
        parents.append(r.parents.select(F.lit(n).alias("n"), F.col(r.parent_key).cast("string").alias("k"), _micros(F.col(r.valid_from)).alias("a"), end.alias("b")).where(F.col("k").isNotNull()))
    refs, rows = reduce(DataFrame.unionByName, refs), reduce(DataFrame.unionByName, parents)
    width = slice_seconds * 1_000_000
    most = refs.groupBy("n", "k", F.floor(F.col("t") / F.lit(width))).count().agg(F.max("count")).first()[0] or 0
    width = max(1, width // -(-most // slice_rows)) if most > slice_rows else width
    # One row per change: starts (every parent row), and the two ends of the intervals that are not empty.
    real = F.col("a").isNotNull() & (F.col("b").isNull() | (F.col("b") > F.col("a")))
    changes = rows.select(
        "n",
        "k",
        F.explode(
            F.array(
                F.struct(F.coalesce(F.col("a"), F.lit(-(2**62))).alias("t"), real.cast("int").alias("valid"), F.lit(1).alias("known")),
                F.struct(F.when(real, F.col("b")).alias("t"), F.lit(-1).alias("valid"), F.lit(0).alias("known")),
            )
        ).alias("c"),
    ).select("n", "k", "c.*").where(F.col("t").isNotNull())
    changes = changes.groupBy("n", "k", "t").agg(F.sum("valid").alias("valid"), F.sum("known").alias("known"))
    none, zero = F.lit(None), F.lit(0).cast("bigint")
    slice_of = lambda t: F.coalesce(F.floor(t / F.lit(width)), F.lit(-(2**40))).cast("bigint")
    events = changes.select("n", "k", slice_of(F.col("t")).alias("s"), "t", "valid", "known", none.cast("string").alias("rid"), F.lit(False).alias("ref"))
    marks = refs.select("n", "k", slice_of(F.col("t")).alias("s"), "t", zero.alias("valid"), zero.alias("known"), "rid", F.lit(True).alias("ref"))
    # What each slice of a key starts with: sums over the key's earlier slices, plus the sum over all of them.
    sums = events.select("n", "k", "s", "valid", "known").unionByName(marks.select("n", "k", "s", "valid", "known")).groupBy("n", "k", "s").agg(F.sum("valid").alias("valid"), F.sum("known").alias("known"))
    before = Window.partitionBy("n", "k").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(
        "n", "k", "s", F.lit(-(2**63)).cast("bigint").alias("t"),
        F.coalesce(F.sum("valid").over(before), zero).alias("valid"), F.coalesce(F.sum("known").over(before), zero).alias("known"),
        F.sum("known").over(Window.partitionBy("n", "k")).alias("ever"), none.cast("string").alias("rid"), F.lit(False).alias("ref"),
    )
    merged = reduce(DataFrame.unionByName, [carry, *(x.withColumn("ever", zero) for x in (events, marks))])
    run = Window.partitionBy("n", "k", "s").orderBy(F.col("t").asc_nulls_last(), F.col("ref")).rowsBetween(Window.unboundedPreceding, 0)
    state = merged.select("n", "rid", "t", "ref", *(F.sum(c).over(run).alias(c) for c in ("valid", "known", "ever")))
    reason = (
        F.when(F.col("ever") == 0, "missing")
        .when(F.col("t").isNull() | (F.col("valid") > 0), none)
        .when(F.col("known") == 0, "late")
        .otherwise("deleted")
    )
    return state.where("ref").select("n", "rid", F.timestamp_micros("t").alias("at"), reason.alias("reason")).where(F.col("reason").isNotNull())


def orphan_references(chat_logs: DataFrame, users: DataFrame, feedback: DataFrame) -> DataFrame:
    """Every orphan of the three references of the bot's tables."""
    checks = [
        ("chat_logs", Reference(chat_logs, "id", "user_id", "created_at", users, "user_id", "created_at", "deleted_at")),
        ("feedback", Reference(feedback, "id", "user_id", "created_at", users, "user_id", "created_at", "deleted_at")),
        ("feedback", Reference(feedback, "id", "log_id", "created_at", chat_logs, "id", "created_at")),
    ]
    found = find_all_orphans([r for _, r in checks])
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("n") + 1)
    rows = found.select(of([t for t, _ in checks]).alias("child_table"), F.col("rid").cast("bigint").alias("record_id"), of([r.reference for _, r in checks]).alias("ref_column"), "reason", "at")
    return rows.distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts of ``orphan_references`` per table, column, month and reason."""
    return orphans.groupBy("child_table", "ref_column", F.date_format("at", "yyyy-MM").alias("month"), "reason").agg(F.count("*").alias("n"))
