from datetime import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarryline.operators.orphans import find_orphans, orphan_references, orphan_report

CHILD = "id bigint, k bigint, at timestamp_ntz, valid int, t string"
PARENT = "k bigint, a timestamp_ntz, b timestamp_ntz, known string"


def day(n):
    return None if n is None else dt(2025, 1, 1 + n)


def brute(children, parents):
    out = set()
    for i, k, t in children:
        if k is None:
            continue
        rows = [(a, b) for key, a, b in parents if key == k]
        if not rows:
            out.add((i, "missing"))
        elif t is None or any(a is not None and a <= t and (b is None or b > t) for a, b in rows):
            continue
        elif all(a is not None and a > t for a, _ in rows):
            out.add((i, "late"))
        else:
            out.add((i, "deleted"))
    return out


def run(spark, children, parents, **kw):
    c = spark.createDataFrame([(i, k, day(t), 1, "x") for i, k, t in children], CHILD)
    p = spark.createDataFrame([(k, day(a), day(b), "y") for k, a, b in parents], PARENT)
    return {(r.record_id, r.reason) for r in find_orphans(c, "id", "k", "at", p, "k", "a", "b", **kw).collect()}


def test_cases(spark):
    parents = [(1, 5, None), (2, 1, 3), (2, 6, None), (3, None, None), (4, 5, 5), (None, 1, None), (5, 2, 9), (5, 2, 9)]
    children = [(1, 1, 4), (2, 1, 5), (3, 2, 2), (4, 2, 3), (5, 2, 7), (6, 9, 1), (7, None, 1), (8, 3, 4), (9, 4, 6), (10, 1, None), (11, 9, None), (12, 2, 0), (6, 9, 1), (13, 5, 8)]
    assert run(spark, children, parents) == brute(children, parents)


def test_empty_tables(spark):
    assert run(spark, [], [(1, 1, None)]) == set()
    assert run(spark, [(1, 1, 1)], []) == {(1, "missing")}


small = st.integers(0, 20)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.one_of(st.none(), small), st.one_of(st.none(), small)), max_size=12), st.lists(st.tuples(st.integers(0, 5), small), min_size=1, max_size=15))
def test_against_brute_force(spark, parents, refs):
    children = [(n, k, t) for n, (k, t) in enumerate(refs)]
    assert run(spark, children, parents, slice_seconds=86400 * 3) == brute(children, parents)


def test_hot_key_over_many_slices(spark):
    parents = [(1, d, d + 1) for d in range(0, 28, 2)]
    children = [(n, 1, n % 28) for n in range(300)]
    assert run(spark, children, parents, slice_seconds=86400) == brute(children, parents)


@pytest.mark.parametrize("n", [0, 1])
def test_report(spark, n):
    users = spark.createDataFrame([(1, day(1), None)][:n], "user_id bigint, created_at timestamp_ntz, deleted_at timestamp_ntz")
    logs = spark.createDataFrame([(1, 1, day(2)), (2, 7, day(3))], "id bigint, user_id bigint, created_at timestamp_ntz")
    feedback = spark.createDataFrame([(1, 1, 1, day(1)), (2, 99, None, day(4))], "id bigint, log_id bigint, user_id bigint, created_at timestamp_ntz")
    rows = orphan_report(orphan_references(logs, users, feedback)).collect()
    got = {(r.child_table, r.ref_column, r.reason): r.n for r in rows}
    assert got[("feedback", "log_id", "missing")] == 1 and got[("feedback", "log_id", "late")] == 1
    assert got[("chat_logs", "user_id", "missing")] == (1 if n else 2)
    assert {r.month for r in rows} == {"2025-01"}


def test_narrow_slices_change_nothing(spark):
    import random

    from quarryline.operators.orphans import find_orphans

    rng = random.Random(8)
    children = spark.createDataFrame([(i, 1 if i % 3 else rng.randint(2, 9), rng.randint(0, 400_000)) for i in range(900)], "id bigint, ref bigint, s bigint").selectExpr("id", "ref", "timestamp_seconds(s) at")
    parents = spark.createDataFrame([(k, rng.randint(0, 300_000), rng.randint(0, 500_000)) for k in (1, 1, 1, 2, 3, 4, 5, 6)], "k bigint, a bigint, b bigint").selectExpr("k", "timestamp_seconds(a) a", "timestamp_seconds(b) b")
    got = [{tuple(r) for r in find_orphans(children, "id", "ref", "at", parents, "k", "a", "b", slice_rows=n).collect()} for n in (1_000_000, 20, 1)]
    assert got[0] == got[1] == got[2] and len({r[2] for r in got[0]}) == 3
