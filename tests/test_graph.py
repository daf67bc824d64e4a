from pyspark.sql import functions as F

from quarryline.operators import graph


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, type string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_upserts(spark):
    old = spark.createDataFrame([("a", "File", "x"), ("b", "File", "y")], "id string, type string, name string")
    new = spark.createDataFrame([("a", "Class", "z")], "id string, type string, name string")
    merged = {r.id: (r.type, r.name) for r in graph.upsert_nodes(old, new).collect()}
    assert merged == {"a": ("Class", "z"), "b": ("File", "y")}
    e = edges(spark, [("a", "b", "X"), ("a", "b", "X"), ("a", "gone", "X"), (None, "b", "X")])
    assert graph.upsert_edges(e, old).count() == 1


def test_delete_repository_keeps_prefix_twins(spark):
    left = graph.delete_repository(ids(spark, "repo:a", "repo:a:x.py", "repo:ab", "repo:ab:y.py"), "a")
    assert {r.id for r in left.collect()} == {"repo:ab", "repo:ab:y.py"}


def test_paths_are_edge_unique_on_cycles(spark):
    e = edges(spark, [("a", "b", "X"), ("b", "a", "X"), ("b", "c", "X")])
    found = {tuple(r.nodes) for r in graph.paths(e, ids(spark, "a"), 4).collect()}
    assert found == {("a", "b"), ("a", "b", "a"), ("a", "b", "c")}
    assert {(r.id, r.distance) for r in graph.reach(e, ids(spark, "a"), 4).collect()} == {("b", 1), ("c", 2)}


def test_both_directions_and_shortest(spark):
    e = edges(spark, [("a", "b", "X"), ("c", "b", "Y"), ("c", "d", "Y")])
    got = {(r.id, r.distance) for r in graph.shortest_path_lengths(e, ids(spark, "a"), ids(spark, "d", "a"), 5).collect()}
    assert got == {("d", 3), ("a", 0)} - {("a", 0)}


def test_empty_graph(spark):
    e = edges(spark, [])
    assert graph.reach(e, ids(spark, "a"), 3).count() == 0
    assert graph.paths(e, ids(spark, "a"), 3).count() == 0


def test_siblings_and_fan_in(spark):
    e = edges(spark, [("c", "m1", "CONTAINS"), ("c", "m2", "CONTAINS"), ("d", "m3", "CONTAINS")])
    assert {(r.id, r.sibling) for r in graph.siblings(e).collect()} == {("m1", "m2"), ("m2", "m1")}
    assert {r.id: r.fan_in for r in graph.fan_in(graph.paths(e, ids(spark, "c"), 2)).collect()} == {"m1": 1, "m2": 1}


def test_link_calls(spark):
    calls = spark.createDataFrame([("c1", "GET", "/api/users"), ("c2", "post", "/api/users"), ("c3", "GET", "/"), ("c4", "GET", "/api/x")], "id string, method string, url string")
    ends = spark.createDataFrame([("e1", "GET", "/api/users"), ("e2", "ANY", "/api/users/{param}"), ("e3", "POST", "/api/users/{param}")], "id string, method string, path string")
    got = {(r.src, r.dst): r.confidence for r in graph.link_calls(calls, ends).collect()}
    assert got == {("c1", "e1"): 1.0, ("c1", "e2"): 0.7, ("c2", "e2"): 0.7, ("c2", "e3"): 0.85}
    assert {r.id for r in graph.orphan_calls(calls, graph.link_calls(calls, ends)).collect()} == {"c3", "c4"}


def test_include_prefixes_with_cycle(spark):
    inc = spark.createDataFrame([("app.urls", "root", "app/"), ("sub.urls", "app.urls", "sub/"), ("x", "y", "p/"), ("y", "x", "q/")], "child string, parent string, prefix string")
    got = {r.child: r.prefix for r in graph.include_prefixes(inc).collect()}
    assert got["sub.urls"] == "app/sub/" and got["app.urls"] == "app/" and "x" not in got


def test_priority_resolution(spark):
    refs = spark.createDataFrame([(1, "f", "r1"), (2, "f", "r2"), (3, "g", "r1")], "n int, name string, repository string")
    fn = spark.createDataFrame([("b", "f", "r1", 2), ("a", "f", "r0", 1), ("c", "f", "r1", 3)], "id string, name string, repository string, seq int")
    out = graph.resolve_first(refs, "name", [(fn, ["name", "repository"], 0), (fn.drop("repository"), "name", 1)], ["n"])
    assert {(r.n, r.target, r.priority) for r in out.collect()} == {(1, "b", 0), (2, "a", 1)}


def test_type_counts_are_zero_filled(spark):
    n = spark.createDataFrame([("a", "File")], "id string, type string")
    got = {(r.kind, r.type): r.n for r in graph.type_counts(n, edges(spark, []), ["File", "Class"], ["CALLS"]).collect()}
    assert got == {("node", "File"): 1, ("node", "Class"): 0, ("node", "total"): 1, ("edge", "CALLS"): 0, ("edge", "total"): 0}


def test_pairs_in_groups(spark):
    from quarryline.operators.sized import pairs_in_groups

    rows = spark.createDataFrame([(g, m) for g in (1, 2) for m in range(40)] + [(3, 7)], "g int, m int")
    got = pairs_in_groups(rows, "g", "m", block=7)
    assert got.count() == 40 * 39 // 2 and got.where("a >= b").count() == 0
    assert got.agg(F.count_distinct("a", "b")).first()[0] == 780


def test_fan_in_by_degrees(spark):
    import random

    rng = random.Random(4)
    rows = {(rng.choice("abcdef"), rng.choice("abcdef"), rng.choice("XY")) for _ in range(40)}
    e = spark.createDataFrame(sorted(rows), "src string, dst string, type string")
    starts = spark.createDataFrame([("a",), ("b",)], "id string")
    want = {r.id: r.fan_in for r in graph.fan_in(graph.paths(e, starts, 2)).collect()}
    assert {r.id: r.fan_in for r in graph.fan_in_of_two(e, starts).collect()} == want
