"""Expansion, retriever, caches, agents, tasks and sources."""

import subprocess
from datetime import datetime as dt
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from quarryline.operators import cache, expand, graph, sized, tracebacks
from quarryline.plans import agents, pipeline, render, retriever
from quarryline.sources import files, git
from quarryline.streaming import ingest

NODES = [
    ("f", "File", "v.py", "app/v.py", 1), ("c", "Class", "Loader", "app/v.py", 1), ("m1", "Method", "read", "app/v.py", 2), ("m2", "Method", "write", "app/v.py", 5), ("m3", "Method", "close", "app/v.py", 9),
    ("g", "Function", "helper", "app/v.py", 20), ("h", "Function", "deep", "app/h.py", 1), ("e", "Endpoint", "GET /x", "app/u.py", 1), ("d", "Model", "Row", "app/m.py", 1), ("d2", "Model", "Cell", "app/m.py", 9),
    ("k", "Component", "Page", "web/p.jsx", 1), ("a", "ApiCall", "GET /x", "web/p.jsx", 2), ("r", "Route", "/page", "web/p.jsx", 3),
]
EDGES = [("f", "c", "CONTAINS"), ("f", "g", "CONTAINS"), ("c", "m1", "CONTAINS"), ("c", "m2", "CONTAINS"), ("c", "m3", "CONTAINS"), ("m1", "g", "CALLS"), ("g", "h", "CALLS"), ("m2", "h", "CALLS"), ("e", "m1", "HANDLES_REQUEST"), ("e", "d", "USES_MODEL"), ("d", "d2", "FOREIGN_KEY"), ("k", "a", "MAKES_CALL"), ("a", "e", "CALLS_ENDPOINT"), ("k", "r", "RENDERS_AT"), ("m1", "d", "USES_MODEL")]


@pytest.fixture(scope="module")
def small(spark):
    n = spark.createDataFrame(NODES, "id string, type string, name string, file_path string, start_line int")
    return n, spark.createDataFrame(EDGES, "src string, dst string, type string")


def chunks(spark, rows):
    return spark.createDataFrame(rows, "query_id int, id string, type string, file string, score double, source string")


def test_anchors(spark):
    c = chunks(spark, [(1, "a", "Function", "x/a.py", 0.9, "primary"), (1, "b", "Class", "x/b.py", 0.1, "primary"), (1, "c", "Method", "x/hot.py", 0.2, "primary"), (1, None, "File", "repo/x/hot.py", 0.9, "grep"), (1, "s", "Import", "x/s.py", 1.0, "primary"), (1, "", "Class", "x/s.py", 1.0, "primary"), (1, "a", "Function", "x/a.py", 0.9, "primary"), (2, "b", "Class", "x/b.py", None, "primary")])
    got = [(r.query_id, r.id) for r in expand.select_anchors(c).orderBy("query_id", "anchor").collect()]
    assert got == [(1, "c"), (1, "b"), (1, "a"), (2, "b")]
    skip = spark.createDataFrame([(1, "c")], "query_id int, id string")
    assert [r.id for r in expand.select_anchors(c, 1, skip).where("query_id = 1").collect()] == ["b"]


def test_graph_expand(spark, small):
    n, e = small
    c = chunks(spark, [(1, "c", "Class", "app/v.py", 0.9, "primary"), (1, "m2", "Method", "app/v.py", 0.8, "primary"), (2, "e", "Endpoint", "u", 0.9, "primary"), (3, "k", "Component", "p", 0.9, "primary"), (4, "d", "Model", "m", 0.9, "primary"), (5, "m1", "Method", "v", 0.9, "primary"), (6, "x", "Class", "v", 0.9, "primary")])
    got = {}
    for r in expand.graph_expand(c, n, e).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.rel))
    assert got[1] == [("m1", "CONTAINS"), ("m3", "CONTAINS"), ("h", "CALLS")]  # m2 is there already
    assert got[2] == [("m1", "HANDLES_REQUEST"), ("d", "USES_MODEL")]
    assert got[3] == [("e", "CALLS_ENDPOINT"), ("r", "RENDERS_AT")] and got[4] == [("d2", "FOREIGN_KEY")]
    assert got[5] == [("g", "CALLS"), ("h", "CALLS"), ("m2", "SIBLING_OF"), ("m3", "SIBLING_OF")] and 6 not in got
    assert expand.expand_anchors(expand.select_anchors(c), c, n, e, 1).groupBy("query_id").count().agg({"count": "max"}).first()[0] == 1
    lists = {r.id: (len(r.related), r.distinct_types) for r in expand.with_related(n, e, n.where("type in ('Class', 'Model')")).collect()}
    assert lists == {"c": (3, ["CONTAINS"]), "d": (1, ["FOREIGN_KEY"]), "d2": (0, [])}
    assert {(r.id, r.found) for r in expand.fetch_entities(n, spark.createDataFrame([("c",), ("zz",)], "id string")).collect()} == {("c", True), ("zz", False)}


def test_siblings_of_a_large_owner(spark):
    e = spark.range(3000).selectExpr("'o' src", "lpad(id, 5, '0') dst", "'CONTAINS' type")
    rows = graph.siblings(e, most=25)
    assert rows.count() == 3000 * 25 and rows.where("id = '00003'").agg({"sibling": "max"}).first()[0] == "00025"


def test_paths(spark, small):
    n, e = small
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    assert [(r.nodes, r.distance) for r in graph.shortest_paths(e, one("k"), one("d"), 5, "out").collect()] == [(["k", "a", "e", "d"], 3)]
    assert graph.shortest_paths(e, one("r"), one("zz"), 4).count() == 0
    rows = graph.related(e, n, one("m1"), 3, ["CALLS", "USES_MODEL"]).collect()
    assert {(r.id, tuple(r.rel_types), r.distance) for r in rows} == {("g", ("CALLS",), 1), ("d", ("USES_MODEL",), 1), ("h", ("CALLS", "CALLS"), 2)}


def test_retriever(spark, small):
    n, e = small
    rows = [(x, t, name, p, "r1" if x != "k" else "r2", f"{name} loads rows {t}", [float(i == j) for j in range(4)]) for i, (x, t, name, p, _) in enumerate(NODES[:4] + NODES[10:11])]
    c = spark.createDataFrame(rows, "id string, node_type string, name string, file_path string, repository string, content string, vector array<float>")
    q = spark.createDataFrame([(1, "Loader rows", [0.0, 1.0, 0.0, 0.0]), (2, "Page rows", [0.0, 0.0, 0.0, 0.0])], "query_id bigint, query string, vector array<float>")
    found = retriever.search(c, q, n, e, "ui_to_database", {"top_k_final": 2, "nonsense": 1})
    assert found.primary.where("query_id = 1").orderBy("rank").first().id == "c" and found.strategy == "ui_to_database"
    assert {tuple(r.nodes) for r in found.expanded.where("start = 'k'").collect()} == {("k", "a", "e", "d"), ("k", "a", "e", "m1", "d")}
    only = retriever.initial_search(c, q, retriever.with_overrides(retriever.SearchConfig(), {"repositories": [["r2"]], "hybrid_alpha": 0.0}))
    assert {r.repository for r in only.collect()} == {"r2"}
    first = retriever.initial_search(c, q, retriever.SearchConfig(repositories=("r2",), filter_first=True, node_types=("Component",)))
    assert {r.id for r in first.collect()} == {"k"}
    assert retriever.route("bm25", "frontend", 7) == ("semantic_only", {"top_k_final": 7, "top_k_vector": 14, "hybrid_alpha": 0.0, "node_types": ("Component", "Route")})
    assert retriever.route("database_to_ui", None, 5)[0] == "database_to_ui" and retriever.route("what", None, 5)[0] == "semantic_only"


def test_context_shapes(spark):
    rows = spark.createDataFrame([(1, "grep", i, f"g{i}", "needle" if i > 10 else "hay", "n", "T", "f") for i in range(30)] + [(1, "graph", i, f"x{i}", "hay", "n", "T", "f") for i in range(5)] + [(1, "primary", 0, "p", "hay", "n", "T", "f"), (1, "other", 0, "o", "hay", "n", "T", "f")], "query_id int, source string, pos int, id string, code string, name string, type string, file string")
    out = retriever.rerank_context(rows, F.lit("needle")).orderBy("rank").collect()
    assert [r.source for r in out] == ["primary"] + ["grep"] * 20 + ["graph"] * 5 + ["other"] and out[1].id == "g11" and out[-2].id == "x4"
    merged = retriever.merged_context(rows.where("source = 'graph'"), rows.where("source in ('graph', 'primary')")).collect()
    assert sorted((r.id, r.source) for r in merged) == [("p", "expanded")] + [(f"x{i}", "primary") for i in range(5)]
    assert [r.file for r in retriever.sources(rows, rows).collect()] == ["f"]
    assert [r.id for r in retriever.first_sources(rows.where("source = 'graph'"), 2).orderBy("rank").collect()] == ["x0", "x1"]
    blocks = {r.block: r.text for r in retriever.prompt_blocks(rows, 2).collect()}
    assert blocks["primary"] == "### n (T)\n`f`\n```\nhay\n```" and blocks["grep"].count("###") == 2
    facts = retriever.fact_rows(spark.createDataFrame([(3,)], "n int")).first()
    assert (facts.code, facts.score) == ("n: 3", 1.0)
    shaped = retriever.api_results(spark.createDataFrame([("repo:a:b/c.py:F", None, "nan", None)], "id string, score double, type string, name string")).first()
    assert (shaped.entity_id, shaped.entity_type, shaped.file_path, shaped.score) == ("repo:a:b/c.py:F", "Unknown", "b/c.py", 0.0)
    cut = agents.enriched(rows.withColumn("type", F.lit("Function")))
    assert cut.count() == 5 and set(r.part for r in cut.collect()) == {"functions"}


@pytest.mark.parametrize("text, want", [('{"a": 1}', {"a": 1}), ('so ```json\n{"action": "s", "x": {"q": "}"}}\n``` then', {"action": "s", "x": {"q": "}"}}), ('{"action": "s", "q": "ab', {"action": "s", "q": "ab"}), ('{"a": [1, 2,', {"a": [1, 2]}), ('{"b": 2} and {"action": "z"}', {"action": "z"})])
def test_lenient_json(text, want):
    assert retriever.lenient_json(text) == want
    with pytest.raises(ValueError):
        retriever.lenient_json("nothing")


def test_caches(spark):
    now = dt(2025, 1, 2)
    made = spark.createDataFrame([("how", "a1", now - timedelta(hours=1), "r1"), ("old", "a2", now - timedelta(days=3), "r1"), ("else", "a3", now - timedelta(hours=2), None), (None, "a4", now, None)], "q string, v string, at timestamp, repo string")
    store = cache.put(cache.entries(made.limit(0), "query", "q", "v", "at", "repo"), cache.entries(made, "query", "q", "v", "at", "repo"))
    assert store.count() == 3 and cache.put(store.limit(0), store, 2).where("value = 'a2'").count() == 0
    asked = spark.createDataFrame([(1, "how"), (2, "old"), (3, "new"), (4, None)], "query_id bigint, query string")
    got = cache.get(store, asked, "query", "query", now)
    assert {(r.query_id, r.value) for r in got.collect()} == {(1, "a1"), (2, None), (3, None), (4, None)} and cache.hit_rate(got).first().rate == 0.25
    assert cache.drop(store, repository="r1").count() == 1 and cache.drop(store, keys=store.select("key").limit(1)).count() == 2
    vectors = spark.createDataFrame([(k.key, [1.0, 0.0] if k.value == "a1" else [0.0, 1.0], k.expires_at, k.last_used_at) for k in store.collect()], "key string, vector array<float>, expires_at timestamp, last_used_at timestamp")
    questions = spark.createDataFrame([(1, "how", [0.0, 0.0]), (2, "howdy", [0.99, 0.01]), (3, "new", [0.7, 0.7])], "query_id bigint, query string, vector array<float>")
    out = agents.ask(questions, store, now, lambda q: q.select("query_id", F.concat(F.lit("new:"), "query").alias("value")), vectors)
    assert {(r.query_id, r.value, r.origin) for r in out.answers.collect()} == {(1, "a1", "exact"), (2, "a1", "similar"), (3, "new:new", "new")}
    assert out.cache.where("value = 'new:new'").count() == 1
    events = spark.createDataFrame([("j", "queued", 0, 1), ("j", "in_progress", 10, 2), ("j", "completed", 100, 3), ("i", "in_progress", 5, 2)], "job_id string, status string, progress int, at int")
    assert {(r.job_id, r.status, r.progress, r.ended_at) for r in cache.job_status(events).collect()} == {("j", "completed", 100, 3), ("i", "in_progress", 5, None)}
    feedback = spark.createDataFrame([(4, 1, 1)], "id bigint, log_id bigint, user_id bigint").withColumn("created_at", F.lit(1))
    assert sorted(r.id for r in cache.feedback_insert(feedback, feedback.drop("id")).collect()) == [4, 5]
    assert cache.role_update(spark.createDataFrame([(1, "user"), (2, "user")], "user_id int, role string"), 2, "admin").where("role = 'admin'").count() == 1


def test_agents(spark, small):
    q = spark.createDataFrame([(1, "Как добавить клиента?"), (2, "how to create a widget"), (3, "hello"), (4, None)], "query_id int, query string")
    code = spark.createDataFrame([(1, 0, "go('/customers/new'); go('/orders'); go('/customers/new')"), (1, 1, 'x = "/api/customers"')], "query_id int, pos int, code string")
    got = {r.query_id: (r.task, r.entity, r.routes) for r in agents.guide(q, code).collect()}
    assert got[1] == ("create", "customer", ["/customers/new", "/api/customers"]) and got[2][1] == "widget" and got[3][1] is None and got[4][2] == []
    asked = []
    r = agents.Reformulator(lambda p: asked.append(p) or "1. one\n- two\n\n")
    assert r("why", "split") == ["one", "two"] == r("why", "split") and len(asked) == 1 and agents.Reformulator()("why") == ["why"]
    assert agents.Reformulator(lambda p: 1 / 0)("why") == ["why"]
    said = list(agents.orchestrate("q", "hybrid", {"code": lambda q: "C", "document": lambda q: 1 / 0}))
    assert said[0] == ("classified", "hybrid") and ("failed", "document: ZeroDivisionError") in said and said[-1] == ("answer", "C")
    n, e = small
    text = 'Traceback (most recent call last):\n  File "/app/app/v.py", line 3, in read\n    x()\n  File "/app/app/v.py", line 22, in helper\n    y()\n  File "/lib/other.py", line 1, in z\n    w()\nKeyError: 1'
    found = agents.explain_tracebacks(spark.createDataFrame([(1, text), (2, None), (3, "no")], "id int, t string"), "id", "t", n, e).orderBy("pos").collect()
    assert [(r.file_id, r.entity_id, r.callers, r.callees) for r in found] == [("f", "m1", None, ["helper"]), ("f", "g", ["read"], ["deep"]), (None, None, None, None)]
    assert tracebacks.match_functions(spark.createDataFrame([(1, 0, "f", "nope")], "id int, pos int, file_id string, function_name string"), n, e, "id").first().entity_id is None


def test_diagrams(spark, small):
    n, e = small
    assert "Page -->|MAKES_CALL| GET__x" in render.search_graph(n.where("id in ('k', 'a')"), n, e).first().text
    assert render.flow_path(n, e, "Page").first().nodes == ["k", "a", "e", "d"] and render.flow_path(n, e, "None").count() == 0
    text = render.layered_sequence(e, n).first().text
    assert "UI->>API: Page MAKES_CALL GET /x" in text and "Backend->>DB: read USES_MODEL Row" in text and "CONTAINS" not in text
    assert "Row -->|FOREIGN_KEY| Cell" in render.neighbour_chart(n, e, n.where("id = 'd'")).first().text


def test_tasks():
    log, p = [], pipeline.Progress()
    ex = pipeline.Executor.of(pipeline.Task("a", lambda: log.append("a") or 1), pipeline.Task("b", lambda a: log.append("b") or a + 1, ("a",)), pipeline.Task("c", lambda a, b: a + b, ("a", "b")), pipeline.Task("x", lambda: 1 / 0), hooks=[p])
    assert ex.run("c")["c"] == 3 and log == ["a", "b"] and ex.again("b") == 2 and log == ["a", "b", "b"] and p.state("c") == "completed" and p.state("x") == "queued"
    with pytest.raises(ZeroDivisionError):
        ex.run("x")
    assert p.state("x") == "failed"
    with pytest.raises(ValueError):
        pipeline.Executor.of(pipeline.Task("a", print, ("b",)), pipeline.Task("b", print, ("a",))).run()
    assert list(pipeline.Executor.of(pipeline.Task("a", lambda: 1)).stream()) == [("a", "in_progress"), ("a", "completed")]
    ask = pipeline.first_that_answers(lambda p: 1 / 0, lambda p: " ", lambda p: "yes")
    assert ask("q") == "yes"
    with pytest.raises(RuntimeError):
        pipeline.first_that_answers(lambda p: "")("q")


def test_index_job_as_tasks(spark, tmp_path):
    rows = spark.createDataFrame([("demo", "a.py", "def f():\n    return g()\n\ndef g():\n    return 1\n")], "repository string, file_path string, content string")
    ex = pipeline.indexing_tasks(lambda: rows, str(tmp_path / "ix"))
    ex.run(*pipeline.JOBS["full_index"])
    from quarryline.plans.index_job import clear_index

    assert spark.read.parquet(str(tmp_path / "ix" / "nodes")).count() == 4
    clear_index(spark, str(tmp_path / "ix"), "nodes")
    assert spark.read.parquet(str(tmp_path / "ix" / "nodes")).count() == 0 and spark.read.parquet(str(tmp_path / "ix" / "edges")).count() > 0


def test_sources(spark, tmp_path):
    repo = tmp_path / "r"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@x", *a], cwd=repo, check=True, capture_output=True)
    run("init", "-q")
    for name in ("main.py", "test.py", "secret.py"):
        (repo / name).write_text("x = 1\n" * 20)
    (repo / ".ragignore").write_text("# own\ntest.py\nsecret.py\n\n")
    run("add", "-A")
    run("commit", "-qm", "one")
    first = git.discover(str(tmp_path))[0]["commit_hash"]
    run("mv", "main.py", "core.py")
    (repo / "new.py").write_text("y = 2\n")
    run("add", "-A")
    run("commit", "-qm", "two")
    assert git.changed_paths(str(repo), first) == ["core.py", "main.py", "new.py"] and git.changed_paths(str(repo), "nonsense") is None
    got = {r.file_path for r in files.read_repository(spark, str(repo), "r").collect()}
    assert {"core.py", "new.py"} <= got and not {"test.py", "secret.py"} & got
    roots = git.Roots(str(tmp_path))
    assert roots.resolve("r") == str(repo) and roots.resolve("no") is None


def test_triggers(spark):
    t = spark.createDataFrame([("https://x.example/team/Loader.git", "push"), ("https://x.example/team/loader-web", "push"), ("https://x.example/none", "push")], "url string, event string")
    known = spark.createDataFrame([("loader",), ("load",)], "name string")
    assert sorted((r.url[-10:], r.repository) for r in ingest.named_repositories(t, known).collect()) == [("Loader.git", "loader"), ("loader-web", "loader")]
    now = dt(2025, 1, 3)
    state = spark.createDataFrame([("a", "1", "1", now), ("b", "2", "1", now), ("c", "1", None, None), ("d", "1", "1", now - timedelta(days=2))], "name string, commit_hash string, indexed_hash string, indexed_at timestamp")
    assert {(r.name, r.reason) for r in ingest.due(state, now).collect()} == {("b", "changed"), ("c", "new"), ("d", "old")}


def test_distinct_wide(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, None, 6), (2, None, 6), (None, "a", 7), (None, "a", 7), (3, "b", 8)], "id int, t string, _h int").select("id", "t")
    assert sorted((r.id or 0, r.t or "") for r in sized.distinct_wide(rows, ["id"], "t").collect()) == [(0, "a"), (1, "a"), (2, ""), (3, "b")]
