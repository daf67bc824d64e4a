import io
import json
import zipfile
from datetime import datetime as dt
from datetime import timedelta

import pytest

from quarryline.functions import ecma
from quarryline.operators import extract, react, tracebacks, usage
from quarryline.plans import context_loop, render
from quarryline.sources import files


def test_usage(spark):
    rows = [(1, 1, 1, 100, dt(2025, 1, 1)), (1, 1, 1, 100, dt(2025, 1, 2)), (2, 2, 0, 50, dt(2025, 1, 1)), (3, None, None, None, None)]
    logs = spark.createDataFrame(rows, "id int, user_id int, success int, response_time_ms int, ingested_at timestamp_ntz")
    r = usage.usage_stats(usage.delivered_once(logs)).first()
    assert (r.requests, r.successes, r.avg_ms, r.users) == (3, 1, 75, 2) and abs(r.success_rate - 33.3333) < 1e-3
    assert usage.usage_stats(logs.limit(0)).first().success_rate == 0.0


def test_cache_model(spark):
    start = dt(2025, 1, 1)
    times = [0, 100, 3599, 3600, 3700, 9000, 12599, 12600]
    ev = spark.createDataFrame([(n, "k", start + timedelta(seconds=t)) for n, t in enumerate(times)] + [(99, None, start)], "event_id bigint, key string, ts timestamp_ntz")
    got = {r.event_id: r.hit for r in usage.cache_hits(ev, "key", "ts", 3600).collect()}
    filled, want = None, {99: False}
    for n, t in enumerate(times):
        want[n] = filled is not None and t - filled < 3600
        filled = filled if want[n] else t
    assert got == want


def test_state_and_changes(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "name string, commit_hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "name string, commit_hash string")
    assert [(r.name, r.reason) for r in usage.needs_reindex(now, old).collect()] == [("b", "changed")]
    a = spark.createDataFrame([("x", "1"), ("y", "1")], "path string, hash string")
    b = spark.createDataFrame([("y", "2"), ("z", "1")], "path string, hash string")
    assert {(r.path, r.change) for r in usage.changed_files(a, b).collect()} == {("x", "removed"), ("y", "modified"), ("z", "added")}


TRACE = 'log line\nTraceback (most recent call last):\n  File "/app/src/a.py", line 3, in f\n    x = 1\n  File "b.py", line 9, in g\nValueError: bad: x\r\n'


def test_tracebacks(spark):
    df = spark.createDataFrame([(1, TRACE), (2, None), (3, ""), (4, "my.pkg.Error"), (5, "cut\n  File \"x")], "id int, t string")
    got = {r.id: r for r in tracebacks.parse_tracebacks(df, "id", "t").collect()}
    assert [(f.file_path, f.line_number, f.function_name, f.code_line) for f in got[1].frames] == [("/app/src/a.py", 3, "f", "x = 1"), ("b.py", 9, "g", "")]
    assert (got[1].exception_type, got[1].exception_message) == ("ValueError", "bad: x")
    assert got[2].frames == [] and got[4].exception_type == "my.pkg.Error"
    assert tracebacks.valid(tracebacks.parse_tracebacks(df, "id", "t")).count() == 1
    fr = spark.createDataFrame([(1, 0, "/app/pkg/a.py"), (1, 1, "zz.py")], "id int, pos int, file_path string")
    fs = spark.createDataFrame([("n2", "x/pkg/a.py"), ("n1", "y/pkg/a.py")], "id string, path string")
    assert [(r.pos, r.file_id) for r in tracebacks.match_frames(fr, fs, "id").collect()] == [(0, "n1")]


def test_python_entities():
    src = "class A(Base):\n    @staticmethod\n    def m(x): return x\n\n@app.get('/x/{i}')\nasync def f(i: int, *a, k=1, **kw) -> str:\n    'doc'\n    return g(self.h())\n"
    rows = {(r["entity_kind"], r["name"]): r for r in extract.python_entities("a.py", src)}
    assert rows[("Method", "m")]["parent"] == "A" and rows[("Class", "A")]["bases"] == ["Base"]
    f = rows[("Function", "f")]
    assert f["is_async"] and f["docstring"] == "doc" and f["params"] == ["i: int", "*a", "k", "**kw"] and f["calls"] == ["g", "h"]
    assert json.loads(rows[("Endpoint", "GET /x/{i}")]["extra"])["path"] == "/x/{i}"
    assert [r["entity_kind"] for r in extract.python_entities("a.py", "def (")] == ["Error"]


def test_react_entities():
    src = "export default function List(props: P) {\n  const [a] = useState(1);\n  axios.post('/api/u');\n  return <ul onClick={f}><li/></ul>;\n}\nconst util = (x) => x + 1;\n"
    (r,) = list(extract.react_entities("a.tsx", src))
    e = json.loads(r["extra"])
    assert r["name"] == "List" and e["hooks"] == ["useState"] and e["handlers"] == ["onClick"] and r["calls"] == ["POST /api/u"] and e["props_type"] == "P"


@pytest.mark.parametrize(
    ("path", "call", "props"),
    [
        ("a.jsx", "const load = async (id) => { await fetch('/api/rows'); };", ""),
        ("a.jsx", "const load = async(id);\n  fetch('/api/rows');", ""),
        ("a.tsx", "const load = async <T,>(id: T) => { await fetch('/api/rows'); };", "P"),
        ("a.tsx", "let xs: (A | B)[] = [];\n  fetch('/api/rows');", "P"),
    ],
)
def test_react_entities_with_async_and_parentheses(path, call, props):
    src = f"import React from 'react';\nexport function List(props{': P' if props else ''}) {{\n  {call}\n  return <ul/>;\n}}\n"
    one, two = extract.react_entities(path, src)
    e = json.loads(two["extra"])
    assert (one["entity_kind"], one["name"]) == ("Import", "react") and (two["entity_kind"], two["name"], two["start_line"]) == ("Component", "List", 2)
    assert two["calls"] == ["GET /api/rows"] and e["exported"] and e["props_type"] == props
    plain, error = ecma.read(src, bool(props), True)
    noted, same = ecma.read(src, bool(props), True, make=react.Recorder)
    assert error is same is None and plain.functions == noted.functions


def test_extract_and_diagram(spark):
    df = spark.createDataFrame([("k", "a.py", "class A(B):\n    def m(self): pass\n", 1), ("n", "b.py", None, 2), ("e", "c.py", "", 3)], "entity_id string, file_path string, content string, name int")
    rows = extract.extract_entities(df)
    assert {(r.key, r.entity_kind, r.name) for r in rows.collect()} == {("k", "Class", "A"), ("k", "Method", "m")}
    assert render.class_diagram(rows).first().text == "classDiagram\n    A : m()\n    B <|-- A"


def test_repository_scan(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src").mkdir()
    (tmp_path / "main.py").write_text("from fastapi import FastAPI\n")
    (tmp_path / "secret.py").write_text("x")
    (tmp_path / "src" / "App.tsx").write_text("import React from 'react';\n")
    (tmp_path / "node_modules" / "p.js").write_text("x")
    rows = files.read_repository(spark, str(tmp_path), "r", ["secret.py"])
    assert {r.file_path for r in rows.collect()} == {"main.py", "src/App.tsx"}
    p = files.project_profile(rows).first()
    assert (p.languages, p.frameworks, p.project_type) == (["python", "typescript"], ["fastapi", "react"], "fullstack")


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    body = para("Head", "Heading1") + para("Text") + f"<w:tbl><w:tr><w:tc>{para('a')}</w:tc><w:tc>{para('b')}</w:tc></w:tr></w:tbl>"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    (tmp_path / "a.docx").write_bytes(buffer.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"no")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.docx"].title == "Head" and rows["a.docx"].sections[0].content == "Text\na\tb" and rows["bad.docx"].error


def test_metadata_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("r", ["python"])], "name string, languages array<string>")
    files.write_metadata(df, str(tmp_path / "m"))
    assert files.read_metadata(spark, str(tmp_path / "m")).first().languages == ["python"]


def test_context_loop(spark):
    chunks = spark.createDataFrame([("1", "load_table", "Function", "a.py", "def load_table():\n  return read()"), ("2", "other", "Function", "b.py", "nothing here")], "id string, name string, type string, file string, code string")
    t = context_loop.answer(chunks, "where is load_table used", context_loop.Models(judge=lambda q, rows: (0.1, ""), rewrite=lambda q, f: q + " read"))
    assert t.iterations == 3 and t.queries[1].endswith("read") and "a.py" in t.answer


def test_call_tree(spark):
    from quarryline.operators import graph

    e = spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CALLS"), ("a", "c", "CALLS")], "src string, dst string, type string")
    assert render.call_tree(graph.paths(e, spark.createDataFrame([("a",)], "id string"), 2)) == ["a", "  b", "    c", "  c ↺"]


def test_stream(spark, tmp_path):
    from quarryline.streaming import ingest

    start = dt(2025, 1, 1)
    df = spark.createDataFrame([(n % 5, start + timedelta(hours=n % 5), "x", 1.0) for n in range(10)], "event_id int, ts timestamp_ntz, kind string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = ingest.deduplicated(ingest.file_stream(spark, str(tmp_path / "in"), df.schema), ["event_id"], "ts")
    rows = ingest.run_once(ingest.windowed_usage(s, "ts", "kind", "value", lateness=None), str(tmp_path / "c"), "complete")
    assert [(r.n, r.total) for r in rows.collect()] == [(5, 5.0)]
    seen = []
    t = spark.createDataFrame([("push", "r1"), ("ping", "r2"), ("push", "r1")], "event string, repository string")
    t.write.parquet(str(tmp_path / "t"))
    ingest.on_trigger(ingest.file_stream(spark, str(tmp_path / "t"), t.schema), seen.append, str(tmp_path / "c2")).awaitTermination()
    assert seen == [["r1"]]


def test_framework_vote_reads_whole_files(spark):
    from quarryline.operators.extract import framework_vote

    df = spark.createDataFrame([("# head\n" * 1000 + "from fastapi import FastAPI\napp = FastAPI()\n",), ("x = 1",)], "content string")
    assert [r[0] for r in df.select(framework_vote(df.content)).collect()] == ["fastapi", "python"]
    assert [r[0] for r in df.select(framework_vote(df.content, 5000)).collect()] == ["python", "python"]



def test_entry_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "p2_found" in e.queries()


def test_extracted_entities_of_a_table(spark, tmp_path):
    import __spark_entry__ as e

    rows = [
        ("repo:r:a.jsx", "File", "a.jsx", "import React from 'react';\nexport const A = async () => <p/>;\nconst b = async(1);\n"), ("repo:r:a.jsx", "File", "a.jsx", "import React from 'react';\nexport const A = async () => <p/>;\nconst b = async(1);\n"),
        ("repo:r:b.ts", "File", "b.ts", "import x from 'x';\nlet t: (A | B)[] = [];\nconst f = async <T>(y: T) => y;\n"), ("repo:s:c.py", "File", "c.py", "def f(): pass\n"), ("repo:s:c.py:f", "Function", "c.py", "def f(): pass\n"), ("repo:s:d.py", "File", "d.py", None),
    ]
    spark.createDataFrame(rows, "entity_id string, entity_type string, file_path string, content string").write.parquet(str(tmp_path / "search_results.parquet"))
    got = sorted(tuple(r) for r in e.queries()["extracted_entities"](spark, str(tmp_path)).collect())
    assert got == [("r", "Component", 1), ("r", "Import", 2), ("s", "Function", 1)]


def test_extracted_entities_of_deep_nesting(spark, tmp_path):
    import __spark_entry__ as e

    rows = [("repo:r:deep.py", "File", "deep.py", "-" * 100_000 + "1"), ("repo:r:b.py", "File", "b.py", "def f(): pass\n"), ("repo:r:c.js", "File", "c.js", "import 'x';\ny = " + "[" * 3000 + "]" * 3000 + ";\n")]
    spark.createDataFrame(rows, "entity_id string, entity_type string, file_path string, content string").write.parquet(str(tmp_path / "search_results.parquet"))
    assert sorted(tuple(r) for r in e.queries()["extracted_entities"](spark, str(tmp_path)).collect()) == [("r", "Error", 1), ("r", "Function", 1), ("r", "Import", 1)]
