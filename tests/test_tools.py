import pytest

from quarryline.plans import tools
from quarryline.sources import git


@pytest.fixture(scope="module")
def index(spark):
    nodes = spark.createDataFrame([("a", "Function", "load", "x/a.py"), ("b", "Class", "Row", "x/b.py")], "id string, type string, name string, file_path string")
    edges = spark.createDataFrame([("a", "b", "CALLS")], "src string, dst string, type string")
    files = spark.createDataFrame([("x/a.py", "def load():\n    return Row()\n"), ("y.py", "z")], "file_path string, content string")
    return tools.Index(nodes, edges, files)


def test_tools(index):
    assert [r.id for r in tools.search_names(index, "load").collect()] == ["a"]
    assert [r.file_path for r in tools.list_files(index, "x").collect()] == ["x/a.py"]
    assert tools.read_file(index, "x/a.py", 2).first().text.strip() == "return Row()"
    assert [r.id for r in tools.neighbours(index, "b").collect()] == ["a"]
    assert tools.path(index, "b", "a").first().distance == 1
    with pytest.raises(ValueError):
        tools.read_file(index, "../x")


def test_explore(index):
    turns = iter([[("grep", {"token": "Row"}), ("semantic", {"query": "load"})], []])
    out = tools.explore(index, "q", lambda q, seen: next(turns))
    assert out.stopped == "done" and out.summary()["calls"] == 2 and out.summary()["rows"] == 2


def test_read_only(index):
    assert tools.run_read_only(index, "SELECT count(*) AS n FROM nodes WHERE name <> 'drop table'").first().n == 2
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a"):
        with pytest.raises(ValueError):
            tools.run_read_only(index, bad)


def test_local_checkout(tmp_path):
    assert git.is_url("git@h:x/y.git") and not git.is_url("/tmp")
    assert git.checkout(str(tmp_path), "unused")["name"] == tmp_path.name
    with pytest.raises(NotADirectoryError):
        git.checkout(str(tmp_path / "no"), "unused")
