import hashlib

from pyspark.sql import functions as F

from quarryline.operators import graph
from quarryline.plans.index_job import GraphBuild

FILES = {
    "backend/models.py": "from django.db import models\n\nclass User(models.Model):\n    username = models.CharField(max_length=9)\n\nclass Post(models.Model):\n    author = models.ForeignKey(User, on_delete=models.CASCADE)\n",
    "backend/views.py": "from fastapi import APIRouter\nfrom backend.models import User\nrouter = APIRouter()\n\ndef helper(x):\n    return x\n\n@router.get('/api/users')\ndef list_users():\n    return helper(User.objects)\n\n@router.post('/api/users')\ndef create_user(user: User):\n    return helper(user)\n\n@router.get('/api/users/{user_id}')\ndef get_user(user_id: int):\n    return 1\n",
    "frontend/UserList.jsx": "import React from 'react';\nexport function UserList() {\n  fetch('/api/users');\n  fetch('/api/none');\n  return <ul/>;\n}\n",
    "frontend/App.jsx": "import React from 'react';\nexport function App() {\n  return <Route path=\"/users\" element={<UserList />} />;\n}\n",
    "bad.py": "def (",
    "empty.py": "",
}


def test_two_tier_repository(spark, tmp_path):
    df = spark.createDataFrame([("demo", p, t) for p, t in FILES.items()] + [("demo", "null.py", None)], "repository string, file_path string, content string")
    g = GraphBuild(df)
    stats = {(r.kind, r.type): r.n for r in g.stats().collect()}
    assert stats["node", "Endpoint"] == 3 and stats["node", "Model"] == 2 and stats["node", "Component"] == 2 and stats["node", "ApiCall"] == 2 and stats["node", "File"] == 6
    e = {(r.src.rpartition("demo:")[2], r.type, r.dst.rpartition("demo:")[2]) for r in g.edges.collect()}
    assert ("backend/models.py:Post", "FOREIGN_KEY", "backend/models.py:User") in e
    assert ("backend/views.py:list_users", "CALLS", "backend/views.py:helper") in e
    assert ("backend/views.py", "IMPORTS", "backend/models.py") in e
    assert ("frontend/UserList.jsx:UserList#call0", "CALLS_ENDPOINT", "backend/views.py:GET /api/users") in e
    assert ("backend/views.py:GET /api/users", "HANDLES_REQUEST", "backend/views.py:list_users") in e
    assert ("backend/views.py:create_user", "USES_MODEL", "backend/models.py:User") in e
    assert ("frontend/UserList.jsx:UserList", "RENDERS_AT", "frontend/App.jsx:/users") in e
    assert {(r.src.rpartition("#")[2], r.confidence) for r in g.links.collect()} == {("call0", 1.0), ("call0", 0.85)}
    g.write(str(tmp_path / "index"))
    back = spark.read.parquet(str(tmp_path / "index" / "chunks"))
    assert back.count() == g.nodes.where("type not in ('File', 'Repository')").count() and len(back.first().embedding) == 64


WIRED = {
    "app/views.py": "from rest_framework.views import APIView\nfrom rest_framework.viewsets import GenericViewSet\n\nclass UserView(APIView):\n    def get(self, request):\n        return 1\n\nclass ItemView(APIView):\n    def get(self, request):\n        return 1\n    def post(self, request):\n        return 2\n\nclass SetView(GenericViewSet):\n    pass\n",
    "app/urls.py": "from django.urls import path\nfrom app.views import UserView, ItemView\nurlpatterns = [path('users/', UserView.as_view()), path('items/<int:pk>/', ItemView.as_view())]\n",
    "project/urls.py": "from django.urls import path, include\nurlpatterns = [path('api/v1/', include('app.urls'))]\n",
    "web/Users.jsx": "import React from 'react';\nconst BASE = '/api/v1';\nconst LIST = BASE + '/users/';\nexport function Users() {\n  fetch(LIST);\n  api.post(`/api/v1/items/${id}/`);\n  axios({ url: '/api/v1/nothing', method: 'delete' });\n  return <ul/>;\n}\n",
}


def test_endpoints_are_wired(spark):
    g = GraphBuild(spark.createDataFrame([("demo", p, t) for p, t in WIRED.items()], "repository string, file_path string, content string"))
    ends = {(r.method, r.path) for r in g.endpoints().collect()}
    assert ("GET", "/api/v1/users") in ends and any(m == "ANY" and p.startswith("/api/v1/items/") for m, p in ends)
    nodes = {(r.type, r.id.rpartition("demo:")[2]) for r in g.nodes.collect()}
    assert {("Class", "app/views.py:UserView"), ("Class", "app/views.py:SetView"), ("Component", "web/Users.jsx:Users")} <= nodes
    edges = {(r.src.rpartition("demo:")[2], r.type, r.dst.rpartition("demo:")[2]) for r in g.edges.collect()}
    assert ("web/Users.jsx:Users#call0", "CALLS_ENDPOINT", "app/urls.py:GET /api/v1/users/") in edges
    assert ("app/urls.py:GET /api/v1/users/", "HANDLES_REQUEST", "app/views.py:UserView") in edges
    assert {s for s, t, _ in edges if t == "CALLS_ENDPOINT"} == {"web/Users.jsx:Users#call0", "web/Users.jsx:Users#call1"}
    lost = graph.orphans_with_owner(g.api_calls(), g.links, g.edges, g.nodes, 5).collect()
    assert [(r.method, r.url, r.owner) for r in lost] == [("DELETE", "/api/v1/nothing", "Users")]
    rows, kept = graph.delete_repository_graph(g.nodes, g.edges, "demo")
    assert rows.count() == 0 and kept.count() == 0
    code = {r.id.rpartition("demo:")[2]: r.code for r in g.code_of(10).collect()}
    assert code["app/views.py:UserView"] == "class User"


def test_async_arrows_and_parenthesised_types_are_indexed(spark):
    web = "import React from 'react';\nexport function Load(props: P) {\n  let xs: (string | number)[] = [];\n  const load = async (id) => { await fetch('/api/users'); };\n  return <ul/>;\n}\n"
    g = GraphBuild(spark.createDataFrame([("demo", "backend/views.py", FILES["backend/views.py"]), ("demo", "web/Load.tsx", web)], "repository string, file_path string, content string"))
    edges = {(r.src.rpartition("demo:")[2], r.type, r.dst.rpartition("demo:")[2]) for r in g.edges.collect()}
    assert {("web/Load.tsx", "CONTAINS", "web/Load.tsx:Load"), ("web/Load.tsx:Load", "MAKES_CALL", "web/Load.tsx:Load#call0"), ("web/Load.tsx:Load#call0", "CALLS_ENDPOINT", "backend/views.py:GET /api/users")} <= edges


def test_indexed_graph_of_a_table(spark, tmp_path):
    import __spark_entry__ as e

    web = "import React from 'react';\nexport const Load = async (props) => {\n  const load = async (id) => { await fetch('/api/users'); };\n  return <ul/>;\n};\n"
    rows = [("repo:demo:backend/views.py", "File", "backend/views.py", FILES["backend/views.py"])] + [("repo:demo:web/Load.jsx", "File", "web/Load.jsx", web)] * 2 + [("repo:demo:web/Load.jsx:Load", "Component", "web/Load.jsx", web)]
    spark.createDataFrame(rows, "entity_id string, entity_type string, file_path string, content string").write.parquet(str(tmp_path / "search_results.parquet"))
    # The call meets the list endpoint and, as a list variant, the one with a parameter.
    got = {(r.kind, r.type): r.n for r in e.queries()["indexed_graph"](spark, str(tmp_path)).collect()}
    assert got == {("node", "Repository"): 1, ("node", "File"): 2, ("node", "Function"): 4, ("node", "Endpoint"): 3, ("node", "Component"): 1, ("node", "ApiCall"): 1, ("edge", "CONTAINS"): 10, ("edge", "CALLS"): 2, ("edge", "HANDLES_REQUEST"): 3, ("edge", "MAKES_CALL"): 1, ("edge", "CALLS_ENDPOINT"): 2}


def test_contents_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(text):
        read.add(1)
        return text

    df = spark.createDataFrame([("demo", p, t) for p, t in FILES.items()], "repository string, file_path string, content string")
    g = GraphBuild(df.withColumn("content", F.udf(counted, "string").asNondeterministic()("content")))
    assert {(r.kind, r.type): r.n for r in g.stats().collect()}["node", "File"] == 6 and read.value == len(FILES)


def test_file_rows(spark):
    df = spark.createDataFrame([("demo", "src\\a.md", "\u00e9\n\U0001f600\n"), ("de:mo", "e.py", "")], "repository string, file_path string, content string")
    g = GraphBuild(df)
    rows = {r.id: (r.name, r.repository, r.end_line, r.extra) for r in g.nodes.where("type = 'File'").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert rows == {
        "repo:demo:src/a.md": ("src\\a.md", "demo", 3, f'{{"content_hash":"{sha("\u00e9\n\U0001f600\n")}","size":4,"line_count":3}}'),
        "repo:de:mo:e.py": ("e.py", "de:mo", 1, f'{{"content_hash":"{sha("")}","size":0,"line_count":1}}'),
    }


def test_contents_of_one_path_give_the_same_graph_in_any_order(spark):
    rows = [("demo", "a.py", "class A:\n    pass\n"), ("demo", "a.py", "class A(models.Model):\n    x = models.IntegerField()\n"), ("demo", "b.py", "from a import A\ndef f():\n    return A()\n"), ("demo", "a.py", "def A():\n    return 1\n")]
    graphs = []
    for order in (rows, rows[::-1], [rows[1], rows[3], rows[0], rows[2]]):
        g = GraphBuild(spark.createDataFrame(order, "repository string, file_path string, content string").coalesce(1))
        graphs.append((sorted(map(str, g.nodes.collect())), sorted((r.src, r.type, r.dst) for r in g.edges.collect())))
    assert graphs[0] == graphs[1] == graphs[2] and len(graphs[0][0]) == 5
