"""Registered graph queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions.code_text import normalize_url, repository_name
from quarryline.operators import graph, tracebacks
from quarryline.operators.sized import distinct_wide
from quarryline.operators.retrieval import first_seen
from quarryline.plans import render
from quarryline.plans.fixtures import EDGE_TYPES, NODE_TYPES, SQL_EDGES, SQL_NODES, edges, nodes, of_type
from quarryline.plans.index_job import GraphBuild
from quarryline.session import table

_WITH = f"WITH RECURSIVE {SQL_NODES}, {SQL_EDGES}"


def find_nodes(spark, d):
    return graph.find_nodes(nodes(spark, d), type="Component")


def find_edges(spark, d):
    return graph.find_edges(edges(spark, d), type="CONTAINS")


def type_counts(spark, d):
    return graph.type_counts(nodes(spark, d), edges(spark, d), NODE_TYPES, EDGE_TYPES)


def schema_histogram(spark, d):
    return graph.schema_histogram(edges(spark, d), nodes(spark, d))


def neighbours_out(spark, d):
    n = nodes(spark, d)
    return graph.neighbours(edges(spark, d), n, of_type(n, "Repository", "File"))


def neighbours_both(spark, d):
    n = nodes(spark, d)
    return graph.neighbours(edges(spark, d), n, of_type(n, "File", "Component"), ["CONTAINS"], "both")


def sibling_files(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    files = of_type(n, "File")
    return graph.siblings(e.join(files.withColumnRenamed("id", "dst"), "dst", "left_semi"))


def induced_subgraph(spark, d):
    n = nodes(spark, d)
    return graph.induced(edges(spark, d), of_type(n, "Repository", "File", "Component")).select("src", "dst", "type")


def upsert_edges(spark, d):
    logs, users, feedback = (table(spark, d, t) for t in ("chat_logs", "users", "feedback"))
    ids = logs.select(F.concat(F.lit("log:"), F.col("id").cast("string")).alias("id")).unionByName(users.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("id")))
    e = logs.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("src"), F.concat(F.lit("log:"), F.col("id").cast("string")).alias("dst"), F.lit("ASKED").alias("type"))
    f = feedback.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("src"), F.concat(F.lit("log:"), F.col("log_id").cast("string")).alias("dst"), F.lit("RATED").alias("type"))
    return graph.upsert_edges(e.unionByName(f), ids).select("src", "dst", "type")


def upsert_nodes(spark, d):
    """Three versions of the nodes, the later of which replace some of the first."""
    rows = table(spark, d, "search_results").select(F.col("entity_id").alias("id"), F.col("entity_type").alias("type")).distinct()
    some = rows.where("type in ('Function', 'Class')")
    return graph.upsert_nodes(rows.withColumn("version", F.lit("first")), some.withColumn("version", F.lit("second")), some.where("type = 'Class'").withColumn("version", F.lit("third")))


def delete_repository(spark, d):
    return graph.delete_repository(table(spark, d, "search_results"), "russet-ledger", "entity_id").groupBy(repository_name(F.col("entity_id")).alias("repository")).agg(F.count("*").alias("n"))


def reach_out(spark, d):
    n = nodes(spark, d)
    return graph.reach(edges(spark, d), of_type(n, "Repository"), 3, ["CONTAINS", "CALLS"])


def reach_in(spark, d):
    n = nodes(spark, d)
    return graph.reach(edges(spark, d), of_type(n, "Model"), 2, ["CALLS", "USES_MODEL"], "in").groupBy("start", "distance").agg(F.count("*").alias("n"))


def paths_to_components(spark, d):
    n = nodes(spark, d)
    found = graph.paths(edges(spark, d), of_type(n, "Repository"), 2, ["CONTAINS"], ends=of_type(n, "Component"))
    return graph.first_paths(found, 10).select("start", "id", F.array_join("nodes", ">").alias("path"), "length")


def call_fan_in(spark, d):
    n = nodes(spark, d)
    return graph.fan_in_of_two(edges(spark, d), of_type(n, "Class"), ["CALLS", "USES_MODEL"])


def shortest_paths(spark, d):
    n = nodes(spark, d)
    e = edges(spark, d).where("type = 'CONTAINS'")
    return graph.shortest_path_lengths(e, of_type(n, "Repository"), of_type(n, "Component"), 4).select("start", "id", "distance")


def containment_closure(spark, d):
    n = nodes(spark, d)
    found = graph.paths(edges(spark, d), of_type(n, "Repository"), 3, ["CONTAINS"])
    return found.join(n.select("id", "type"), "id").groupBy("start", "type").agg(F.count("*").alias("n"))


def _calls(spark, d):
    rows = distinct_wide(table(spark, d, "search_results").where(F.col("content").isNotNull()).select("entity_id", "content"), ["entity_id"], "content")
    urls = rows.select("entity_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"fetch\('([^']+)'"), 1))).alias("raw"))
    return urls.select(F.concat_ws("#", "entity_id", "raw").alias("id"), F.lit("GET").alias("method"), normalize_url(F.col("raw")).alias("url"))


def _endpoints(spark, d):
    rows = distinct_wide(table(spark, d, "search_results").where(F.col("content").isNotNull()).select("entity_id", "content"), ["entity_id"], "content")
    found = rows.select("entity_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r'@(?:app|router)\.(?:get|post|put|patch|delete)\("[^"]+"'), 0))).alias("raw"))
    return found.select(F.concat_ws("#", "entity_id", "raw").alias("id"), F.upper(F.regexp_extract("raw", r"\.(\w+)\(", 1)).alias("method"), normalize_url(F.regexp_extract("raw", r'"([^"]+)"', 1)).alias("path"))


def link_calls(spark, d):
    """Links per path: how many calls and endpoints meet, without expanding them into pairs."""
    calls, ends = _calls(spark, d).groupBy("url", "method").agg(F.count("*").alias("calls")), _endpoints(spark, d).groupBy("path", "method").agg(F.count("*").alias("endpoints"))
    c = calls.select(F.concat_ws(" ", "method", "url").alias("id"), "method", "url", "calls")
    e = ends.select(F.concat_ws(" ", "method", "path").alias("id"), "method", "path", "endpoints")
    links = graph.link_calls(c, e)
    return links.join(c.select(F.col("id").alias("src"), "calls"), "src").join(e.select(F.col("id").alias("dst"), "endpoints"), "dst").select("src", "dst", "confidence", "calls", "endpoints")


def orphan_calls(spark, d):
    calls, ends = _calls(spark, d), _endpoints(spark, d)
    keyed = calls.select(F.concat_ws(" ", "method", "url").alias("id"), "method", "url").distinct()
    links = graph.link_calls(keyed, ends.select(F.concat_ws(" ", "method", "path").alias("id"), "method", "path").distinct())
    return graph.orphan_calls(keyed, links).select("method", "url")


def _functions(spark, d):
    rows = table(spark, d, "search_results").where(F.col("entity_type").isin("Function", "Method") & F.col("name").isNotNull())
    return rows.select(F.col("entity_id").alias("id"), F.col("name").alias("function_name"), repository_name(F.col("entity_id")).alias("repository"), F.col("entity_id").alias("seq")).distinct()


def _frames(spark, d):
    """The frames of all tracebacks, and one of every file and function as a traceback would name it."""
    rows = table(spark, d, "tracebacks").select(F.col("traceback_id").cast("string").alias("traceback_id"), "repository", F.posexplode("frames").alias("pos", "f"))
    own = table(spark, d, "search_results").where(F.col("entity_type").isin("Function", "Method", "File"))
    own = own.select(F.col("entity_id").alias("traceback_id"), repository_name(F.col("entity_id")).alias("repository"), F.lit(0).alias("pos"), F.concat(F.lit("/app/"), "file_path").alias("file_path"), F.col("name").alias("function_name")).distinct()
    return rows.select("traceback_id", "repository", "pos", "f.file_path", "f.function_name").dropDuplicates(["traceback_id", "pos"]).unionByName(own)


def resolve_frames(spark, d):
    """Each frame's function: the first of that name in its own repository, else the first anywhere."""
    frames, functions = _frames(spark, d).select("traceback_id", "pos", "repository", "function_name"), _functions(spark, d)
    anywhere = functions.groupBy("function_name").agg(F.min_by(F.struct("id", "seq"), "seq").alias("s")).select("function_name", "s.*")
    own = functions.groupBy("function_name", "repository").agg(F.min_by(F.struct("id", "seq"), "seq").alias("s")).select("function_name", "repository", "s.*")
    return graph.resolve_first(frames, "function_name", [(own, ["function_name", "repository"], 0), (anywhere, "function_name", 1)], ["traceback_id", "pos"])


def match_frames(spark, d):
    rows = table(spark, d, "search_results").where("entity_type = 'File'").select(F.col("entity_id").alias("id"), F.col("file_path").alias("path")).distinct()
    return tracebacks.match_frames(_frames(spark, d).select("traceback_id", "pos", "file_path"), rows, "traceback_id")


def indexed_graph(spark, d):
    """Node and edge counts of the graph that the indexing job builds of all source files."""
    rows = distinct_wide(table(spark, d, "search_results").where("entity_type = 'File'").select(repository_name(F.col("entity_id")).alias("repository"), "file_path", "content"), ["repository", "file_path"], "content")
    return GraphBuild(rows).stats()


def schema_diagram(spark, d):
    return render.schema_graph(schema_histogram(spark, d))


def _values(xs):
    return ", ".join(f"('{x}')" for x in xs)


_URL = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({u}, '\\?.*$', ''), '/+$', ''), '\\$\\{{[^}}]+\\}}', '{{param}}', 'g'), ':[a-zA-Z_]\\w*', '{{param}}', 'g'), '<[^>]+>', '{{param}}', 'g'), '\\{{[^}}]+\\}}', '{{param}}', 'g')"""


def sql_url(u: str) -> str:
    base = _URL.format(u=u)
    parts = f"list_transform(string_split({base}, '/'), lambda s: CASE WHEN regexp_full_match(s, '[0-9]+|[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}') THEN '{{param}}' ELSE s END)"
    return f"regexp_replace(array_to_string({parts}, '/'), '/+', '/', 'g')"


_SQL_API = rf"""WITH texts AS (SELECT DISTINCT entity_id, content FROM search_results WHERE content IS NOT NULL),
calls AS (SELECT entity_id, {sql_url('raw')} AS url FROM (SELECT entity_id, unnest(list_distinct(regexp_extract_all(content, 'fetch\(''([^'']+)''', 1))) AS raw FROM texts)),
ends AS (SELECT entity_id, upper(regexp_extract(raw, '\.(\w+)\(', 1)) AS method, {sql_url("regexp_extract(raw, '\"([^\"]+)\"', 1)")} AS path
  FROM (SELECT entity_id, unnest(list_distinct(regexp_extract_all(content, '@(?:app|router)\.(?:get|post|put|patch|delete)\("[^"]+"', 0))) AS raw FROM texts)),
c AS (SELECT url, count(*) AS calls FROM calls GROUP BY url), e AS (SELECT path, method, count(*) AS endpoints FROM ends GROUP BY path, method)
"""
_SQL_FRAMES = "frames AS (SELECT DISTINCT traceback_id::VARCHAR AS traceback_id, repository, i - 1 AS pos, frames[i].file_path AS file_path, frames[i].function_name AS function_name FROM (SELECT traceback_id, repository, frames, unnest(range(1, len(frames) + 1)) AS i FROM tracebacks) UNION ALL SELECT DISTINCT entity_id, split_part(entity_id, ':', 2), 0, '/app/' || file_path, name FROM search_results WHERE entity_type IN ('Function', 'Method', 'File'))"
_PARTS = """CASE WHEN len(list_filter(string_split(p, '/'), lambda x: x <> '')) > 3 THEN array_to_string(list_filter(string_split(p, '/'), lambda x: x <> '')[-3:], '/') ELSE p END"""

QUERIES = {
    "find_nodes": find_nodes, "find_edges": find_edges, "type_counts": type_counts, "schema_histogram": schema_histogram, "neighbours_out": neighbours_out, "neighbours_both": neighbours_both, "sibling_files": sibling_files,
    "induced_subgraph": induced_subgraph, "upsert_edges": upsert_edges, "upsert_nodes": upsert_nodes, "delete_repository": delete_repository, "reach_out": reach_out, "reach_in": reach_in, "paths_to_components": paths_to_components,
    "call_fan_in": call_fan_in, "shortest_paths": shortest_paths, "containment_closure": containment_closure, "link_calls": link_calls, "orphan_calls": orphan_calls, "resolve_frames": resolve_frames, "match_frames": match_frames,
    "schema_diagram": schema_diagram, "indexed_graph": indexed_graph,
}
ORACLES = {
    "find_nodes": f"{_WITH} SELECT * FROM nodes WHERE type = 'Component' ORDER BY id LIMIT 100",
    "find_edges": f"{_WITH} SELECT * FROM edges WHERE type = 'CONTAINS'",
    "type_counts": f"""{_WITH} SELECT 'node' AS kind, t.type, count(n.id) AS n FROM (VALUES {_values(NODE_TYPES)}) t(type) LEFT JOIN nodes n ON n.type = t.type GROUP BY t.type
      UNION ALL SELECT 'node', 'total', count(*) FROM nodes UNION ALL SELECT 'edge', t.type, count(e.src) FROM (VALUES {_values(EDGE_TYPES)}) t(type) LEFT JOIN edges e ON e.type = t.type GROUP BY t.type
      UNION ALL SELECT 'edge', 'total', count(*) FROM edges""",
    "schema_histogram": f"{_WITH} SELECT a.type AS from_type, e.type AS type, b.type AS to_type, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst GROUP BY 1, 2, 3",
    "neighbours_out": f"{_WITH} SELECT e.src AS start, e.dst AS id, e.type AS type, n.type AS node_type, n.name AS name FROM edges e JOIN nodes s ON s.id = e.src AND s.type IN ('Repository', 'File') JOIN nodes n ON n.id = e.dst",
    "neighbours_both": f"""{_WITH}, b AS (SELECT src, dst, type FROM edges WHERE type = 'CONTAINS' UNION ALL SELECT dst, src, type FROM edges WHERE type = 'CONTAINS')
      SELECT e.src AS start, e.dst AS id, e.type AS type, n.type AS node_type, n.name AS name FROM b e JOIN nodes s ON s.id = e.src AND s.type IN ('File', 'Component') JOIN nodes n ON n.id = e.dst""",
    "sibling_files": f"{_WITH} SELECT a.src AS owner, a.dst AS id, b.dst AS sibling FROM edges a JOIN edges b ON a.src = b.src AND a.dst <> b.dst JOIN nodes x ON x.id = a.dst AND x.type = 'File' JOIN nodes y ON y.id = b.dst AND y.type = 'File' WHERE a.type = 'CONTAINS' AND b.type = 'CONTAINS'",
    "induced_subgraph": f"{_WITH}, k AS (SELECT id FROM nodes WHERE type IN ('Repository', 'File', 'Component')) SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)",
    "upsert_edges": """WITH ids AS (SELECT 'log:' || id AS id FROM chat_logs UNION SELECT 'user:' || user_id FROM users),
      e AS (SELECT 'user:' || user_id AS src, 'log:' || id AS dst, 'ASKED' AS type FROM chat_logs UNION SELECT 'user:' || user_id, 'log:' || log_id, 'RATED' FROM feedback)
      SELECT DISTINCT * FROM e WHERE src IN (SELECT id FROM ids WHERE id IS NOT NULL) AND dst IN (SELECT id FROM ids WHERE id IS NOT NULL)""",
    "upsert_nodes": "SELECT DISTINCT entity_id AS id, entity_type AS type, CASE entity_type WHEN 'Class' THEN 'third' WHEN 'Function' THEN 'second' ELSE 'first' END AS version FROM search_results",
    "delete_repository": "SELECT split_part(entity_id, ':', 2) AS repository, count(*) AS n FROM search_results WHERE split_part(entity_id, ':', 2) <> 'russet-ledger' GROUP BY 1",
    "reach_out": f"""{_WITH}, w AS (SELECT id AS start, id, 0 AS distance FROM nodes WHERE type = 'Repository'
      UNION SELECT w.start, e.dst, w.distance + 1 FROM w JOIN edges e ON e.src = w.id AND e.type IN ('CONTAINS', 'CALLS') WHERE w.distance < 3)
      SELECT start, id, min(distance) AS distance FROM w GROUP BY 1, 2 HAVING min(distance) >= 1""",
    "reach_in": f"""{_WITH}, one AS (SELECT DISTINCT dst AS start, src AS id FROM edges WHERE type = 'USES_MODEL'), two AS (SELECT DISTINCT o.start, e.src AS id FROM one o JOIN edges e ON e.dst = o.id AND e.type = 'CALLS')
      SELECT start, 1 AS distance, count(*) AS n FROM one GROUP BY 1 UNION ALL SELECT start, 2, count(*) FROM two GROUP BY 1""",
    "paths_to_components": f"""{_WITH}, p AS (SELECT a.src AS start, b.dst AS id, a.src || '>' || a.dst || '>' || b.dst AS path, 2 AS length FROM edges a JOIN edges b ON b.src = a.dst AND b.type = 'CONTAINS' JOIN nodes s ON s.id = a.src AND s.type = 'Repository' JOIN nodes n ON n.id = b.dst AND n.type = 'Component' WHERE a.type = 'CONTAINS')
      SELECT start, id, path, length FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY length, path) AS r FROM p) WHERE r <= 10""",
    "call_fan_in": f"""{_WITH}, two AS (SELECT a.dst AS x, b.dst AS y FROM edges a JOIN edges b ON b.src = a.dst AND b.type = 'USES_MODEL' WHERE a.type = 'CALLS')
      SELECT id, count(*) AS fan_in FROM (SELECT dst AS id FROM edges WHERE type = 'CALLS' UNION ALL SELECT x FROM two UNION ALL SELECT y FROM two) GROUP BY id""",
    "shortest_paths": f"""{_WITH}, b AS (SELECT src, dst FROM edges WHERE type = 'CONTAINS' UNION SELECT dst, src FROM edges WHERE type = 'CONTAINS'),
      w AS (SELECT id AS start, id, 0 AS distance FROM nodes WHERE type = 'Repository' UNION SELECT w.start, b.dst, w.distance + 1 FROM w JOIN b ON b.src = w.id WHERE w.distance < 4)
      SELECT start, id, min(distance) AS distance FROM w WHERE id LIKE 'repo:supplier:%' GROUP BY 1, 2""",
    "containment_closure": f"""{_WITH}, w AS (SELECT id AS start, id, 0 AS n FROM nodes WHERE type = 'Repository' UNION ALL SELECT w.start, e.dst, w.n + 1 FROM w JOIN edges e ON e.src = w.id AND e.type = 'CONTAINS' WHERE w.n < 3)
      SELECT w.start, x.type, count(*) AS n FROM w JOIN nodes x ON x.id = w.id WHERE w.n > 0 GROUP BY 1, 2""",
    "link_calls": _SQL_API + """SELECT 'GET ' || c.url AS src, e.method || ' ' || e.path AS dst, max(CASE WHEN e.path = c.url THEN 1.0::DOUBLE WHEN e.method = 'ANY' THEN 0.7::DOUBLE ELSE 0.85::DOUBLE END) AS confidence, max(c.calls) AS calls, max(e.endpoints) AS endpoints
      FROM c JOIN e ON (e.path = c.url OR e.path = c.url || '/{param}' OR e.path = c.url || '{param}') AND e.method IN ('GET', 'ANY') WHERE c.url NOT IN ('', '/') GROUP BY 1, 2""",
    "orphan_calls": _SQL_API + """SELECT 'GET' AS method, c.url FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE (e.path = c.url OR e.path = c.url || '/{param}' OR e.path = c.url || '{param}') AND e.method IN ('GET', 'ANY') AND c.url NOT IN ('', '/'))""",
    "resolve_frames": f"""WITH {_SQL_FRAMES}, fn AS (SELECT DISTINCT entity_id AS id, name AS function_name, split_part(entity_id, ':', 2) AS repository FROM search_results WHERE entity_type IN ('Function', 'Method') AND name IS NOT NULL),
      hit AS (SELECT f.traceback_id, f.pos, f.function_name, n.id AS target, CASE WHEN n.repository = f.repository THEN 0 ELSE 1 END AS priority FROM frames f JOIN fn n USING (function_name))
      SELECT traceback_id, pos::INTEGER AS pos, function_name, target, priority FROM (SELECT *, row_number() OVER (PARTITION BY traceback_id, pos, function_name ORDER BY priority, target) AS r FROM hit) WHERE r = 1""",
    "match_frames": f"""WITH {_SQL_FRAMES}, s0 AS (SELECT traceback_id, pos, file_path AS p FROM frames), s1 AS (SELECT traceback_id, pos, regexp_replace(p, '^/app/', '') AS p FROM s0), s2 AS (SELECT traceback_id, pos, regexp_replace(p, '^/src/', '') AS p FROM s1),
      s3 AS (SELECT traceback_id, pos, regexp_replace(p, '^/code/', '') AS p FROM s2), s4 AS (SELECT traceback_id, pos, regexp_replace(p, '^app/', '') AS p FROM s3), s5 AS (SELECT traceback_id, pos, regexp_replace(p, '^src/', '') AS p FROM s4), s6 AS (SELECT traceback_id, pos, regexp_replace(p, '^code/', '') AS p FROM s5),
      s7 AS (SELECT traceback_id, pos, regexp_replace(regexp_replace(p, '^\\./', ''), '^\\.\\./', '') AS p FROM s6), k AS (SELECT traceback_id, pos, {_PARTS} AS suffix FROM s7),
      files AS (SELECT DISTINCT entity_id AS id, file_path AS path FROM search_results WHERE entity_type = 'File'), sx AS (SELECT id, path, unnest(range(1, least(3, len(string_split(path, '/'))) + 1)) AS n FROM files),
      keys AS (SELECT id, array_to_string(string_split(path, '/')[-n:], '/') AS suffix FROM sx)
      SELECT k.traceback_id, k.pos::INTEGER AS pos, min(keys.id) AS file_id FROM k JOIN keys USING (suffix) GROUP BY 1, 2""",
}
