"""Registered queries of context building, routing and caches, and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryline.operators import cache, expand, graph, lines
from quarryline.operators.sized import distinct_wide
from quarryline.plans import agents, retriever
from quarryline.plans.fixtures import SQL_EDGES, SQL_NODES, edges, nodes, of_type
from quarryline.session import table

_WITH = f"WITH RECURSIVE {SQL_NODES}, {SQL_EDGES}"


def _files(spark, d):
    return distinct_wide(table(spark, d, "search_results").select("entity_id", "entity_type", "name", "file_path", "content"), ["entity_id", "entity_type", "name", "file_path"], "content")


def _chunks(spark, d):
    """Context rows of as many questions as there are repositories: files as grep hits, all else as primary hits."""
    best = table(spark, d, "search_results").groupBy("entity_id", "entity_type", "file_path").agg(F.max("score").alias("score"))
    kind = F.when(F.col("entity_type") == "File", "grep").otherwise("primary")
    return best.select(F.split_part("entity_id", F.lit(":"), F.lit(2)).alias("query_id"), F.col("entity_id").alias("id"), F.col("entity_type").alias("type"), F.col("file_path").alias("file"), "score", kind.alias("source"))


def context_anchors(spark, d):
    """The anchors of each question: rows in files with grep hits first, then by kind and score."""
    return expand.select_anchors(_chunks(spark, d)).select("query_id", "id", "type", "anchor")


def related_lists(spark, d):
    n = nodes(spark, d)
    rows = expand.with_related(n, edges(spark, d), of_type(n, "Repository", "File"))
    return rows.select("id", "name", F.size("related").alias("n"), F.md5(F.array_join(F.transform("related", lambda x: x["id"]), ",")).alias("ids"), F.array_join("distinct_types", ",").alias("types"))


def related_nodes(spark, d):
    """Nodes within two CONTAINS hops, once for each sequence of edge types, by distance and name, 100 of each start."""
    n = nodes(spark, d)
    return graph.related(edges(spark, d), n, of_type(n, "Repository"), 2, ["CONTAINS"]).select("start", "id", "name", F.array_join("rel_types", ">").alias("rel_types"), "distance")


def shortest_path_nodes(spark, d):
    """The path of each repository to each of its classes."""
    n = nodes(spark, d)
    return graph.shortest_paths(edges(spark, d).where("type = 'CONTAINS'"), of_type(n, "Repository"), of_type(n, "Class"), 2).select("start", "id", F.array_join("nodes", ">").alias("path"), "distance")


def sibling_classes(spark, d):
    """The first 25 classes beside each class, by name."""
    n = nodes(spark, d)
    classes = n.where("type = 'Class'")
    inside = edges(spark, d).where("type = 'CONTAINS'").join(classes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return graph.siblings(inside, order=classes.select("id", F.col("name").alias("pos")), most=25)


def model_users(spark, d):
    """The first callees of each class by the paths of calls from it."""
    n = nodes(spark, d)
    starts = of_type(n, "Class").select(F.col("id").alias("start"))
    return expand.top_nodes(expand.call_paths(edges(spark, d), starts, 30, 1), n).select("start", "id", "rel", "pos")


def repository_deletion(spark, d):
    """What is left of the graph by kind when one repository is deleted with all it contains."""
    n, e = graph.delete_repository_graph(nodes(spark, d), edges(spark, d), "region:1")
    return n.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "type", "n").unionByName(e.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "type", "n"))


def requested_entities(spark, d):
    n = nodes(spark, d)
    wanted = n.where("type in ('Repository', 'File')").select("id").unionByName(table(spark, d, "nation").select(F.concat(F.lit("repo:lost:"), F.col("n_nationkey").cast("string")).alias("id")))
    return expand.fetch_entities(n, wanted)


def result_shapes(spark, d):
    rows = table(spark, d, "search_results").groupBy("entity_id", "entity_type", "content").agg(F.max("name").alias("name"), F.max("score").alias("score"))
    out = retriever.api_results(rows)
    return out.select("entity_id", "entity_type", "name", "file_path", F.md5("content").alias("digest"), "score")


def fact_texts(spark, d):
    return retriever.fact_rows(table(spark, d, "nation").select("n_name", "n_regionkey")).select("name", "code", "source")


def searched_types(spark, d):
    q = table(spark, d, "chat_logs").where("question is not null").select("id", "question").distinct()
    return q.select("id", F.array_join(retriever.scope_types(F.col("question")), ",").alias("types"), retriever.tool_strategy(F.col("question")).alias("strategy"))


def question_subjects(spark, d):
    q = table(spark, d, "chat_logs").where("question is not null").select("id", "question").distinct()
    return q.select("id", agents.question_entity(F.col("question")).alias("entity"), agents.diagram_entity(F.col("question")).alias("drawn"))


def entity_routes(spark, d):
    """The first routes in each repository's code that name what its questions are taken to be about."""
    order = Window.partitionBy("query_id").orderBy("entity_id")
    rows = _files(spark, d).where("content is not null").select(F.split_part("entity_id", F.lit(":"), F.lit(2)).alias("query_id"), "entity_id", F.col("content").alias("code"), F.lit("api").alias("entity"))
    return agents.mined_routes(rows.withColumn("pos", F.row_number().over(order)), "entity")


def matching_lines(spark, d):
    """Lines of documents that a pattern matches as a whole, once each document and line."""
    ln = lines.line_table(table(spark, d, "documents"), "doc_id", "text")
    return ln.where(retriever.matches_whole(F.col("line"), r"\b[A-Z]\w+Error\b")).select("doc_id", "line_no", "line")


def context_sources(spark, d):
    c = _chunks(spark, d)
    return retriever.sources(c.where("source = 'primary'"), c.where("source = 'grep'"), most=20)


def cached_questions(spark, d):
    """Questions asked again within a day of the first time, by month."""
    logs = table(spark, d, "chat_logs").where("question is not null and created_at is not null").select("id", "question", "created_at").distinct()
    made = logs.groupBy("question").agg(F.min("created_at").alias("created_at"), F.min("id").cast("string").alias("value"))
    store = cache.put(cache.entries(made.limit(0), "query", "question", "value", "created_at"), cache.entries(made, "query", "question", "value", "created_at"))
    asked = logs.withColumn("_key", cache.cache_key("query", F.col("question"))).join(store.select(F.col("key").alias("_key"), "created_at", "expires_at", "value").withColumnsRenamed({"created_at": "_made"}), "_key")
    hit = asked.withColumn("hit", (F.col("id").cast("string") != F.col("value")) & (F.col("created_at").cast("timestamp") < F.col("expires_at")))
    return cache.hit_rate(hit.withColumn("month", F.date_format("created_at", "yyyy-MM")), "month")


def reindex_state(spark, d):
    repos = table(spark, d, "repositories").where("name is not null")
    w = Window.partitionBy("name").orderBy(F.col("last_updated").desc_nulls_last(), F.col("commit_hash").asc_nulls_last())
    ranked = repos.withColumn("_r", F.row_number().over(w))
    older = ranked.where("_r = 2").select("name", "commit_hash", F.lit("in_progress").alias("status"))
    return cache.reindex_rollup(ranked.where("_r = 1"), older)


def merged_rows(spark, d):
    """Context of each repository: 40 primary and 30 other rows, each key once."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "id")
    c = _chunks(spark, d).withColumn("pos", F.row_number().over(w)).withColumn("name", F.element_at(F.split("file", "/"), -1))
    out = retriever.merged_context(c.where("source = 'primary'"), c)
    return out.select("query_id", "id", "source")


def routed_questions(spark, d):
    q = table(spark, d, "chat_logs").where("question is not null").select(F.col("id").alias("query_id"), F.col("question").alias("query")).distinct()
    return agents.routed(q).groupBy(F.array_join("agents", "+").alias("agents")).agg(F.count("*").alias("questions"))


NOW = datetime(2026, 1, 1)
QUERIES = {
    f.__name__: f
    for f in (context_anchors, related_lists, related_nodes, shortest_path_nodes, sibling_classes, model_users, repository_deletion, requested_entities, result_shapes, fact_texts, searched_types, question_subjects, entity_routes, matching_lines, context_sources, cached_questions, reindex_state, merged_rows, routed_questions)
}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _hits(words) -> str:
    return f"len(list_filter([{', '.join(map(_q, words))}], lambda k: contains(q, k)))"


_CHUNKS = "chunks AS (SELECT split_part(entity_id, ':', 2) AS query_id, entity_id AS id, entity_type AS type, file_path AS file, max(score) AS score, CASE WHEN entity_type = 'File' THEN 'grep' ELSE 'primary' END AS source FROM search_results GROUP BY ALL)"
_ASKED = "a AS (SELECT DISTINCT id, question, lower(question) AS q FROM chat_logs WHERE question IS NOT NULL)"


def _oracles() -> dict[str, str]:
    from quarryline.functions import fixed_values as fixed

    h, f, b = (_hits(w) for w in (fixed.HYBRID_WORDS, fixed.FRONTEND_WORDS, fixed.BACKEND_WORDS))
    dn, cn, vn = (_hits(w) for w in (fixed.DOCUMENT_WORDS, fixed.CODE_WORDS, fixed.VISUAL_WORDS))
    entity = "CASE " + " ".join(f"WHEN contains(q, {_q(k)}) THEN {_q(v)}" for k, v in agents.ENTITY_OF.items()) + " " + " ".join(f"WHEN regexp_extract(q, {_q(p)}, 1) <> '' THEN regexp_extract(q, {_q(p)}, 1)" for p in agents.ENTITY_PATTERNS) + " END"
    return {
        "context_anchors": f"""WITH {_CHUNKS}, g AS (SELECT DISTINCT query_id, string_split(file, '/')[-1] AS base FROM chunks WHERE source = 'grep'),
          r AS (SELECT c.*, EXISTS (SELECT 1 FROM g WHERE g.query_id = c.query_id AND g.base = string_split(c.file, '/')[-1]) AS hot, list_position([{', '.join(map(_q, expand.ANCHOR_ORDER))}], type) AS p FROM chunks c WHERE source = 'primary')
          SELECT query_id, id, type, anchor::INTEGER AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hot DESC, p, coalesce(score, 0) DESC, id) AS anchor FROM r WHERE p > 0) WHERE anchor <= 10""",
        "related_lists": f"{_WITH}, s AS (SELECT id, name FROM nodes WHERE type IN ('Repository', 'File')), e AS (SELECT src AS id, count(*) AS n, md5(string_agg(dst, ',' ORDER BY x.type, dst)) AS ids, string_agg(DISTINCT x.type, ',' ORDER BY x.type) AS types FROM edges x JOIN nodes ON dst = nodes.id GROUP BY 1) SELECT s.id, s.name, coalesce(n, 0)::INTEGER AS n, coalesce(ids, md5('')) AS ids, coalesce(types, '') AS types FROM s LEFT JOIN e USING (id)",
        "related_nodes": f"{_WITH}, c AS (SELECT src, dst FROM edges WHERE type = 'CONTAINS'), p AS (SELECT src AS start, dst AS id, 1 AS distance FROM c WHERE src IN (SELECT id FROM nodes WHERE type = 'Repository') UNION ALL SELECT a.src, b.dst, 2 FROM c a JOIN c b ON a.dst = b.src WHERE a.src IN (SELECT id FROM nodes WHERE type = 'Repository')), r AS (SELECT DISTINCT start, id, name, CASE distance WHEN 1 THEN 'CONTAINS' ELSE 'CONTAINS>CONTAINS' END AS rel_types, distance FROM p JOIN nodes USING (id)) SELECT start, id, name, rel_types, distance FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY distance, name, id) AS k FROM r) WHERE k <= 100",
        "shortest_path_nodes": "SELECT 'repo:region:' || n_regionkey AS start, 'repo:customer:' || c_custkey AS id, 'repo:region:' || n_regionkey || '>repo:nation:' || n_nationkey || '>repo:customer:' || c_custkey AS path, 2 AS distance FROM customer JOIN nation ON c_nationkey = n_nationkey",
        "sibling_classes": "WITH m AS (SELECT 'repo:nation:' || c_nationkey AS owner, 'repo:customer:' || c_custkey AS id, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, 'repo:customer:' || c_custkey) AS r FROM customer), p AS (SELECT a.owner, a.id, b.id AS sibling, row_number() OVER (PARTITION BY a.owner, a.id ORDER BY b.r) AS k FROM m a JOIN m b ON a.owner = b.owner AND a.id <> b.id AND b.r <= 26) SELECT owner, id, sibling FROM p WHERE k <= 25",
        "model_users": "WITH o AS (SELECT 'repo:customer:' || o_custkey AS start, 'repo:orders:' || o_orderkey AS id, 'order-' || o_orderkey AS name FROM orders), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY start || '>' || id) AS r FROM o) WHERE r <= 30) SELECT start, id, 'CALLS' AS rel, pos FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY name, id) AS pos FROM p) WHERE pos <= 8",
        "repository_deletion": f"{_WITH}, gone AS (SELECT 'repo:region:1' AS id UNION SELECT e.dst FROM gone JOIN edges e ON e.src = gone.id AND e.type = 'CONTAINS') SELECT 'node' AS kind, type, count(*) AS n FROM nodes WHERE id NOT IN (SELECT id FROM gone) GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) GROUP BY type",
        "requested_entities": f"{_WITH} SELECT id, true AS found, name, type FROM nodes WHERE type IN ('Repository', 'File') UNION ALL SELECT 'repo:lost:' || n_nationkey, false, NULL, NULL FROM nation",
        "result_shapes": "SELECT coalesce(entity_id, '') AS entity_id, coalesce(nullif(entity_type, ''), 'Unknown') AS entity_type, coalesce(max(name), '') AS name, coalesce(nullif(split_part(entity_id, ':', 3), ''), '') AS file_path, md5(coalesce(content, '')) AS digest, coalesce(max(score), 0) AS score FROM search_results GROUP BY search_results.entity_id, search_results.entity_type, content",
        "fact_texts": "SELECT substr('n_name=''' || n_name || ''', n_regionkey=' || n_regionkey, 1, 120) AS name, 'n_name=''' || n_name || ''', n_regionkey=' || n_regionkey AS code, 'cypher' AS source FROM nation",
        "searched_types": f"""WITH {_ASKED}, k AS (SELECT id, q, {h} AS h, {f} AS f, {b} AS b FROM a)
          SELECT id, CASE WHEN h = 0 AND f > b AND b = 0 AND least(0.9, f / 5) > 0.5 THEN 'Component,Route' WHEN h = 0 AND b > f AND f = 0 AND least(0.9, b / 5) > 0.5 THEN 'Endpoint,Function,Model,Class' END AS types,
            CASE WHEN contains(q, 'как работает') OR contains(q, 'ui to database') THEN 'ui_to_database' WHEN contains(q, 'где отображается') OR contains(q, 'database to ui') THEN 'database_to_ui' ELSE 'semantic_only' END AS strategy FROM k""",
        "question_subjects": f"""WITH {_ASKED}, w AS (SELECT id, q, list_filter(regexp_split_to_array(trim(question), '\\s+'), lambda x: x <> '' AND lower(x) NOT IN ({', '.join(map(_q, agents.NAMELESS))})) AS ws FROM a)
          SELECT id, {entity} AS entity, CASE WHEN len(ws) = 0 THEN 'Unknown' ELSE array_to_string(list_transform(ws, lambda x: upper(x[1:1]) || lower(x[2:])), '') END AS drawn FROM w""",
        "entity_routes": """WITH f AS (SELECT DISTINCT entity_id, entity_type, name, file_path, content FROM search_results WHERE content IS NOT NULL), p AS (SELECT split_part(entity_id, ':', 2) AS query_id, row_number() OVER (PARTITION BY split_part(entity_id, ':', 2) ORDER BY entity_id) AS pos, regexp_extract_all(content, '["'']/([\\w/-]+)["'']', 1) AS x FROM f),
          u AS (SELECT query_id, pos, i, x[i] AS r FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM p)), g AS (SELECT query_id, '/' || r AS route, min((pos, i)) AS first_at FROM u WHERE contains(lower(r), 'api') GROUP BY ALL)
          SELECT query_id, route, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_at, route) AS rank FROM g) WHERE rank <= 5""",
        "matching_lines": r"""WITH ln AS (SELECT doc_id, i AS line_no, regexp_replace(l[i], '\r$', '') AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))) SELECT doc_id, line_no::INTEGER AS line_no, line FROM ln WHERE regexp_matches(line, '\b[A-Z]\w+Error\b')""",
        "context_sources": f"WITH {_CHUNKS}, f AS (SELECT DISTINCT query_id, file FROM chunks WHERE file <> '') SELECT query_id, file FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY file) AS r FROM f) WHERE r <= 20",
        "cached_questions": "WITH l AS (SELECT DISTINCT id, question, created_at FROM chat_logs WHERE question IS NOT NULL AND created_at IS NOT NULL), m AS (SELECT question, min(created_at) AS first_at, min(id) AS first_id FROM l GROUP BY 1) SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS requests, count(*) FILTER (WHERE id <> first_id AND created_at < first_at + INTERVAL 1 DAY) AS hits, round(avg((id <> first_id AND created_at < first_at + INTERVAL 1 DAY)::INT), 6) AS rate FROM l JOIN m USING (question) GROUP BY 1",
        "reindex_state": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY last_updated DESC NULLS LAST, commit_hash NULLS LAST) AS k FROM repositories WHERE name IS NOT NULL) SELECT count(*) AS repositories, count(*) FILTER (WHERE o.name IS NULL) AS new, count(*) FILTER (WHERE o.name IS NOT NULL AND c.commit_hash IS DISTINCT FROM o.commit_hash) AS changed, count(*) FILTER (WHERE o.name IS NOT NULL) AS indexing, count(*) FILTER (WHERE o.name IS NOT NULL AND c.commit_hash IS NOT DISTINCT FROM o.commit_hash) AS current FROM (SELECT * FROM r WHERE k = 1) c LEFT JOIN (SELECT * FROM r WHERE k = 2) o USING (name)",
        "merged_rows": f"""WITH {_CHUNKS}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, id) AS pos FROM chunks), a AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS k FROM p WHERE source = 'primary') WHERE k <= 40), b AS (SELECT query_id, id FROM p WHERE pos <= 30)
          SELECT query_id, id, 'primary' AS source FROM a UNION ALL SELECT query_id, id, 'expanded' FROM b WHERE (query_id, id) NOT IN (SELECT query_id, id FROM a)""",
        "routed_questions": f"WITH {_ASKED}, k AS (SELECT id, {dn} AS d, {cn} AS c, {vn} AS v FROM a) SELECT CASE WHEN (d > 0)::INT + (c > 0)::INT + (v > 0)::INT >= 2 THEN 'code+document' WHEN c >= d AND c >= v THEN 'code' WHEN d > v THEN 'document' ELSE 'visual' END AS agents, count(*) AS questions FROM k GROUP BY 1",
    }


ORACLES = _oracles()
