"""Graph expansion of search results: anchors are chosen for all questions at once, and each kind of anchor is widened by joins.

Chunks are (query_id, id, type, file, score, source[, pos]).  Everything is ranked by windows over the question or the
anchor, so that many questions are one plan; no row leaves the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators import graph

#: Kinds of anchors in order, and how much of each relation is taken.
ANCHOR_ORDER = ("Class", "Endpoint", "Component", "Model", "Method", "Function")
MOST_ANCHORS, MOST_CHUNKS, MOST_SIBLINGS, MOST_PATHS, TOP_NODES, TREE_DEPTH = 10, 80, 25, 30, 8, 3
MOST_OF = {"Class": 25, "Endpoint": 6, "Model": 8, "Component": 6}


def grep_boost(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``hot``: whether the file's name is that of a grep hit of the same question."""
    base = F.element_at(F.split(F.coalesce("file", F.lit("")), "/"), -1)
    hits = chunks.where("source = 'grep'").select("query_id", base.alias("_base")).where("_base <> ''").distinct().withColumn("hot", F.lit(True))
    return chunks.withColumn("_base", base).join(hits, ["query_id", "_base"], "left").drop("_base").withColumn("hot", F.coalesce("hot", F.lit(False)))


def select_anchors(chunks: DataFrame, most: int = MOST_ANCHORS, skip: DataFrame | None = None) -> DataFrame:
    """(query_id, id, type, file, score, anchor): the first ``most`` primary chunks of each question to be widened.

    Those in files with grep hits come first, then by kind, then by score and id; ids of ``skip`` (query_id, id) are
    left out, and so are kinds that have no expansion.
    """
    rows = grep_boost(chunks).where(F.col("source") == "primary").where(F.col("type").isin(*ANCHOR_ORDER) & (F.coalesce("id", F.lit("")) != ""))
    if skip is not None:
        rows = rows.join(skip.select("query_id", "id").distinct(), ["query_id", "id"], "left_anti")
    kind = F.array_position(F.array(*map(F.lit, ANCHOR_ORDER)), F.col("type"))
    one = Window.partitionBy("query_id", "id").orderBy(F.col("hot").desc(), F.coalesce("score", F.lit(0.0)).desc())
    order = Window.partitionBy("query_id").orderBy(F.col("hot").desc(), kind, F.coalesce("score", F.lit(0.0)).desc(), "id")
    first = rows.withColumn("_r", F.row_number().over(one)).where("_r = 1")
    return first.withColumn("anchor", F.row_number().over(order)).where(F.col("anchor") <= most).select("query_id", "id", "type", "file", "score", "anchor")


def _of(anchors: DataFrame, *types: str) -> DataFrame:
    return anchors.where(F.col("type").isin(*types)).select(F.col("id").alias("start")).distinct()


def _step(edges: DataFrame, starts: DataFrame, *types: str) -> DataFrame:
    return edges.where(F.col("type").isin(*types)).join(starts, F.col("src") == F.col("start")).select("start", F.col("dst").alias("id"), F.col("type").alias("rel"))


def methods_of(edges: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id, rel, pos): the methods and functions a class contains, in order of their lines."""
    m = nodes.where(F.col("type").isin("Method", "Function")).select("id", F.col("start_line").alias("pos"))
    return _step(edges, starts, "CONTAINS").join(m, "id").select("start", "id", "rel", F.col("pos").cast("bigint").alias("pos"))


def siblings_of(edges: DataFrame, nodes: DataFrame, starts: DataFrame, most: int = MOST_SIBLINGS) -> DataFrame:
    """(start, id, rel, pos): the first methods of the class that owns each start."""
    members = nodes.where(F.col("type").isin("Method", "Function")).select("id", F.col("start_line").alias("pos"))
    classes = nodes.where("type = 'Class'").select(F.col("id").alias("src"))
    inside = edges.where("type = 'CONTAINS'").join(classes, "src", "left_semi").join(members.select(F.col("id").alias("dst")), "dst", "left_semi")
    pairs = graph.siblings(inside, starts=starts.select(F.col("start").alias("id")), order=members, most=most)
    return pairs.select(F.col("id").alias("start"), F.col("sibling").alias("id")).join(members, "id").select("start", "id", F.lit("SIBLING_OF").alias("rel"), F.col("pos").cast("bigint").alias("pos"))


def endpoint_fan_out(edges: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id, rel, pos): handlers of an endpoint, then the models it uses."""
    models = nodes.where("type = 'Model'").select("id")
    handlers = _step(edges, starts, "HANDLES_REQUEST").withColumn("pos", F.lit(0).cast("bigint"))
    used = _step(edges, starts, "USES_MODEL").join(models, "id", "left_semi").select("start", "id", "rel", F.lit(1).cast("bigint").alias("pos"))
    return handlers.unionByName(used).distinct()


def component_fan_out(edges: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id, rel, pos): endpoints a component's calls reach, then the routes it renders at."""
    calls = _step(edges, starts, "MAKES_CALL").select("start", F.col("id").alias("src"))
    reached = edges.where("type = 'CALLS_ENDPOINT'").join(calls, "src").select("start", F.col("dst").alias("id"), F.col("type").alias("rel"), F.lit(0).cast("bigint").alias("pos"))
    return reached.unionByName(_step(edges, starts, "RENDERS_AT").withColumn("pos", F.lit(1).cast("bigint"))).distinct()


def model_neighbours(edges: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id, rel, pos): models a model refers to."""
    models = nodes.where("type = 'Model'").select("id")
    return _step(edges, starts, "FOREIGN_KEY", "MANY_TO_MANY", "ONE_TO_ONE").join(models, "id", "left_semi").select("start", "id", "rel", F.lit(0).cast("bigint").alias("pos"))


def call_paths(edges: DataFrame, starts: DataFrame, most: int = MOST_PATHS, depth: int = TREE_DEPTH) -> DataFrame:
    """(start, nodes, length): the first paths of calls from each start, shortest first."""
    found = graph.paths(edges.where("type = 'CALLS'"), starts.select(F.col("start").alias("id")), depth, ["CALLS"]).where("start <> id")
    return graph.first_paths(found, most).select("start", "nodes", "length")


def top_nodes(paths: DataFrame, nodes: DataFrame, most: int = TOP_NODES) -> DataFrame:
    """(start, id, rel, pos): of the nodes on each start's paths its direct callees, then those met most often, then by name."""
    steps = paths.select("start", F.posexplode("nodes").alias("_i", "id")).where("_i > 0")
    each = steps.groupBy("start", "id").agg(F.count("*").alias("_n"), F.min("_i").alias("_depth")).where("start <> id")
    named = each.join(nodes.select("id", "name"), "id")
    order = Window.partitionBy("start").orderBy((F.col("_depth") > 1).cast("int"), F.when(F.col("_depth") > 1, -F.col("_n")).otherwise(0), "name", "id")
    return named.withColumn("pos", F.row_number().over(order).cast("bigint")).where(F.col("pos") <= most).select("start", "id", F.lit("CALLS").alias("rel"), "pos")


def expand_anchors(anchors: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = MOST_CHUNKS) -> DataFrame:
    """(query_id, anchor, anchor_id, id, rel, rank): new graph chunks of each question, at most ``most``.

    Each kind of anchor brings its relations with their own limit; what the context already has is left out, a node
    comes once a question, with the first anchor that brings it.
    """
    start = _of(anchors, "Function", "Method")
    parts = [
        (methods_of(edges, nodes, _of(anchors, "Class")), MOST_OF["Class"], 0),
        (endpoint_fan_out(edges, nodes, _of(anchors, "Endpoint")), MOST_OF["Endpoint"], 0),
        (model_neighbours(edges, nodes, _of(anchors, "Model")), MOST_OF["Model"], 0),
        (component_fan_out(edges, nodes, _of(anchors, "Component")), MOST_OF["Component"], 0),
        (top_nodes(call_paths(edges, start), nodes), TOP_NODES, 0),
        (siblings_of(edges, nodes, _of(anchors, "Method")), MOST_SIBLINGS, 1),
    ]
    limited = []
    for rows, limit, group in parts:
        w = Window.partitionBy("start").orderBy(F.col("pos").asc_nulls_last(), "id", "rel")
        limited.append(rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).select("start", "id", "rel", F.lit(group).alias("_group"), "_n"))
    found = reduce(DataFrame.unionByName, limited)
    mine = anchors.select("query_id", "anchor", F.col("id").alias("start")).join(found, "start")
    new = mine.join(chunks.where("id is not null").select("query_id", "id").distinct(), ["query_id", "id"], "left_anti")
    once = Window.partitionBy("query_id", "id").orderBy("anchor", "_group", "_n", "rel")
    order = Window.partitionBy("query_id").orderBy("anchor", "_group", "_n", "id")
    first = new.withColumn("_r", F.row_number().over(once)).where("_r = 1")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("query_id", "anchor", F.col("start").alias("anchor_id"), "id", "rel", "rank")


def graph_expand(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """The expansion of each question's context: anchors, then their relations."""
    return expand_anchors(select_anchors(chunks, skip=skip), chunks, nodes, edges)


def with_related(nodes: DataFrame, edges: DataFrame, starts: DataFrame, type: str | None = None) -> DataFrame:
    """(id, name, related, distinct_types): each start with the list of its outgoing relations, empty where it has none.

    Lists are per start and hold narrow structs, in order of (type, id).
    """
    e = edges if type is None else edges.where(F.col("type") == type)
    out = e.join(nodes.select(F.col("id").alias("dst"), F.col("name").alias("_name")), "dst").select(F.col("src").alias("id"), F.struct(F.col("type"), F.col("dst").alias("id"), F.col("_name").alias("name")).alias("_x"))
    lists = out.groupBy("id").agg(F.array_sort(F.collect_list("_x")).alias("related"), F.array_sort(F.collect_set("_x.type")).alias("distinct_types"))
    joined = nodes.join(starts.select("id").distinct(), "id", "left_semi").select("id", "name").join(lists, "id", "left")
    empty = F.array().cast("array<struct<type:string,id:string,name:string>>")
    return joined.select("id", "name", F.coalesce("related", empty).alias("related"), F.coalesce("distinct_types", F.array().cast("array<string>")).alias("distinct_types"))


def fetch_entities(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, found, name, type): the requested ids with their nodes; a missing one has found = false."""
    return wanted.select("id").distinct().join(nodes.select("id", "name", "type").withColumn("found", F.lit(True)), "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"), "name", "type")
