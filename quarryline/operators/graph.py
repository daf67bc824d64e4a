"""The property graph: upserts, one-hop joins, bounded traversals, shortest paths and schema statistics.

Nodes are (id, type, name, ...), edges (src, dst, type, ...).  Traversals run as joins of a frontier with the edges,
one join a hop; each hop is cut by a reliable checkpoint, and nodes reached before are not expanded again where only
distances are asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.session import cut_lineage


def upsert_nodes(*versions: DataFrame) -> DataFrame:
    """Full replace by id: of each id the row of the last given version that has it."""
    tagged = [v.withColumn("_version", F.lit(n)) for n, v in enumerate(versions)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    w = Window.partitionBy("id").orderBy(F.col("_version").desc())
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_version")


def upsert_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge for each (src, type, dst), both ends present."""
    ids = nodes.select("id").distinct()
    known = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return known.dropDuplicates(["src", "type", "dst"])


def delete_repository(rows: DataFrame, repository: str, key: str = "id") -> DataFrame:
    """``rows`` without the repository's node and everything below it."""
    root = f"repo:{repository}"
    return rows.where(~((F.col(key) == root) | F.col(key).startswith(root + ":")))


def delete_repository_graph(nodes: DataFrame, edges: DataFrame, repository: str, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the repository's node, all that CONTAINS* reaches from it, all ids below its own, and their edges."""
    root = nodes.where(F.col("id") == f"repo:{repository}").select("id")
    below = reach(edges, root, most, ["CONTAINS"]).select("id").unionByName(root)
    gone = cut_lineage(below.unionByName(nodes.where(F.col("id").startswith(f"repo:{repository}:")).select("id")).distinct())
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), kept


def find_nodes(nodes: DataFrame, type: str | None = None, limit: int | None = 100, **equal) -> DataFrame:
    """Nodes by type and property equalities, in order of id."""
    out = nodes if type is None else nodes.where(F.col("type") == type)
    for k, v in equal.items():
        out = out.where(F.col(k) == v)
    return out if limit is None else out.orderBy("id").limit(limit)


def find_edges(edges: DataFrame, src: str | None = None, dst: str | None = None, type: str | None = None) -> DataFrame:
    for k, v in (("src", src), ("dst", dst), ("type", type)):
        edges = edges if v is None else edges.where(F.col(k) == v)
    return edges


def oriented(edges: DataFrame, direction: str = "out") -> DataFrame:
    """(src, dst, type) seen along ``out``, ``in`` or ``both`` directions."""
    out = edges.select("src", "dst", "type")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def neighbours(edges: DataFrame, nodes: DataFrame, starts: DataFrame, types: list[str] | None = None, direction: str = "out") -> DataFrame:
    """(start, type, id, node_type, name) of the nodes one hop from each start."""
    e = oriented(edges if types is None else edges.where(F.col("type").isin(types)), direction)
    hop = e.join(starts.select(F.col("id").alias("src")).distinct(), "src")
    return hop.select(F.col("src").alias("start"), F.col("dst").alias("id"), "type").join(nodes.select("id", F.col("type").alias("node_type"), "name"), "id")


def siblings(edges: DataFrame, type: str = "CONTAINS", starts: DataFrame | None = None, order: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(id, sibling, owner): different nodes with the same owner, of all nodes or of ``starts``.

    With ``order`` (id, pos) and ``most`` only the first ``most`` members of an owner are siblings: the member list is cut
    before the join, so that an owner of n members gives at most n * most pairs.
    """
    a = edges.where(F.col("type") == type).select(F.col("src").alias("owner"), F.col("dst").alias("id")).distinct()
    b = a.select("owner", F.col("id").alias("sibling"))
    if most is not None:
        placed = b.join(order.select(F.col("id").alias("sibling"), "pos"), "sibling", "left") if order is not None else b.withColumn("pos", F.lit(None).cast("string"))
        w = Window.partitionBy("owner").orderBy(F.col("pos").asc_nulls_last(), "sibling")
        # One more than asked for: a start doesn't count as its own sibling.
        b = placed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most + 1).select("owner", "sibling", "_r")
    if starts is not None:
        a = a.join(starts.select("id").distinct(), "id", "left_semi")
    pairs = a.join(b, "owner").where(F.col("id") != F.col("sibling"))
    if most is None:
        return pairs.select("owner", "id", "sibling")
    w = Window.partitionBy("owner", "id").orderBy("_r")
    return pairs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).select("owner", "id", "sibling")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in the id set."""
    keys = ids.select("id").distinct()
    return edges.join(keys.withColumnRenamed("id", "src"), "src", "left_semi").join(keys.withColumnRenamed("id", "dst"), "dst", "left_semi")


def reach(edges: DataFrame, starts: DataFrame, hops: int, types: list[str] | None = None, direction: str = "out", least: int = 1) -> DataFrame:
    """(start, id, distance): each node within ``hops`` of each start, at its least distance; starts are left out."""
    e = oriented(edges if types is None else edges.where(F.col("type").isin(types)), direction).select("src", "dst").distinct()
    frontier = starts.select(F.col("id").alias("start"), F.col("id")).distinct().withColumn("distance", F.lit(0))
    seen = frontier
    for n in range(1, hops + 1):
        step = (
            frontier.join(e, frontier["id"] == e["src"])
            .select("start", F.col("dst").alias("id"))
            .distinct()
            .join(seen.select("start", "id"), ["start", "id"], "left_anti")
            .withColumn("distance", F.lit(n))
        )
        frontier = cut_lineage(step) if n < hops else step
        seen = seen.unionByName(frontier)
        if n < hops and frontier.isEmpty():
            break
    return seen.where(F.col("distance") >= least)


def paths(edges: DataFrame, starts: DataFrame, most: int, types: list[str] | None = None, direction: str = "out", ends: DataFrame | None = None, least: int = 1) -> DataFrame:
    """(start, id, nodes, types, length): paths whose edges are all different, as variable-length patterns give them."""
    e = (edges if types is None else edges.where(F.col("type").isin(types))).select("src", "dst", "type", F.concat_ws(">", "src", "type", "dst").alias("edge"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "edge")
    e = {"out": e, "in": back, "both": e.unionByName(back)}[direction]
    now = starts.select(F.col("id").alias("start"), F.col("id"), F.array("id").alias("nodes"), F.array().cast("array<string>").alias("types"), F.array().cast("array<string>").alias("used"))
    out = None
    for n in range(1, most + 1):
        step = now.join(e, (now["id"] == e["src"]) & ~F.array_contains(now["used"], e["edge"])).select(
            "start", F.col("dst").alias("id"), F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("types", F.col("type")).alias("types"), F.array_append("used", F.col("edge")).alias("used")
        )
        now = cut_lineage(step) if n < most else step
        part = now.select("start", "id", "nodes", "types", F.lit(n).alias("length"))
        if n >= least:
            out = part if out is None else out.unionByName(part)
        if n < most and now.isEmpty():
            break
    if out is None:
        out = now.select("start", "id", "nodes", "types", F.lit(0).alias("length")).limit(0)
    return out if ends is None else out.join(ends.select("id").distinct(), "id", "left_semi")


def first_paths(found: DataFrame, each: int) -> DataFrame:
    """Of each start the first ``each`` paths, by length and then by nodes."""
    w = Window.partitionBy("start").orderBy("length", F.array_join("nodes", ">"))
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= each).drop("_r")


def shortest_path_lengths(edges: DataFrame, starts: DataFrame, targets: DataFrame, most: int, direction: str = "both") -> DataFrame:
    """(start, id, distance) of the targets within ``most`` hops, level by level."""
    return reach(edges, starts, most, direction=direction).join(targets.select("id").distinct(), "id", "left_semi")


def related(edges: DataFrame, nodes: DataFrame, starts: DataFrame, most: int, types: list[str] | None = None, direction: str = "out", limit: int = 100) -> DataFrame:
    """(start, id, name, rel_types, distance): of each start the nodes within ``most`` hops, once for each sequence of edge types.

    At most ``limit`` of a start, by distance, name and id; starts themselves are left out.
    """
    found = paths(edges, starts, most, types, direction).select("start", "id", F.col("types").alias("rel_types"), F.col("length").alias("distance")).where("start <> id").distinct()
    named = found.join(nodes.select("id", "name"), "id")
    w = Window.partitionBy("start").orderBy("distance", "name", "id", F.array_join("rel_types", ">"))
    return named.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def shortest_paths(edges: DataFrame, starts: DataFrame, targets: DataFrame, most: int, direction: str = "both") -> DataFrame:
    """(start, id, nodes, distance): one shortest path of each start to each target within ``most`` hops.

    Breadth first with one predecessor for each (start, node), the least; the path is walked back hop by hop, so that no
    other path is ever held.
    """
    e = oriented(edges, direction).select("src", "dst").distinct()
    frontier = starts.select(F.col("id").alias("start"), "id").distinct().withColumn("via", F.lit(None).cast("string")).withColumn("distance", F.lit(0))
    seen = frontier
    for n in range(1, most + 1):
        step = frontier.join(e, frontier["id"] == e["src"]).select("start", F.col("dst").alias("id"), F.col("src").alias("via")).join(seen.select("start", "id"), ["start", "id"], "left_anti")
        frontier = cut_lineage(step.groupBy("start", "id").agg(F.min("via").alias("via")).withColumn("distance", F.lit(n)))
        if frontier.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(frontier))
    back = seen.join(targets.select("id").distinct(), "id", "left_semi").where("distance > 0")
    walk = back.select("start", "id", "distance", F.col("via").alias("at"), F.array("id").alias("nodes"))
    steps = seen.select("start", F.col("id").alias("at"), F.col("via").alias("_via"))
    done = None
    for _ in range(most):
        ended = walk.where("at = start").select("start", "id", F.concat(F.array("start"), "nodes").alias("nodes"), "distance")
        done = ended if done is None else done.unionByName(ended)
        walk = walk.where("at <> start").join(steps, ["start", "at"]).select("start", "id", "distance", F.col("_via").alias("at"), F.concat(F.array("at"), "nodes").alias("nodes"))
    return done


def fan_in(found: DataFrame) -> DataFrame:
    """How often each node is the target of a step of the given paths (path occurrences)."""
    return found.select(F.explode(F.slice("nodes", F.lit(2), F.size("nodes") - 1)).alias("id")).groupBy("id").agg(F.count("*").alias("fan_in"))


def fan_in_of_two(edges: DataFrame, starts: DataFrame, types: list[str] | None = None) -> DataFrame:
    """What ``fan_in`` of all paths of one or two steps gives, counted by degrees: no path is ever a row.

    A node x that c edges from the starts lead to is met c times by paths of one step and c * out(x) times as the middle
    of two; a node y is met as their end once for every edge that leads there from such an x.  A loop can't follow itself.
    """
    e = edges if types is None else edges.where(F.col("type").isin(types))
    e = e.select("src", "dst")
    first = e.join(starts.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    direct = first.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("c"))
    out = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o"))
    ends = e.join(direct.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("c").alias("n"))
    middle = direct.join(out, "id", "left").select("id", (F.col("c") * (1 + F.coalesce("o", F.lit(0)))).alias("n"))
    loops = first.where("src = dst").groupBy(F.col("dst").alias("id")).agg((-2 * F.count("*")).alias("n"))
    return middle.unionByName(ends).unionByName(loops).groupBy("id").agg(F.sum("n").alias("fan_in"))


def type_counts(nodes: DataFrame, edges: DataFrame, node_types: list[str], edge_types: list[str]) -> DataFrame:
    """(kind, type, n): counts for every type of the two enumerations, 0 where there is none, with totals."""
    spark = nodes.sparkSession
    parts = []
    for kind, rows, types in (("node", nodes, node_types), ("edge", edges, edge_types)):
        all_types = spark.createDataFrame([(t,) for t in types], "type string")
        counts = rows.groupBy("type").agg(F.count("*").alias("n"))
        per = all_types.join(counts, "type", "left").select(F.lit(kind).alias("kind"), "type", F.coalesce("n", F.lit(0)).alias("n"))
        parts += [per, rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit("total").alias("type"), "n")]
    return reduce(DataFrame.unionByName, parts)


def schema_histogram(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_type, type, to_type, n)."""
    t = nodes.select("id", F.col("type").alias("_t"))
    a, b = t.select(F.col("id").alias("src"), F.col("_t").alias("from_type")), t.select(F.col("id").alias("dst"), F.col("_t").alias("to_type"))
    return edges.join(a, "src").join(b, "dst").groupBy("from_type", "type", "to_type").agg(F.count("*").alias("n"))


def resolve_first(references: DataFrame, ref: str, candidates: list[tuple[DataFrame, str | list[str], int]], keys: list[str], seq: str = "seq") -> DataFrame:
    """Priority resolution: each reference gets the candidate of least priority, then least ``seq``.

    candidates: (rows with id and seq, key columns, priority); every level is an equality join, and the choice is one
    window over the matches.
    """
    found = []
    for rows, on, priority in candidates:
        shared = [on] if isinstance(on, str) else on
        hit = references.join(rows.select(*shared, "id", seq), shared)
        found.append(hit.select(*keys, ref, F.col("id").alias("target"), F.col(seq).alias("_seq"), F.lit(priority).alias("priority")))
    w = Window.partitionBy(*keys, ref).orderBy("priority", "_seq", "target")
    return reduce(DataFrame.unionByName, found).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_seq")


def link_calls(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(src, dst, confidence) of API calls and endpoints on their normalised paths.

    calls: id, method, url; endpoints: id, method, path.  A call meets an endpoint whose path equals its url, or its
    url with a parameter appended; the three forms become candidate keys of one equality join.  Confidence is 1.0 for
    the url itself, 0.7 where the endpoint takes any method, else 0.85.
    """
    keys = F.array(F.struct(F.lit(True).alias("exact"), F.col("url").alias("path")), F.struct(F.lit(False).alias("exact"), F.concat("url", F.lit("/{param}")).alias("path")), F.struct(F.lit(False).alias("exact"), F.concat("url", F.lit("{param}")).alias("path")))
    c = calls.where(~F.col("url").isin("", "/")).select(F.col("id").alias("src"), F.upper("method").alias("method"), F.explode(keys).alias("k")).select("src", "method", "k.*")
    e = endpoints.select(F.col("id").alias("dst"), F.upper("method").alias("endpoint_method"), "path")
    hit = c.join(e, "path").where((F.col("method") == F.col("endpoint_method")) | (F.col("endpoint_method") == "ANY"))
    confidence = F.when(F.col("exact"), 1.0).when(F.col("endpoint_method") == "ANY", 0.7).otherwise(0.85)
    return hit.groupBy("src", "dst").agg(F.max(confidence).alias("confidence"))


def orphan_calls(calls: DataFrame, links: DataFrame) -> DataFrame:
    """Calls without a linked endpoint."""
    return calls.join(links.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def orphans_with_owner(calls: DataFrame, links: DataFrame, edges: DataFrame, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, method, url, file_path, line, owner): calls without an endpoint, with the component that makes them, by file and line."""
    made = edges.where("type = 'MAKES_CALL'").select(F.col("dst").alias("id"), F.col("src").alias("_o")).join(nodes.select(F.col("id").alias("_o"), F.col("name").alias("owner")), "_o", "left")
    rows = orphan_calls(calls, links).join(made.groupBy("id").agg(F.min("owner").alias("owner")), "id", "left").select("id", "method", "url", "file_path", "line", "owner").orderBy("file_path", "line", "id")
    return rows if limit is None else rows.limit(limit)


def include_prefixes(includes: DataFrame, most: int = 12) -> DataFrame:
    """(child, prefix): the URL prefix of each module along its chain of includes (child, parent, prefix).

    The longest non-empty chain wins; a cycle gives the empty prefix.
    """
    now = includes.select("child", F.col("parent").alias("top"), F.coalesce("prefix", F.lit("")).alias("prefix"), F.array("child").alias("seen"))
    steps = [now]
    up = includes.select(F.col("child").alias("top"), F.col("parent").alias("_next"), F.coalesce("prefix", F.lit("")).alias("_more"))
    for _ in range(most):
        step = now.where(~F.array_contains("seen", F.col("top"))).join(up, "top").select("child", F.col("_next").alias("top"), F.concat("_more", "prefix").alias("prefix"), F.array_append("seen", F.col("top")).alias("seen"))
        now = cut_lineage(step)
        if now.isEmpty():
            break
        steps.append(now)
    whole = reduce(DataFrame.unionByName, steps)
    ends = whole.join(includes.select(F.col("child").alias("top")).distinct(), "top", "left_anti")
    return ends.groupBy("child").agg(F.max_by("prefix", F.struct(F.length("prefix"), "prefix")).alias("prefix"))
