"""Diagrams as text: the schema graph, the containment tree and entity diagrams, rendered by ordered aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators import graph


def label(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}_]", "_")


def joined(rows: DataFrame, line: Column, order: list[Column], head: str, limit: int) -> DataFrame:
    """(text): the head and the first ``limit`` lines in order."""
    top = rows.select(line.alias("_line"), F.struct(*[o.alias(f"_{n}") for n, o in enumerate(order)]).alias("_o")).orderBy("_o", "_line").limit(limit)
    return top.agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_line"))), lambda x: x["_line"]).alias("_l")).select(F.concat(F.lit(head), F.when(F.size("_l") > 0, F.lit("\n")).otherwise(""), F.array_join("_l", "\n")).alias("text"))


def schema_graph(histogram: DataFrame, limit: int = 50) -> DataFrame:
    """A flow chart of (from_type, type, to_type, n), the most frequent first."""
    line = F.concat(F.lit("    "), label(F.col("from_type")), F.lit(" -->|"), F.col("type"), F.lit(" "), F.col("n").cast("string"), F.lit("| "), label(F.col("to_type")))
    return joined(histogram, line, [-F.col("n")], "graph LR", limit)


def containment_tree(edges: DataFrame, nodes: DataFrame, limit: int = 50) -> DataFrame:
    """A top-down chart of CONTAINS edges by names."""
    n = nodes.select("id", "name", F.col("type").alias("_t"))
    e = edges.where(F.col("type") == "CONTAINS").select("src", "dst")
    a, b = n.select(F.col("id").alias("src"), F.concat_ws("_", "name", "_t").alias("_a")), n.select(F.col("id").alias("dst"), F.concat_ws("_", "name", "_t").alias("_b"))
    rows = e.join(a, "src").join(b, "dst").select("_a", "_b").distinct()
    return joined(rows, F.concat(F.lit("    "), label(F.col("_a")), F.lit(" --> "), label(F.col("_b"))), [F.col("_a")], "graph TD", limit)


def class_diagram(entities: DataFrame, limit: int = 200) -> DataFrame:
    """A class diagram of entities (name, parent, entity_kind, bases)."""
    methods = entities.where("entity_kind = 'Method'").select(F.concat(F.lit("    "), label(F.col("parent")), F.lit(" : "), F.col("name"), F.lit("()")).alias("_x"))
    bases = entities.where("entity_kind in ('Class', 'Model')").select(F.explode("bases").alias("_b"), "name").select(F.concat(F.lit("    "), label(F.col("_b")), F.lit(" <|-- "), label(F.col("name"))).alias("_x"))
    return joined(methods.unionByName(bases).distinct(), F.col("_x"), [F.col("_x")], "classDiagram", limit)


def call_tree(found: DataFrame, limit: int = 40) -> list[str]:
    """Lines of a call tree from at most ``limit`` paths (start, nodes), repeats marked; bounded, for the driver."""
    children: dict[str, set[str]] = {}
    roots: dict[str, None] = {}
    for r in found.orderBy("length", F.array_join("nodes", ">")).limit(limit).collect():
        roots.setdefault(r.nodes[0])
        for a, b in zip(r.nodes, r.nodes[1:]):
            children.setdefault(a, set()).add(b)
    out: list[str] = []
    shown: set[str] = set()

    def walk(node: str, depth: int) -> None:
        if len(out) > limit:
            return
        again = node in shown
        out.append("  " * depth + node + (" ↺" if again else ""))
        if not again:
            shown.add(node)
            for c in sorted(children.get(node, ())):
                walk(c, depth + 1)

    for r in roots:
        walk(r, 0)
    return [*out[:limit], "…"] if len(out) > limit else out


def sequence_diagram(steps: DataFrame, limit: int = 200) -> DataFrame:
    """A sequence diagram of steps (pos, src, dst, text)."""
    line = F.concat(F.lit("    "), label(F.col("src")), F.lit("->>"), label(F.col("dst")), F.lit(": "), F.col("text"))
    return joined(steps, line, [F.col("pos")], "sequenceDiagram", limit)


def entity_diagram(edges: DataFrame, limit: int = 200) -> DataFrame:
    """An entity-relationship diagram of model edges (src_name, type, dst_name)."""
    mark = F.when(F.col("type") == "MANY_TO_MANY", "}o--o{").when(F.col("type") == "ONE_TO_ONE", "||--||").otherwise("}o--||")
    line = F.concat(F.lit("    "), label(F.col("src_name")), F.lit(" "), mark, F.lit(" "), label(F.col("dst_name")), F.lit(" : "), F.lower("type"))
    return joined(edges.where(F.col("type").isin("FOREIGN_KEY", "MANY_TO_MANY", "ONE_TO_ONE")), line, [F.col("src_name"), F.col("dst_name")], "erDiagram", limit)


def flow_chart(edges: DataFrame, nodes: DataFrame, limit: int = 200) -> DataFrame:
    """A flow chart of edges (src, dst, type) by the names of their ends."""
    n = nodes.select("id", "name")
    rows = edges.join(n.select(F.col("id").alias("src"), F.col("name").alias("_a")), "src").join(n.select(F.col("id").alias("dst"), F.col("name").alias("_b")), "dst").select("_a", "type", "_b").distinct()
    line = F.concat(F.lit("    "), label(F.col("_a")), F.lit(" -->|"), F.col("type"), F.lit("| "), label(F.col("_b")))
    return joined(rows, line, [F.col("_a"), F.col("_b"), F.col("type")], "graph LR", limit)


def search_graph(hits: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 200) -> DataFrame:
    """The flow chart of the edges between the hits (id) of a search."""
    return flow_chart(graph.induced(edges, hits), nodes, limit)


def neighbour_chart(nodes: DataFrame, edges: DataFrame, start: DataFrame, limit: int = 50) -> DataFrame:
    """The flow chart of a node's relations in both directions."""
    ids = start.select("id").distinct()
    near = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")).select("src", "dst", "type").distinct()
    return flow_chart(near, nodes, limit)


def flow_path(nodes: DataFrame, edges: DataFrame, component: str, most: int = 6) -> DataFrame:
    """(start, id, nodes, length): the first path from a component of a name to a model."""
    starts = nodes.where((F.col("type") == "Component") & (F.col("name") == component)).select("id")
    ends = nodes.where("type = 'Model'").select("id")
    found = graph.paths(edges, starts, most, ["MAKES_CALL", "CALLS_ENDPOINT", "HANDLES_REQUEST", "CALLS", "USES_MODEL"], "out", ends)
    return found.orderBy("length", F.array_join("nodes", ">")).limit(1).select("start", "id", "nodes", "length")


#: Layers of a sequence and the kinds of nodes in them.
LAYERS = (("UI", ("Component", "Route")), ("API", ("ApiCall", "Endpoint")), ("Backend", ("Function", "Method", "Class")), ("DB", ("Model",)))


def layered_sequence(edges: DataFrame, nodes: DataFrame, limit: int = 60) -> DataFrame:
    """A sequence diagram of the edges that lead from one layer to another, layer by layer."""
    layer = None
    for n, (name, types) in enumerate(LAYERS):
        hit = F.col("type").isin(*types)
        value = F.struct(F.lit(n).alias("n"), F.lit(name).alias("name"))
        layer = F.when(hit, value) if layer is None else layer.when(hit, value)
    placed = nodes.select("id", F.col("name").alias("_name"), layer.alias("_l")).where("_l is not null")
    a, b = (placed.select(F.col("id").alias(end), F.col("_name").alias(f"_{end}"), F.col("_l").alias(f"_l{end}")) for end in ("src", "dst"))
    rows = edges.join(a, "src").join(b, "dst").where("_lsrc.n <> _ldst.n").select("_lsrc", "_ldst", "_src", "_dst", "type").distinct()
    line = F.concat(F.lit("    "), F.col("_lsrc.name"), F.lit("->>"), F.col("_ldst.name"), F.lit(": "), F.col("_src"), F.lit(" "), F.col("type"), F.lit(" "), F.col("_dst"))
    return joined(rows, line, [F.col("_lsrc.n"), F.col("_ldst.n"), F.col("_src"), F.col("_dst")], "sequenceDiagram\n    participant UI\n    participant API\n    participant Backend\n    participant DB", limit)
