"""The retriever: configuration, routes by name and scope, initial search, expansion, reranking, and the shapes of results."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import code_text
from quarryline.operators import graph, retrieval
from quarryline.session import cut_lineage


@dataclass(frozen=True)
class SearchConfig:
    top_k_vector: int = 50
    top_k_bm25: int = 50
    top_k_final: int = 10
    hybrid_alpha: float = 0.5
    max_per_file: int = 2
    max_per_name: int = 2
    node_types: tuple[str, ...] | None = None
    repositories: tuple | None = None
    #: Filter by repository before the top k instead of after, so that a filtered search is never short of rows.
    filter_first: bool = False
    expand_results: bool = True
    enable_query_expansion: bool = False


#: Names of strategies, most of them old ones of the plain search, and the weight some of them set.
STRATEGIES = {
    "semantic": "semantic_only",
    "semantic_only": "semantic_only",
    "ui_to_database": "ui_to_database",
    "database_to_ui": "database_to_ui",
    "impact_analysis": "semantic_only",
    "pattern_search": "semantic_only",
    "hybrid": "semantic_only",
    "bm25": "semantic_only",
    "vector": "semantic_only",
    "multi_hop": "semantic_only",
}
ALPHAS = {"bm25": 0.0, "vector": 1.0, "hybrid": 0.5}
SCOPE_TYPES = {"frontend": ("Component", "Route"), "backend": ("Endpoint", "Function", "Model", "Class")}
UI_TO_DATA = ("MAKES_CALL", "CALLS_ENDPOINT", "HANDLES_REQUEST", "CALLS", "USES_MODEL")


def with_overrides(config: SearchConfig, overrides: dict | None) -> SearchConfig:
    """A copy with the known keys of ``overrides``; unknown keys are ignored."""
    known = {f.name for f in fields(config)}
    return replace(config, **{k: tuple(v) if isinstance(v, list) else v for k, v in (overrides or {}).items() if k in known})


def flat(values: tuple | list | None) -> list[str]:
    """A list of names, or one list within a list, as names."""
    if not values:
        return []
    return list(values[0]) if isinstance(values[0], (list, tuple)) else list(values)


def route(strategy: str | None, scope: str | None, limit: int) -> tuple[str, dict]:
    """(strategy, overrides) of a search request: alias, weight, scope's node types, and twice the candidates."""
    out: dict = {"top_k_final": limit, "top_k_vector": limit * 2}
    if strategy in ALPHAS:
        out["hybrid_alpha"] = ALPHAS[strategy]
    if scope in SCOPE_TYPES:
        out["node_types"] = SCOPE_TYPES[scope]
    return STRATEGIES.get(strategy or "semantic", "semantic_only"), out


def tool_strategy(question: Column) -> Column:
    """The strategy an agent's search tool takes, by phrases of the question."""
    q = F.lower(question)
    return F.when(q.contains("как работает") | q.contains("ui to database"), "ui_to_database").when(q.contains("где отображается") | q.contains("database to ui"), "database_to_ui").otherwise("semantic_only")


def scope_types(question: Column, least: float = 0.5) -> Column:
    """The node types a question's scope allows (null: all), if the scope is more certain than ``least``."""
    s = code_text.detect_scope(question)
    sure = s["confidence"] > least
    types = F.when(sure & (s["scope"] == "frontend"), F.array(*map(F.lit, SCOPE_TYPES["frontend"])))
    return types.when(sure & (s["scope"] == "backend"), F.array(*map(F.lit, SCOPE_TYPES["backend"])))


def hybrid_search(chunks: DataFrame, queries: DataFrame, k: int, alpha: float, id: str = "id", text: str = "content", vector: str = "vector") -> DataFrame:
    """(query_id, id, score, rank): relative-score fusion of BM25 and cosine; queries: query_id, query, vector.

    Code and document chunks are searched alike; a weight of 0 or 1 leaves one of the two out.  Ids that aren't numbers
    are numbered in their order first, so that ties go to the lesser id.
    """
    if dict(chunks.dtypes)[id] == "string":
        numbers = cut_lineage(chunks.select(id).distinct().orderBy(id).withColumn("_n", F.monotonically_increasing_id()))
        found = hybrid_search(chunks.join(numbers, id).select(F.col("_n").alias("_id"), text, vector), queries, k, alpha, "_id", text, vector)
        return found.join(numbers.withColumnRenamed("_n", "_id"), "_id").select("query_id", id, "score", "rank")
    if alpha <= 0:
        return retrieval.bm25_top_k(chunks, id, text, queries, k).select("query_id", id, F.col("bm25").alias("score"), "rank")
    vectors = chunks.select(id, vector)
    if alpha >= 1:
        return retrieval.vector_top_k(vectors, id, vector, queries, k).select("query_id", id, F.col("cosine").alias("score"), "rank")
    lexical = retrieval.bm25_for_fusion(chunks, id, text, queries, k, vectors, queries.select("query_id", "vector"))
    fused = retrieval.hybrid(lexical, retrieval.vector_block_scores(vectors, id, vector, queries), id, alpha).withColumn("score", F.round("score", 6))
    return retrieval.top_k(fused, id, "score", k)


def initial_search(chunks: DataFrame, queries: DataFrame, config: SearchConfig) -> DataFrame:
    """(query_id, id, score, rank, file_path, name): the first hits of each question, filtered and diversified."""
    pool = chunks if not config.node_types else chunks.where(F.col("node_type").isin(*config.node_types))
    repositories = flat(config.repositories)
    if repositories and config.filter_first:
        pool = pool.where(F.col("repository").isin(*repositories))
    hits = hybrid_search(pool, queries, max(config.top_k_vector, config.top_k_bm25), config.hybrid_alpha)
    rows = hits.join(pool.select("id", "file_path", "name", "repository"), "id")
    if repositories and not config.filter_first:
        rows = rows.where(F.col("repository").isin(*repositories))
    return retrieval.diversity_caps(rows, "query_id", "rank", "file_path", "name", config.max_per_file, config.max_per_name)


def expand_paths(hits: DataFrame, nodes: DataFrame, edges: DataFrame, strategy: str, most: int = 6, each: int = 10) -> DataFrame:
    """(query_id, start, id, nodes): paths from the hits to models, or from models to components, at most ``each`` a hit."""
    starts = hits.select("id").distinct()
    down = strategy == "ui_to_database"
    ends = nodes.where(F.col("type") == ("Model" if down else "Component")).select("id")
    found = graph.first_paths(graph.paths(edges, starts, most, list(UI_TO_DATA), "out" if down else "in", ends), each)
    return hits.select("query_id", F.col("id").alias("start")).join(found, "start").select("query_id", "start", "id", "nodes")


@dataclass
class Found:
    primary: DataFrame
    expanded: DataFrame | None
    strategy: str


def search(chunks: DataFrame, queries: DataFrame, nodes: DataFrame, edges: DataFrame, strategy: str | None = None, overrides: dict | None = None, config: SearchConfig | None = None, reformulate: Callable[[DataFrame], DataFrame] | None = None, scorer=None) -> Found:
    """Reformulate, search, rerank, expand and truncate, for all questions at once.

    chunks: id, node_type, name, file_path, repository, content, vector; queries: query_id, query, vector.
    """
    config = with_overrides(config or SearchConfig(), overrides)
    kind = STRATEGIES.get(strategy or "semantic", "semantic_only")
    asked = reformulate(queries) if reformulate else queries
    hits = initial_search(chunks, asked, config)
    rows = hits.join(asked.select("query_id", "query"), "query_id").join(chunks.select("id", "content"), "id")
    ranked = retrieval.rerank(rows.drop("rank"), F.col("query"), "content", "id", config.top_k_final, *([scorer] if scorer else []))
    primary = ranked.select("query_id", "id", "name", "file_path", "repository", "rerank_score", "rank")
    wider = expand_paths(primary, nodes, edges, kind) if config.expand_results and kind != "semantic_only" else None
    return Found(primary, wider, kind)


def sources(*contexts: DataFrame, most: int | None = None) -> DataFrame:
    """(query_id, file): the distinct files of contexts in order, at most ``most`` of a question."""
    rows = contexts[0].select("query_id", "file")
    for c in contexts[1:]:
        rows = rows.unionByName(c.select("query_id", "file"))
    rows = rows.where("file is not null and file <> ''").distinct()
    if most is None:
        return rows.orderBy("query_id", "file")
    w = Window.partitionBy("query_id").orderBy("file")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def first_sources(rows: DataFrame, most: int = 50) -> DataFrame:
    """Of each question the first row of each id in order of ``pos``, at most ``most``."""
    one = Window.partitionBy("query_id", "id").orderBy("pos")
    order = Window.partitionBy("query_id").orderBy("pos", "id")
    first = rows.withColumn("_r", F.row_number().over(one)).where("_r = 1").drop("_r")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def merged_context(primary: DataFrame, expanded: DataFrame, most_primary: int = 40, most_expanded: int = 30) -> DataFrame:
    """Primary then expanded rows (query_id, id, name, file, pos), each cut to its limit, then each key once: the id, or name and file."""
    parts = []
    for n, (rows, most) in enumerate(((primary, most_primary), (expanded, most_expanded))):
        w = Window.partitionBy("query_id").orderBy("pos", "id")
        parts.append(rows.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= most).withColumn("_s", F.lit(n)))
    both = parts[0].unionByName(parts[1])
    key = F.when(F.coalesce("id", F.lit("")) != "", F.col("id")).otherwise(F.concat_ws("::", "name", "file"))
    w = Window.partitionBy("query_id", key).orderBy("_s", "_p")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").withColumn("source", F.when(F.col("_s") == 0, "primary").otherwise("expanded")).drop("_r", "_s", "_p")


def rerank_context(rows: DataFrame, query: Column, top_grep: int = 20, top_graph: int = 15, few: int = 8, score: Callable[[Column, Column], Column] = retrieval.overlap_score) -> DataFrame:
    """Context rows (query_id, source, pos, code, ...) with grep and graph rows cut to their best, in order of the sources.

    A source with at most ``few`` rows keeps them all in their order.
    """
    per = Window.partitionBy("query_id", "source")
    best = per.orderBy(F.col("_score").desc(), "pos")
    scored = rows.withColumn("_score", F.when(F.col("source").isin("grep", "graph"), score(query, F.col("code")))).withColumn("_n", F.count("*").over(per)).withColumn("_r", F.row_number().over(best))
    limit = F.when(F.col("source") == "grep", top_grep).when(F.col("source") == "graph", top_graph)
    touched = limit.isNotNull() & (F.col("_n") > few)
    kept = scored.where(~touched | (F.col("_r") <= limit))
    place = F.array_position(F.array(*map(F.lit, ("primary", "grep", "graph", "cypher"))), F.col("source"))
    order = Window.partitionBy("query_id").orderBy(F.when(place > 0, place).otherwise(9), F.when(touched, F.col("_r")).otherwise(F.col("pos")))
    return kept.withColumn("rank", F.row_number().over(order)).drop("_score", "_n", "_r")


def api_results(rows: DataFrame) -> DataFrame:
    """Results in the shape an interface returns, with fallbacks for names, types and paths of all kinds of rows."""
    have = set(rows.columns)
    pick = lambda *names: F.coalesce(*[F.when(F.col(n).cast("string") != "", F.col(n).cast("string")) for n in names if n in have], F.lit(None).cast("string"))
    entity = F.coalesce(pick("node_id", "entity_id", "id"), F.lit(""))
    kind = pick("node_type", "entity_type", "type")
    from_id = F.when(F.size(F.split(entity, ":")) >= 3, F.split_part(entity, F.lit(":"), F.lit(3)))
    meta = F.to_json(F.struct(*[(F.col(n) if n in have else F.lit(None).cast("string")).alias(n) for n in ("signature", "start_line", "end_line", "docstring", "language")]))
    return rows.select(
        entity.alias("entity_id"),
        F.when(kind.isNull() | (kind == "nan"), "Unknown").otherwise(kind).alias("entity_type"),
        F.coalesce(pick("name"), F.lit("")).alias("name"),
        F.coalesce(pick("file_path", "file"), from_id, F.lit("")).alias("file_path"),
        F.coalesce(pick("content", "body", "code", "code_snippet"), F.lit("")).alias("content"),
        (F.coalesce(F.col("score").cast("double"), F.lit(0.0)) if "score" in have else F.lit(0.0)).alias("score"),
        meta.alias("metadata"),
    )


def fact_rows(rows: DataFrame) -> DataFrame:
    """Rows of any query as context text: ``column: value`` of a single column, else ``column=value`` of all."""
    shown = lambda c: F.when(F.col(c).isNull(), "None").otherwise(F.concat(F.lit("'"), F.col(c), F.lit("'")) if dict(rows.dtypes)[c] == "string" else F.col(c).cast("string"))
    text = F.concat(F.lit(f"{rows.columns[0]}: "), F.coalesce(F.col(rows.columns[0]).cast("string"), F.lit("None"))) if len(rows.columns) == 1 else F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), shown(c)) for c in rows.columns])
    return rows.select(F.lit("").alias("id"), F.substring(text, 1, 120).alias("name"), F.lit("CypherRow").alias("type"), F.lit("").alias("file"), text.alias("code"), F.lit(1.0).alias("score"), F.lit("cypher").alias("source"))


def matches_whole(text: Column, pattern: str) -> Column:
    """Whether the pattern stands somewhere in a text of one line, as an anchored full match takes it."""
    return text.rlike(f"^(?:.*(?:{pattern}).*)$")


def prompt_blocks(rows: DataFrame, most: int = 100) -> DataFrame:
    """(query_id, block, text): the context of each question as blocks of text by source, at most ``most`` rows each."""
    relation = F.coalesce("relationship", F.lit("RELATED")) if "relationship" in rows.columns else F.lit("RELATED")
    head = F.concat(F.lit("### "), F.coalesce("name", F.lit("Unknown")), F.lit(" ("), F.coalesce("type", F.lit("Unknown")), F.lit(")"), F.when(F.col("source") == "graph", F.concat(F.lit(" - "), relation)).otherwise(""))
    piece = F.when(F.col("source") == "cypher", F.concat(F.lit("- "), F.coalesce("code", "name", F.lit("")))).otherwise(F.concat(head, F.lit("\n`"), F.coalesce("file", F.lit("")), F.lit("`\n```\n"), F.coalesce("code", F.lit("")), F.lit("\n```")))
    w = Window.partitionBy("query_id", "source").orderBy("pos", "id")
    kept = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    lists = kept.groupBy("query_id", F.col("source").alias("block")).agg(F.array_sort(F.collect_list(F.struct("_r", piece.alias("t")))).alias("_l"))
    return lists.select("query_id", "block", F.array_join(F.transform("_l", lambda x: x["t"]), "\n\n").alias("text"))


def lenient_json(text: str) -> dict:
    """The JSON object in a model's reply: alone, fenced, among other text, or cut off at its end."""
    bare = re.sub(r"```(?:json)?\s*", "", text or "").strip()
    decoder = json.JSONDecoder()
    found = []
    at = bare.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(bare, at)
            if isinstance(value, dict):
                if "action" in value or at == 0 and end == len(bare):
                    return value
                found.append(value)
            at = bare.find("{", end)
        except ValueError:
            at = bare.find("{", at + 1)
    if found:
        return found[0]
    begun = bare.find("{")
    if begun >= 0:
        open_marks, quoted, escaped = [], False, False
        for c in bare[begun:]:
            if quoted:
                quoted = escaped or c != '"'
                escaped = not escaped and c == "\\"
            elif c == '"':
                quoted = True
            elif c in "{[":
                open_marks.append("}" if c == "{" else "]")
            elif c in "}]" and open_marks:
                open_marks.pop()
        closed = (bare[begun:] + ('"' if quoted else "")).rstrip().rstrip(",:") + "".join(reversed(open_marks))
        for candidate in (closed, re.sub(r",?\s*\"[^\"]*\"\s*([}\]]*)$", r"\1", closed)):
            try:
                value = json.loads(candidate)
                if isinstance(value, dict):
                    return value
            except ValueError:
                continue
    raise ValueError("no JSON object in the reply")
