"""Agents over the retriever: routing a question, rewriting it, explaining a traceback, guiding a user, asking with a cache.

Language models are plug-ins (``Callable[[str], str]``); every default is a rule, so that all of it runs without one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.code_text import classify_question, detect_task
from quarryline.operators import cache as caches
from quarryline.operators import graph, tracebacks

# Words of questions for the things they mean, and words that name nothing.
ENTITY_OF = {
    "клиент": "customer",
    "пользователь": "user",
    "пользователя": "user",
    "заказ": "order",
    "товар": "product",
    "продукт": "product",
    "категория": "category",
    "категории": "category",
    "скидка": "discount",
    "скидку": "discount",
    "промокод": "promo",
    "отчет": "report",
    "отчёт": "report",
    "настройки": "settings",
    "профиль": "profile",
}
ENTITY_PATTERNS = (r"как (?:добавить|создать|изменить|удалить|найти)\s+([\p{L}\p{N}_]+)", r"how to (?:add|create|edit|delete|find)\s+(?:a\s+)?([\p{L}\p{N}_]+)")
NAMELESS = ("как", "работает", "покажи", "связи", "для", "где", "что", "how", "does", "show", "connections", "for", "where", "what", "поток", "данных", "flow", "data")
ROUTE = r"[\"']/([\w/-]+)[\"']"


def question_entity(question: Column) -> Column:
    """What a question is about: a known word's meaning, or the word behind "how to add" and the like; null if nothing tells."""
    q, out = F.lower(question), None
    for word, meaning in ENTITY_OF.items():
        out = F.when(q.contains(word), meaning) if out is None else out.when(q.contains(word), meaning)
    for p in ENTITY_PATTERNS:
        found = F.regexp_extract(q, p, 1)
        out = out.when(found != "", found)
    return out


def diagram_entity(question: Column) -> Column:
    """The words of a question that name something, as one capitalised name."""
    words = F.filter(F.split(F.trim(question), r"\s+"), lambda w: (w != "") & ~F.lower(w).isin(*NAMELESS))
    name = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), "")
    return F.when(name == "", "Unknown").otherwise(name)


def mined_routes(rows: DataFrame, entity: str, most: int = 5) -> DataFrame:
    """(query_id, route, rank): the first routes in the code of each question's rows (pos, code) that name its entity."""
    found = rows.select("query_id", "pos", F.lower(entity).alias("_e"), F.posexplode(F.regexp_extract_all("code", F.lit(ROUTE), 1)).alias("_i", "_x"))
    mine = found.where(F.contains(F.lower("_x"), F.col("_e"))).groupBy("query_id", F.concat(F.lit("/"), F.col("_x")).alias("route")).agg(F.min(F.struct("pos", "_i")).alias("_at"))
    w = Window.partitionBy("query_id").orderBy("_at", "route")
    return mine.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query_id", "route", "rank")


def guide(questions: DataFrame, code: DataFrame) -> DataFrame:
    """(query_id, task, entity, routes): what a user wants to do, with what, and where; code: query_id, pos, code."""
    q = questions.select("query_id", detect_task(F.col("query")).alias("task"), question_entity(F.col("query")).alias("entity"))
    routes = mined_routes(code.join(q.where("entity is not null").select("query_id", "entity"), "query_id"), "entity")
    lists = routes.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "route"))), lambda x: x["route"]).alias("routes"))
    return q.join(lists, "query_id", "left").withColumn("routes", F.coalesce("routes", F.array().cast("array<string>")))


@dataclass
class Reformulator:
    """Other wordings of questions from a model, remembered by the md5 of kind and question; a failure gives the question."""

    model: Callable[[str], str] | None = None
    known: dict[str, list[str]] = field(default_factory=dict)

    PROMPTS = {
        "simplify": "Say in plain words what is asked: {q}",
        "technical": "Put the question in technical terms of a code base: {q}",
        "split": "Split the question into simpler ones, one on a line: {q}",
        "keywords": "List the words to search code for, one on a line: {q}",
        "translate": "Translate the question into English: {q}",
        "context": "Add what the question leaves unsaid: {q}",
    }

    def __call__(self, question: str, kind: str = "simplify", most: int = 3) -> list[str]:
        key = hashlib.md5(f"{kind}:{question}".encode()).hexdigest()
        if key not in self.known:
            try:
                reply = self.model(self.PROMPTS[kind].format(q=question)) if self.model else ""
            except Exception:  # noqa: BLE001 - whatever a provider raises
                reply = ""
            lines = [re.sub(r"^\s*(?:\d+[.)]|[-*])\s*", "", x).strip() for x in reply.split("\n")]
            found = [x for x in dict.fromkeys(lines) if x][:most]
            if not found:
                return [question]
            self.known[key] = found
        return self.known[key]


def routed(questions: DataFrame) -> DataFrame:
    """(query_id, query, agents): which agents a question goes to, by its kind; a mixed one goes to several."""
    kind = classify_question(F.col("query"))["kind"]
    agents = F.when(kind == "hybrid", F.array(F.lit("code"), F.lit("document"))).otherwise(F.array(kind))
    return questions.select("query_id", "query", agents.alias("agents"))


def orchestrate(question: str, kind: str, agents: dict[str, Callable[[str], str]]) -> Iterator[tuple[str, str]]:
    """(event, text): what is done with a question, step by step, and the answers put together at the end."""
    yield "classified", kind
    names = [n for n in (("code", "document") if kind == "hybrid" else (kind,)) if n in agents]
    answers = []
    for name in names or [n for n in ("code",) if n in agents]:
        yield "asking", name
        try:
            answers.append((name, agents[name](question)))
        except Exception as e:  # noqa: BLE001 - one agent's failure leaves the others
            yield "failed", f"{name}: {type(e).__name__}"
    yield "answer", "\n\n".join(f"## {n}\n{a}" if len(answers) > 1 else a for n, a in answers)


#: What an answer is enriched with by level of detail: functions, examples, characters of code, sources.
DETAIL = {"brief": (5, 2, 300, 10), "full": (10, 3, 500, 15)}


def enriched(rows: DataFrame, level: str = "brief") -> DataFrame:
    """Context rows (query_id, pos, type, code) cut to what an answer shows at a level of detail."""
    functions, examples, characters, sources = DETAIL[level]
    group = F.when(F.col("type").isin("Function", "Method"), "functions").when(F.col("source") == "grep", "examples").otherwise("sources")
    limit = F.when(F.col("_g") == "functions", functions).when(F.col("_g") == "examples", examples).otherwise(sources)
    w = Window.partitionBy("query_id", "_g").orderBy("pos")
    grouped = rows.withColumn("_g", group).withColumn("_r", F.row_number().over(w))
    return grouped.where(F.col("_r") <= limit).withColumn("code", F.substring("code", 1, characters)).withColumnRenamed("_g", "part").drop("_r")


def explain_tracebacks(texts: DataFrame, key: str, text: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, pos, file_path, function_name, file_id, entity_id, callers, callees): the frames of tracebacks in the graph.

    A frame's file is found by the end of its path; its function is one of that file, else a method of a class in it.
    """
    parsed = tracebacks.valid(tracebacks.parse_tracebacks(texts, key, text))
    frames = parsed.select(key, F.posexplode("frames").alias("pos", "f")).select(key, "pos", "f.file_path", "f.function_name")
    files = nodes.where("type = 'File'").select("id", F.col("file_path").alias("path"))
    hit = tracebacks.match_frames(frames, files, key)
    placed = tracebacks.match_functions(frames.join(hit, [key, "pos"], "left"), nodes, edges, key)
    calls = edges.where("type = 'CALLS'")
    ids = placed.where("entity_id is not null").select(F.col("entity_id").alias("id")).distinct()
    about = graph.neighbours(calls, nodes, ids).groupBy(F.col("start").alias("entity_id")).agg(F.array_sort(F.collect_set("name")).alias("callees"))
    back = graph.neighbours(calls, nodes, ids, direction="in").groupBy(F.col("start").alias("entity_id")).agg(F.array_sort(F.collect_set("name")).alias("callers"))
    return placed.join(back, "entity_id", "left").join(about, "entity_id", "left").select(key, "pos", "file_path", "function_name", "file_id", "entity_id", "callers", "callees")


@dataclass
class Asked:
    answers: DataFrame
    cache: DataFrame


def ask(questions: DataFrame, cache: DataFrame, now, answer: Callable[[DataFrame], DataFrame], vectors: DataFrame | None = None, threshold: float = 0.95, capacity: int = 1_000) -> Asked:
    """Answers from the cache where the question is known, or one much like it, else from ``answer``; new answers are kept.

    questions: query_id, query[, vector]; vectors: key, vector, expires_at, last_used_at of the cache's questions;
    answer: (query_id, query) to (query_id, value).
    """
    exact = caches.get(cache, questions, "query", "query", now)
    known = exact.where("hit").select("query_id", "value", F.lit("exact").alias("origin"))
    left = exact.where(~F.col("hit")).drop("value", "hit")
    if vectors is not None:
        near = caches.similar(vectors, left, now, threshold, capacity).join(cache.select("key", "value"), "key")
        known = known.unionByName(near.select("query_id", "value", F.lit("similar").alias("origin")))
        left = left.join(near.select("query_id"), "query_id", "left_anti")
    new = answer(left.select("query_id", "query"))
    made = new.join(left.select("query_id", "query"), "query_id").withColumn("_at", F.lit(now))
    kept = caches.put(cache, caches.entries(made, "query", "query", "value", "_at"))
    return Asked(known.unionByName(new.select("query_id", "value", F.lit("new").alias("origin"))), kept)
