"""Scalar functions on identifiers, paths, URLs and questions, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryline.functions.fixed_values import BACKEND_WORDS, CODE_WORDS, DATA_LINK_WORDS, DATA_WORDS, DIAGRAM_WORDS, DOCUMENT_TYPES, DOCUMENT_WORDS, FRONTEND_WORDS, HYBRID_WORDS, IDENTIFIER_STOPWORDS, UI_USE_WORDS, UI_WORDS, VISUAL_WORDS

# Patterns that results depend on.
SNAKE = r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"
CAMEL = r"\b(?:[a-z]+(?:[A-Z][a-z0-9]+)+|[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b"
CONSTANT = r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b"
TERM_PATTERNS = (r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b", r"\b[a-z]+(?:_[a-z]+)+\b", r"\b[A-Z][A-Z_]+[A-Z]\b")
TASK_PATTERNS = {
    "create": ["как (добавить|создать|завести)", "how (to|do i) (add|create|make|register)", "(добавление|создание|регистрация)", "(adding|creating|registration)"],
    "view": ["как (посмотреть|увидеть|найти|открыть)", "где (находится|посмотреть|найти)", "how (to|do i) (view|see|find|open|show)", "where (is|can i find)"],
    "edit": ["как (изменить|редактировать|обновить|поменять)", "how (to|do i) (edit|change|update|modify)"],
    "delete": ["как (удалить|убрать|отменить)", "how (to|do i) (delete|remove|cancel)"],
    "search": ["как (искать|найти)", "how (to|do i) search", "(поиск|фильтр)"],
    "navigate": ["как (попасть|перейти|зайти)", "где (находится|расположен)", "how (to|do i) (get to|navigate|go to)", "where is"],
}
STRUCTURAL_ANY_CASE = [
    r"\bсколько\b|\bколичество\b", r"\b(?:how\s+many|count|number\s+of|total)\b", r"\b(?:наследу|подклас|базовый\s+класс|родитель)", r"\b(?:inherits?|extends?|subclass|parent\s+class|derived\s+from)\b",
    r"\b(?:вызывает|использует|связан|зависит|импортирует|рендерит)", r"\b(?:calls?|uses?|invokes?|imports?|renders?|depends?\s+on)\b", r"/(?:api|backend|v\d+)/[\w\-/{}<>:?]+", r"\b(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+/",
]
STRUCTURAL_EXACT = [r"\b(?:Endpoint|Component|Model|Route|ApiCall|Function|Method|Class)s?\b", r"\b[A-Z][a-z]+[A-Z][A-Za-z0-9]*\b"]
TRACE_PREFIXES = ("/app/", "/src/", "/code/", "app/", "src/", "code/", "./", "../")


def _any(text: Column, terms: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return out


def count_words(text: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms occur in the lower-cased text, as substrings."""
    lower = F.lower(text)
    return F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(lower, t)))


def normalize_url(url: Column) -> Column:
    """The comparable path of a URL: no query, host or trailing slash; parameters and value-like segments as {param}."""
    u = F.regexp_replace(F.split_part(F.coalesce(url, F.lit("")), F.lit("?"), F.lit(1)), "/+$", "")
    path = F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/#]*([^#;]*)", 1)
    u = F.when(u.startswith("http") & u.contains("://"), path).otherwise(u)
    for p in (r"\$\{[^}]+\}", r":[a-zA-Z_]\w*", r"<[^>]+>", r"\{[^}]+\}"):
        u = F.regexp_replace(u, p, "{param}")
    u = F.regexp_replace(u, r"/(?:\d+|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})(?=/|$)", "/{param}")
    return F.regexp_replace(u, "/+", "/")


def node_id(repository: Column, path: Column | None = None, entity: Column | None = None) -> Column:
    """``repo:<repository>[:<path>[:<entity>]]``, backslashes turned."""
    parts = [F.concat(F.lit("repo:"), repository)]
    if path is not None:
        parts.append(F.nullif(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("")))
    if entity is not None:
        parts.append(F.nullif(entity, F.lit("")))
    return F.concat_ws(":", *parts)


def repository_name(node: Column) -> Column:
    """The repository in a node id, ``unknown`` where it has none."""
    name = F.regexp_extract(node, "^repo:([^/:]*)", 1)
    return F.when(name == "", "unknown").otherwise(F.coalesce(name, F.lit("unknown")))


def repository_from_url(url: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), r"\.git$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def module_name(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "/", "."), r"\.py$", "")


def identifiers(text: Column, most: int = 5) -> Column:
    """Up to ``most`` code identifiers of a question: snake, camel, then constant case; sorted."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), 0) for p in (SNAKE, CAMEL, CONSTANT)])
    kept = F.filter(found, lambda t: (F.length(t) >= 4) & ~F.lower(t).isin(*IDENTIFIER_STOPWORDS))
    return F.array_sort(F.slice(F.array_distinct(kept), 1, most))


def code_terms(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), 0) for p in TERM_PATTERNS])))


def camel_to_snake(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, "([a-z])([A-Z])", "$1_$2"))


def snake_to_camel(word: Column) -> Column:
    parts = F.split(word, "_")
    rest = F.transform(F.slice(parts, 2, 1000), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1000))))
    return F.concat(parts[0], F.array_join(rest, ""))


def detect_strategy(question: Column) -> Column:
    q = F.lower(question)
    return (
        F.when(_any(q, DATA_WORDS) & _any(q, UI_USE_WORDS), "database_to_ui")
        .when(_any(q, UI_WORDS) & _any(q, DATA_LINK_WORDS), "ui_to_database")
        .otherwise("semantic_only")
    )


def detect_scope(question: Column) -> Column:
    """struct(scope, confidence) by keyword counts."""
    h, f, b = (count_words(question, w) for w in (HYBRID_WORDS, FRONTEND_WORDS, BACKEND_WORDS))
    scope = F.when(h > 0, "hybrid").when((f > 0) & (b > 0), "hybrid").when(f > b, "frontend").when(b > f, "backend").otherwise("unknown")
    confidence = (
        F.when(h > 0, 0.9)
        .when((f > 0) & (b > 0), F.least(F.lit(0.8), (f + b) / 10))
        .when(f > b, F.least(F.lit(0.9), f / 5))
        .when(b > f, F.least(F.lit(0.9), b / 5))
        .otherwise(0.0)
    )
    return F.struct(scope.alias("scope"), confidence.alias("confidence"))


def detect_task(question: Column) -> Column:
    q, out = F.lower(question), None
    for task, patterns in TASK_PATTERNS.items():
        hit = q.rlike("|".join(f"(?:{p})" for p in patterns))
        out = F.when(hit, task) if out is None else out.when(hit, task)
    return out.otherwise("unknown")


def classify_question(question: Column) -> Column:
    """struct(kind, confidence): code, document, visual or hybrid."""
    d, c, v = (count_words(question, w) for w in (DOCUMENT_WORDS, CODE_WORDS, VISUAL_WORDS))
    several = (d > 0).cast("int") + (c > 0).cast("int") + (v > 0).cast("int") >= 2
    kind = F.when(several, "hybrid").when((c >= d) & (c >= v), "code").when(d > v, "document").otherwise("visual")
    return F.struct(kind.alias("kind"), F.when(several, 0.7).otherwise(0.6).alias("confidence"))


def diagram_type(question: Column) -> Column:
    q, out = F.lower(question), None
    for kind, terms in DIAGRAM_WORDS:
        hit = _any(q, terms)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("sequence")


def is_structural(question: Column) -> Column:
    """Whether a question asks about the graph rather than about a piece of code."""
    return question.rlike("(?iU)" + "|".join(f"(?:{p})" for p in STRUCTURAL_ANY_CASE)) | question.rlike("(?U)" + "|".join(f"(?:{p})" for p in STRUCTURAL_EXACT))


def document_type(name: Column) -> Column:
    low, out = F.lower(name), None
    for kind, stems in DOCUMENT_TYPES:
        hit = _any(low, list(stems))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("Document")


def trace_path(path: Column) -> Column:
    """A traceback's file path for suffix matching: known prefixes off, the last three parts."""
    p = path
    for prefix in TRACE_PREFIXES:
        p = F.regexp_replace(p, "^" + re.escape(prefix), "")  # one mention of p a step: nested cases would double it each time
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    return F.when(F.size(parts) > 3, F.array_join(F.slice(parts, -3, 3), "/")).otherwise(p)


def clamp_score(score: Column, default: float = 0.5) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score, F.lit(default))))


def url_safe_base64(text: Column) -> Column:
    return F.translate(F.base64(text.cast("binary")), "+/\r\n", "-_")


def clean_model_text(text: Column) -> Column:
    """A model's reply without reasoning blocks and code fences."""
    t = F.regexp_replace(text, r"(?is)<(think|reasoning)>.*?</\1>", "")
    return F.regexp_replace(F.regexp_replace(t, r"```\w*", ""), r"^\s+|\s+$", "")


def numbered_items(text: Column, most: int) -> Column:
    """The items of a numbered list, without their numbers."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*\d+[.)]\s*", "")))
    return F.slice(F.filter(lines, lambda x: x != ""), 1, most)
