"""Registered usage, traceback, extraction and streaming queries and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarryline.functions import code_text as ct
from quarryline.operators import extract, tracebacks, usage
from quarryline.operators.sized import distinct_wide
from quarryline.operators.retrieval import first_seen
from quarryline.functions.fixed_values import DJANGO_MARKS, FASTAPI_MARKS
from quarryline.session import shared_folder, table
from quarryline.sources.files import project_profile
from quarryline.streaming import ingest


def _logs(spark, d):
    return usage.delivered_once(table(spark, d, "chat_logs"))


def usage_totals(spark, d):
    return usage.usage_stats(_logs(spark, d))


def usage_by_type(spark, d):
    return usage.usage_stats(_logs(spark, d).withColumn("question_type", F.coalesce("question_type", F.lit("none"))), ["question_type"])


def usage_by_day(spark, d):
    return usage.usage_stats(_logs(spark, d).withColumn("day", F.to_date("created_at")), ["day"])


def usage_last_week(spark, d):
    logs = _logs(spark, d)
    last = logs.agg(F.max("created_at").alias("_last"))
    rows = logs.crossJoin(F.broadcast(last))
    return usage.in_window(rows, "created_at", F.col("_last"), 7).groupBy("question_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def active_roles(spark, d):
    users = first_seen(table(spark, d, "users"), ["user_id"], [F.col("created_at").desc_nulls_last(), F.col("last_seen_at").desc_nulls_last()])
    return users.where("is_active = 1").groupBy(F.lower(F.trim("role")).alias("role")).agg(F.count("*").alias("n"))


def user_history(spark, d):
    return usage.latest_per_user(_logs(spark, d), 3).select("user_id", "id", "question_type", "created_at", "recency")


def one_history(spark, d):
    """The history of the user with the most logs."""
    logs = _logs(spark, d)
    most = logs.where("user_id is not null").groupBy("user_id").count().orderBy(F.col("count").desc(), "user_id").first()
    return usage.history(logs, most.user_id if most else -1).select("id", "question_type", "created_at")


def user_upserts(spark, d):
    users = first_seen(table(spark, d, "users"), ["user_id"], [F.col("created_at").desc_nulls_last(), F.col("last_seen_at").desc_nulls_last()])
    seen = _logs(spark, d).where("user_id is not null").groupBy("user_id", F.col("created_at").alias("seen_at")).agg(F.max("username").alias("username"))
    return usage.upsert_users(users, seen).select("user_id", "created_at", "last_seen_at")


def interaction_counters(spark, d):
    return _logs(spark, d).where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("total_queries"), F.max("created_at").alias("last_seen_at"))


def feedback_by_type(spark, d):
    f = table(spark, d, "feedback").select("id", "log_id", "rating").distinct()
    logs = _logs(spark, d).select(F.col("id").alias("log_id"), "question_type")
    return f.join(logs, "log_id", "left").groupBy("question_type").agg(F.count("*").alias("n"), F.count("rating").alias("rated"), F.sum("rating").alias("total"))


def repositories_to_index(spark, d):
    rows = table(spark, d, "repositories").where("name is not null")
    current = first_seen(rows, ["name"], [F.col("last_updated").desc_nulls_last(), F.col("commit_hash").asc_nulls_last()])
    state = first_seen(rows, ["name"], [F.col("last_updated").asc_nulls_last(), F.col("commit_hash").asc_nulls_last()])
    return usage.needs_reindex(current, state)


def file_changes(spark, d):
    """Between the files an indexer knows (parser runs) and those it finds (search results)."""
    new = table(spark, d, "search_results").where("entity_type = 'File'").groupBy(F.col("entity_id").alias("path")).agg(F.md5(F.max("content")).alias("hash"))
    old = table(spark, d, "parsed_documents").where("full_text is null").select(F.concat(F.lit("repo:"), F.col("repository"), F.lit(":"), F.col("file_path")).alias("path")).distinct().where("path is not null").join(new, "path", "left").select("path", F.coalesce("hash", F.lit("")).alias("hash"))
    return usage.changed_files(old, new)


def cache_accesses(spark, d):
    hits = usage.cache_hits(table(spark, d, "events"), "user_id", "ts", 3600)
    return hits.groupBy("user_id").agg(F.count("*").alias("accesses"), F.sum(F.col("hit").cast("bigint")).alias("hits"))


def parsed_tracebacks(spark, d):
    rows = distinct_wide(table(spark, d, "tracebacks").select("traceback_id", "raw_text"), ["traceback_id"], "raw_text")
    p = tracebacks.parse_tracebacks(rows, "traceback_id", "raw_text")
    return p.select("traceback_id", F.size("frames").cast("bigint").alias("n_frames"), "exception_type", F.coalesce(F.try_element_at(F.transform("frames", lambda f: f["function_name"]), F.lit(-1)), F.lit("")).alias("last_function"))


def exception_counts(spark, d):
    return table(spark, d, "tracebacks").select("traceback_id", "repository", "exception_type").distinct().groupBy("repository", "exception_type").agg(F.count("*").alias("n"))


def extracted_entities(spark, d):
    files = distinct_wide(table(spark, d, "search_results").where("entity_type = 'File'").select("entity_id", "file_path", "content"), ["entity_id", "file_path"], "content")
    rows = extract.extract_entities(files)
    return rows.groupBy(ct.repository_name(F.col("key")).alias("repository"), "entity_kind").agg(F.count("*").alias("n"))


def framework_votes(spark, d):
    files = distinct_wide(table(spark, d, "search_results").where("entity_type = 'File' and file_path like '%.py'").select("entity_id", "content"), ["entity_id"], "content")
    return files.select("entity_id", extract.framework_vote(F.col("content")).alias("framework"))


def project_profiles(spark, d):
    files = distinct_wide(table(spark, d, "search_results").where("entity_type = 'File'").select(ct.repository_name(F.col("entity_id")).alias("repository"), "file_path", "content"), ["repository", "file_path"], "content")
    return project_profile(files).select("repository", F.array_join("languages", ",").alias("languages"), "project_type", "confidence")


def _events_stream(spark, d):
    return ingest.file_stream(spark, d, table(spark, d, "events").schema, glob="events.parquet")


def _drained(spark, stream, mode):
    return ingest.run_once(stream, f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}", mode)


def stream_usage(spark, d):
    """Daily counts and sums of a stream, drained into a table."""
    agg = ingest.windowed_usage(ingest.deduplicated(_events_stream(spark, d), ["event_id"], "ts"), "ts", "event_type", "value", lateness=None)
    return _drained(spark, agg.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total")), "complete")


def sessions(spark, d):
    return ingest.sessions(table(spark, d, "events"), "ts", "user_id").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


_LOGS = "logs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at NULLS LAST) AS rn FROM chat_logs) WHERE rn = 1)"
_STATS = "count(*) AS requests, count(*) FILTER (WHERE success = 1) AS successes, coalesce(floor(avg(response_time_ms)), 0)::BIGINT AS avg_ms, (CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE success = 1) * 100.0::DOUBLE / count(*), 4) ELSE 0 END)::DOUBLE AS success_rate, count(DISTINCT user_id) AS users"
_LATEST_USERS = "u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS LAST, last_seen_at DESC NULLS LAST) AS rn FROM users) WHERE rn = 1)"
QUERIES = {
    "usage_totals": usage_totals, "usage_by_type": usage_by_type, "usage_by_day": usage_by_day, "usage_last_week": usage_last_week, "active_roles": active_roles, "user_history": user_history, "one_history": one_history, "user_upserts": user_upserts,
    "interaction_counters": interaction_counters, "feedback_by_type": feedback_by_type, "repositories_to_index": repositories_to_index, "file_changes": file_changes, "cache_accesses": cache_accesses, "parsed_tracebacks": parsed_tracebacks,
    "exception_counts": exception_counts, "extracted_entities": extracted_entities, "framework_votes": framework_votes, "project_profiles": project_profiles, "stream_usage": stream_usage, "sessions": sessions,
}
ORACLES = {
    "usage_totals": f"WITH {_LOGS} SELECT {_STATS} FROM logs",
    "usage_by_type": f"WITH {_LOGS} SELECT coalesce(question_type, 'none') AS question_type, {_STATS} FROM logs GROUP BY 1",
    "usage_by_day": f"WITH {_LOGS} SELECT created_at::DATE AS day, {_STATS} FROM logs GROUP BY 1",
    "usage_last_week": f"WITH {_LOGS}, m AS (SELECT max(created_at) AS last FROM logs) SELECT question_type, count(*) AS n, count(DISTINCT user_id) AS users FROM logs, m WHERE created_at > last - INTERVAL 7 DAY GROUP BY 1",
    "active_roles": f"WITH {_LATEST_USERS} SELECT lower(trim(role)) AS role, count(*) AS n FROM u WHERE is_active = 1 GROUP BY 1",
    "user_history": f"WITH {_LOGS} SELECT user_id, id, question_type, created_at, recency::INTEGER AS recency FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS LAST, id DESC) AS recency FROM logs WHERE user_id IS NOT NULL) WHERE recency <= 3",
    "one_history": f"WITH {_LOGS} SELECT id, question_type, created_at FROM logs WHERE user_id = (SELECT user_id FROM logs WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1) ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 50",
    "user_upserts": f"""WITH {_LOGS}, {_LATEST_USERS}, s AS (SELECT user_id, max(created_at) AS seen, min(created_at) AS first FROM logs WHERE user_id IS NOT NULL GROUP BY 1)
      SELECT user_id, coalesce(u.created_at, s.first) AS created_at, greatest(u.last_seen_at, s.seen) AS last_seen_at FROM u FULL JOIN s USING (user_id)""",
    "interaction_counters": f"WITH {_LOGS} SELECT user_id, count(*) AS total_queries, max(created_at) AS last_seen_at FROM logs WHERE user_id IS NOT NULL GROUP BY 1",
    "feedback_by_type": f"WITH {_LOGS}, f AS (SELECT DISTINCT id, log_id, rating FROM feedback) SELECT question_type, count(*) AS n, count(rating) AS rated, sum(rating)::BIGINT AS total FROM f LEFT JOIN logs ON logs.id = f.log_id GROUP BY 1",
    "repositories_to_index": """WITH c AS (SELECT * FROM (SELECT name, commit_hash, row_number() OVER (PARTITION BY name ORDER BY last_updated DESC NULLS LAST, commit_hash NULLS LAST) AS r FROM repositories WHERE name IS NOT NULL) WHERE r = 1),
      o AS (SELECT * FROM (SELECT name, commit_hash, row_number() OVER (PARTITION BY name ORDER BY last_updated NULLS LAST, commit_hash NULLS LAST) AS r FROM repositories WHERE name IS NOT NULL) WHERE r = 1)
      SELECT c.name, c.commit_hash, 'changed' AS reason FROM c JOIN o USING (name) WHERE c.commit_hash IS DISTINCT FROM o.commit_hash""",
    "file_changes": """WITH n AS (SELECT entity_id AS path, md5(max(content)) AS hash FROM search_results WHERE entity_type = 'File' GROUP BY 1),
      o AS (SELECT DISTINCT 'repo:' || repository || ':' || file_path AS path FROM parsed_documents WHERE full_text IS NULL AND repository IS NOT NULL AND file_path IS NOT NULL)
      SELECT n.path, 'added' AS change FROM n WHERE path NOT IN (SELECT path FROM o) UNION ALL SELECT path, 'removed' FROM o WHERE path NOT IN (SELECT path FROM n)""",
    "parsed_tracebacks": r"""WITH t AS (SELECT DISTINCT traceback_id, raw_text FROM tracebacks), l AS (SELECT traceback_id, list_transform(string_split(regexp_replace(regexp_replace(coalesce(raw_text, ''), '^\s+', ''), '\s+$', ''), chr(10)), lambda x: regexp_replace(x, '\r$', '')) AS l FROM t),
      p AS (SELECT traceback_id, list_filter(l, lambda x: regexp_matches(x, 'File "([^"]+)", line (\d+), in (\w+)')) AS fr, list_filter(l, lambda x: x <> '' AND x[1] <> ' ' AND NOT regexp_matches(x, 'File "([^"]+)", line (\d+), in (\w+)') AND (regexp_matches(x, '^[\w.]+:\s*') OR (regexp_matches(x, '^[\w.]+$') AND contains(x, '.')))) AS ex FROM l)
      SELECT traceback_id, len(fr) AS n_frames, coalesce(regexp_extract(ex[-1], '^([\w.]+)', 1), '') AS exception_type, coalesce(regexp_extract(fr[-1], 'in (\w+)', 1), '') AS last_function FROM p""",
    "exception_counts": "SELECT repository, exception_type, count(*) AS n FROM (SELECT DISTINCT traceback_id, repository, exception_type FROM tracebacks) GROUP BY 1, 2",
    "framework_votes": f"""WITH f AS (SELECT DISTINCT entity_id, content FROM search_results WHERE entity_type = 'File' AND file_path LIKE '%.py'),
      v AS (SELECT entity_id, len(list_filter({list(DJANGO_MARKS)}, lambda m: contains(content, m))) AS d, len(list_filter({list(FASTAPI_MARKS)}, lambda m: contains(content, m))) AS f FROM f)
      SELECT entity_id, CASE WHEN d >= 2 AND d > f THEN 'django' WHEN f >= 2 THEN 'fastapi' ELSE 'python' END AS framework FROM v""",
    "stream_usage": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY 1, 2",
    "sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events),
      s AS (SELECT user_id, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1""",
}
