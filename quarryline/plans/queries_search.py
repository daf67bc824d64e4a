"""Registered search and text queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import code_text as ct
from quarryline.functions import expansion
from quarryline.functions import fixed_values as fixed
from quarryline.operators import lines, retrieval
from quarryline.operators.sized import distinct_wide
from quarryline.plans.fixtures import GREP_TOKENS
from quarryline.session import cut_lineage, table
from quarryline.functions.fixed_values import IGNORED
from quarryline.sources.files import code_files, ignore_regex, ignored


def _documents(spark, d):
    return table(spark, d, "documents")


def grep_context(spark, d):
    """Literal grep, first token a line, at most 10 lines a file and token, round robin over files, 10 lines around."""
    docs = _documents(spark, d)
    hits = lines.first_token_per_line(lines.cap_per_file(lines.grep(docs, "doc_id", "text", GREP_TOKENS), "doc_id", 10), "doc_id")
    found = lines.diversify(hits, "doc_id", 40).select("doc_id", "token", "line_no", "line", "slot")
    return lines.with_context(docs.select("doc_id", "text"), "doc_id", "text", found)


def grep_counts(spark, d):
    return lines.grep(_documents(spark, d), "doc_id", "text", GREP_TOKENS).groupBy("token").agg(F.count("*").alias("lines"), F.count_distinct("doc_id").alias("files"))


def line_counts(spark, d):
    return lines.line_table(_documents(spark, d), "doc_id", "text").groupBy("doc_id").agg(F.max("line_no").cast("bigint").alias("lines"), F.sum(F.length("line")).cast("bigint").alias("chars"))


def source_slices(spark, d):
    """The lines a search result's metadata names, cut from its content, bounds as a code reader takes them."""
    rows = distinct_wide(table(spark, d, "search_results").where(F.col("content").isNotNull()).select("entity_id", "content"), ["entity_id"], "content")
    return rows.select("entity_id", lines.slice_lines(F.col("content"), F.lit(2), F.lit(5)).alias("middle"), lines.slice_lines(F.col("content"), F.lit(3), F.lit(0)).alias("tail"))


def sub_chunks(spark, d):
    return lines.sub_chunks(_documents(spark, d), "doc_id", "text", 1200, 800, 100)


def bm25_top(spark, d):
    return retrieval.bm25_top_k(_documents(spark, d), "doc_id", "text", _logged_questions(spark, d), 20)


def _vector_queries(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def cosine_top(spark, d):
    return retrieval.vector_top_k(table(spark, d, "embeddings"), "vec_id", "embedding", _vector_queries(spark, d), 10, exclude_same=True)


def semantic_cache(spark, d):
    """The most similar other entry of each query if it is similar enough."""
    return retrieval.vector_top_k(table(spark, d, "embeddings"), "vec_id", "embedding", _vector_queries(spark, d), 1, exclude_same=True).where("cosine >= 0.3").drop("rank")


def _logged_questions(spark, d):
    """The lexical half of the stated query set: logged questions whose id is divisible by 50."""
    return cut_lineage(_asked(spark, d).where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("question").alias("query")))


def _document_vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def hybrid_top(spark, d):
    vectors, queries = _document_vectors(spark, d), _vector_queries(spark, d)
    lexical = retrieval.bm25_for_fusion(_documents(spark, d), "doc_id", "text", _logged_questions(spark, d), 20, vectors, queries)
    fused = retrieval.hybrid(lexical, retrieval.vector_block_scores(vectors, "doc_id", "embedding", queries), "doc_id", 0.7).withColumn("score", F.round("score", 6))
    return retrieval.top_k(fused, "doc_id", "score", 20)


def rank_fusion(spark, d):
    a = retrieval.bm25_top_k(_documents(spark, d), "doc_id", "text", _logged_questions(spark, d), 50)
    b = retrieval.vector_top_k(_document_vectors(spark, d), "doc_id", "embedding", _vector_queries(spark, d), 50)
    fused = retrieval.reciprocal_rank_fusion([a, b], "doc_id").withColumn("score", F.round("score", 9))
    return retrieval.top_k(fused, "doc_id", "score", 20)


def diversified(spark, d):
    """The best 80 hits of each question, at most two of a repository and two of a source."""
    best = retrieval.bm25_top_k(_documents(spark, d), "doc_id", "text", _logged_questions(spark, d), 80)
    rows = cut_lineage(best.join(_documents(spark, d).select("doc_id", "repository", "source"), "doc_id"))
    return retrieval.diversity_caps(rows, "query_id", "rank", "repository", "source", 2, 2).select("query_id", "doc_id", "rank", "repository", "source")


def rerank_top(spark, d):
    """The best 50 documents of each question by BM25, in the order of the reranker."""
    questions = _logged_questions(spark, d)
    best = retrieval.bm25_top_k(_documents(spark, d), "doc_id", "text", questions, 50)
    rows = best.join(questions, "query_id").join(_documents(spark, d).select("doc_id", "text"), "doc_id")
    return retrieval.rerank(rows, F.col("query"), "text", "doc_id", 20).select("query_id", "doc_id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


def exact_copies(spark, d):
    return _documents(spark, d).where("text is not null").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


def searchable_content(spark, d):
    rows = distinct_wide(table(spark, d, "search_results").select("entity_id", "name", "entity_type", "file_path", "content"), ["entity_id", "name", "entity_type", "file_path"], "content")
    part = lambda head, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(head), c))
    text = F.concat_ws("\n", part("Name: ", F.col("name")), part("Type: ", F.col("entity_type")), part("File: ", F.col("file_path")), part("Module: ", ct.module_name(F.col("file_path"))), part("Code: ", F.col("content")))
    return rows.select("entity_id", F.md5(text).alias("digest"), F.length(text).alias("chars"))


def node_names(spark, d):
    rows = table(spark, d, "search_results").select("entity_id", "file_path").distinct()
    repo = ct.repository_name(F.col("entity_id"))
    return rows.select("entity_id", repo.alias("repository"), ct.node_id(repo, F.col("file_path")).alias("file_id"), ct.basename(F.col("file_path")).alias("file_name"), ct.module_name(F.col("file_path")).alias("module"), F.sha2("entity_id", 256).alias("sha"), ct.url_safe_base64(F.col("entity_id")).alias("b64"))


def repository_urls(spark, d):
    return table(spark, d, "repositories").select("url", ct.repository_from_url(F.col("url")).alias("repository")).distinct()


def metadata_fields(spark, d):
    """Fields of JSON metadata; text that isn't valid JSON gives nulls."""
    v = F.try_parse_json("metadata")
    rows = table(spark, d, "search_results").select("entity_id", v.alias("v"))
    return rows.select("entity_id", F.try_variant_get("v", "$.repository", "string").alias("repository"), F.try_variant_get("v", "$.language", "string").alias("language"), F.try_variant_get("v", "$.end_line", "int").alias("end_line")).distinct()


def normalized_urls(spark, d):
    rows = table(spark, d, "search_results").where("content is not null").select(F.explode(F.regexp_extract_all("content", F.lit(r"['\"](/api/[^'\"\s]*)['\"]"), 1)).alias("url"))
    return rows.distinct().select("url", ct.normalize_url(F.col("url")).alias("normalized"))


def _asked(spark, d):
    return table(spark, d, "chat_logs").where("question is not null").select("id", "question").distinct()


def question_identifiers(spark, d):
    return _asked(spark, d).select("id", ct.identifiers(F.col("question")).alias("found"), ct.code_terms(F.col("question")).alias("terms"))


def question_routing(spark, d):
    q = F.col("question")
    s, c = ct.detect_scope(q), ct.classify_question(q)
    return _asked(spark, d).select("id", ct.detect_strategy(q).alias("strategy"), s["scope"].alias("scope"), F.round(s["confidence"], 6).alias("scope_confidence"), ct.detect_task(q).alias("task"), c["kind"].alias("kind"), c["confidence"].alias("kind_confidence"), ct.diagram_type(q).alias("diagram"))


def question_expansions(spark, d):
    return expansion.expand(table(spark, d, "chat_logs").select("id", "question").distinct(), "id", "question")


def structural_questions(spark, d):
    return _asked(spark, d).where(ct.is_structural(F.col("question"))).select("id")


def case_variants(spark, d):
    words = _asked(spark, d).select(F.explode(F.regexp_extract_all("question", F.lit(r"[A-Za-z_][A-Za-z0-9_]{2,}"), 0)).alias("word")).distinct()
    w = F.col("word")
    return words.where(w.rlike("[a-z][A-Z]") | w.contains("_")).select("word", F.when(w.rlike("[a-z][A-Z]"), ct.camel_to_snake(w)).alias("snake"), F.when(w.contains("_"), ct.snake_to_camel(w)).alias("camel"))


def document_types(spark, d):
    rows = table(spark, d, "parsed_documents").select("parse_id", "file_path").distinct()
    return rows.select("parse_id", ct.document_type(ct.basename(F.col("file_path"))).alias("document_type"))


def document_sections(spark, d):
    rows = table(spark, d, "parsed_documents").where("full_text is not null").select("repository", F.explode("sections").alias("s"))
    return rows.groupBy("repository", F.col("s.level").alias("level")).agg(F.count("*").alias("sections"), F.sum(F.length("s.content")).cast("bigint").alias("chars"))


def ignored_files(spark, d):
    rows = table(spark, d, "search_results").where("entity_type = 'File'").select("entity_id", "file_path").distinct()
    return rows.where(ignored(F.col("file_path"))).select("entity_id")


def indexed_files(spark, d):
    return code_files(table(spark, d, "search_results").where("entity_type = 'File'").select("entity_id", "file_path").distinct()).select("entity_id")


def _q(text):
    return "'" + text.replace("'", "''") + "'"


_QUERIES_SQL = "queries AS (SELECT DISTINCT id AS query_id, question AS query FROM chat_logs WHERE id % 50 = 0 AND question IS NOT NULL)"
_TOKENS = r"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
_BM25 = f"""{_QUERIES_SQL}, terms AS (SELECT query_id, unnest(list_distinct({_TOKENS.format(x='query')})) AS term FROM queries),
doc AS (SELECT doc_id, {_TOKENS.format(x='text')} AS toks FROM documents WHERE text IS NOT NULL), corpus AS (SELECT count(*) AS docs, avg(len(toks)) AS mean FROM doc),
tok AS (SELECT doc_id, len(toks) AS len, unnest(toks) AS term FROM doc), posting AS (SELECT term, doc_id, count(*) AS tf, any_value(len) AS len FROM tok WHERE term IN (SELECT term FROM terms) GROUP BY term, doc_id),
df AS (SELECT term, count(*) AS df FROM posting GROUP BY term),
bm AS (SELECT query_id, doc_id, sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))) AS bm25 FROM posting JOIN df USING (term) JOIN terms USING (term), corpus GROUP BY 1, 2)"""
_COS = "list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY {s} DESC, {k})"
_BOTH = f"{_BM25}, cs AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, {_COS} AS cosine FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0)"


def _array(terms):
    return "[" + ", ".join(map(_q, terms)) + "]"


def _hits(terms):
    return f"len(list_filter({_array(terms)}, lambda k: contains(q, k)))"


def _task_sql():
    return "CASE " + " ".join(f"WHEN regexp_matches(q, {_q('|'.join(f'(?:{p})' for p in ps))}) THEN {_q(t)}" for t, ps in ct.TASK_PATTERNS.items()) + " ELSE 'unknown' END"


def _diagram_sql():
    return "CASE " + " ".join(f"WHEN {_hits(ws)} > 0 THEN {_q(k)}" for k, ws in fixed.DIAGRAM_WORDS) + " ELSE 'sequence' END"


_EDGE = r"(?:^|[^\p{L}\p{N}_])"
QUERIES = {
    "grep_context": grep_context, "grep_counts": grep_counts, "line_counts": line_counts, "source_slices": source_slices, "sub_chunks": sub_chunks, "bm25_top": bm25_top, "cosine_top": cosine_top, "semantic_cache": semantic_cache,
    "hybrid_top": hybrid_top, "rank_fusion": rank_fusion, "diversified": diversified, "rerank_top": rerank_top, "exact_copies": exact_copies, "searchable_content": searchable_content, "node_names": node_names, "repository_urls": repository_urls,
    "metadata_fields": metadata_fields, "normalized_urls": normalized_urls, "question_identifiers": question_identifiers, "question_routing": question_routing, "structural_questions": structural_questions, "question_expansions": question_expansions, "case_variants": case_variants,
    "document_types": document_types, "document_sections": document_sections, "ignored_files": ignored_files, "indexed_files": indexed_files,
}

from quarryline.plans.queries_graph import sql_url  # noqa: E402

_LINES = "ln AS (SELECT doc_id, i AS line_no, regexp_replace(l[i], '\\r$', '') AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)))"
_TOKENS_SQL = "tk AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {_q(t)})" for i, t in enumerate(GREP_TOKENS)) + ") t(token_pos, token))"
ORACLES = {
    "grep_context": f"""WITH {_LINES}, {_TOKENS_SQL}, h AS (SELECT doc_id, line_no, line, token_pos, token FROM ln JOIN tk ON contains(line, token)),
      c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY token, doc_id ORDER BY line_no) AS r FROM h) WHERE r <= 10),
      f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY token_pos) AS r2 FROM c) WHERE r2 = 1),
      s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, token) AS slot, (SELECT count(DISTINCT doc_id) FROM f) AS files FROM f),
      t AS (SELECT * FROM s WHERE slot <= greatest(1, ceil(40 / sqrt(files))) ORDER BY slot, doc_id LIMIT 40)
      SELECT t.doc_id, t.token, t.line_no::INTEGER AS line_no, t.line, t.slot::INTEGER AS slot, array_to_string(string_split(d.text, chr(10))[greatest(1, t.line_no - 10):t.line_no + 10], chr(10)) AS context FROM t JOIN documents d USING (doc_id)""",
    "grep_counts": f"WITH {_LINES}, {_TOKENS_SQL} SELECT token, count(*) AS lines, count(DISTINCT doc_id) AS files FROM ln JOIN tk ON contains(line, token) GROUP BY token",
    "line_counts": f"WITH {_LINES} SELECT doc_id, max(line_no) AS lines, sum(length(line))::BIGINT AS chars FROM ln GROUP BY doc_id",
    "source_slices": "SELECT DISTINCT entity_id, array_to_string(string_split(content, chr(10))[2:5], chr(10)) AS middle, array_to_string(string_split(content, chr(10))[3:], chr(10)) AS tail FROM search_results WHERE content IS NOT NULL",
    "sub_chunks": """WITH p AS (SELECT doc_id, text, CASE WHEN length(text) <= 1200 THEN 1 ELSE ceil((length(text) - 100) / 700.0)::INTEGER END AS parts FROM documents WHERE text IS NOT NULL),
      x AS (SELECT doc_id, text, parts, unnest(range(0, parts))::INTEGER AS part FROM p)
      SELECT doc_id, part, parts, CASE WHEN parts = 1 THEN doc_id::VARCHAR ELSE doc_id || '#part' || part END AS chunk_id, CASE WHEN parts = 1 THEN text ELSE substr(text, part * 700 + 1, 800) END AS chunk FROM x""",
    "bm25_top": f"WITH {_BM25}, r AS (SELECT query_id, doc_id, round(bm25, 6) AS bm25 FROM bm) SELECT * FROM (SELECT *, {_RANK.format(s='bm25', k='doc_id')}::INTEGER AS rank FROM r) WHERE rank <= 20",
    "cosine_top": f"WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round({_COS}, 6) AS cosine FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id) SELECT * FROM (SELECT *, {_RANK.format(s='cosine', k='vec_id')}::INTEGER AS rank FROM s) WHERE rank <= 10",
    "semantic_cache": f"WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round({_COS}, 6) AS cosine FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id) SELECT query_id, vec_id, cosine FROM (SELECT *, {_RANK.format(s='cosine', k='vec_id')} AS rank FROM s) WHERE rank = 1 AND cosine >= 0.3",
    "hybrid_top": f"""WITH {_BOTH}, a AS (SELECT query_id, doc_id, CASE WHEN max(bm25) OVER w > min(bm25) OVER w THEN (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) ELSE 1.0 END AS x FROM bm WINDOW w AS (PARTITION BY query_id)),
      b AS (SELECT query_id, doc_id, CASE WHEN max(cosine) OVER w > min(cosine) OVER w THEN (cosine - min(cosine) OVER w) / (max(cosine) OVER w - min(cosine) OVER w) ELSE 1.0 END AS y FROM cs WINDOW w AS (PARTITION BY query_id)),
      f AS (SELECT query_id, doc_id, round(0.7::DOUBLE * coalesce(y, 0.0::DOUBLE) + (1 - 0.7::DOUBLE) * coalesce(x, 0.0::DOUBLE), 6) AS score FROM a FULL JOIN b USING (query_id, doc_id))
      SELECT * FROM (SELECT *, {_RANK.format(s='score', k='doc_id')}::INTEGER AS rank FROM f) WHERE rank <= 20""",
    "rank_fusion": f"""WITH {_BOTH}, a AS (SELECT * FROM (SELECT query_id, doc_id, {_RANK.format(s='round(bm25, 6)', k='doc_id')} AS r FROM bm) WHERE r <= 50), b AS (SELECT * FROM (SELECT query_id, doc_id, {_RANK.format(s='round(cosine, 6)', k='doc_id')} AS r FROM cs) WHERE r <= 50),
      f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)
      SELECT * FROM (SELECT *, {_RANK.format(s='score', k='doc_id')}::INTEGER AS rank FROM f) WHERE rank <= 20""",
    "rerank_top": f"""WITH {_BM25}, best AS (SELECT * FROM (SELECT query_id, doc_id, {_RANK.format(s='round(bm25, 6)', k='doc_id')} AS r FROM bm) WHERE r <= 50),
      s AS (SELECT query_id, doc_id, len(list_intersect(list_distinct({_TOKENS.format(x='query')}), list_distinct({_TOKENS.format(x='text')}))) / len(list_distinct({_TOKENS.format(x='query')})) AS s0 FROM best JOIN queries USING (query_id) JOIN documents USING (doc_id))
      SELECT query_id, doc_id, round(s0::DOUBLE, 6) AS rerank_score, rank FROM (SELECT *, {_RANK.format(s='s0', k='doc_id')}::INTEGER AS rank FROM s) WHERE rank <= 20""",
    "diversified": f"""WITH RECURSIVE {_BM25}, b AS (SELECT query_id, doc_id, {_RANK.format(s='round(bm25, 6)', k='doc_id')} AS rank FROM bm), best AS (SELECT query_id, doc_id, rank, repository, source FROM b JOIN documents USING (doc_id) WHERE rank <= 80),
      walk AS (SELECT query_id, 0::BIGINT AS rank, NULL::BIGINT AS doc_id, false AS taken, []::VARCHAR[] AS files, []::VARCHAR[] AS kinds, NULL::VARCHAR AS repository, NULL::VARCHAR AS source FROM (SELECT DISTINCT query_id FROM best)
        UNION ALL SELECT w.query_id, n.rank, n.doc_id, ok, CASE WHEN ok THEN list_append(w.files, n.f) ELSE w.files END, CASE WHEN ok THEN list_append(w.kinds, n.k) ELSE w.kinds END, n.repository, n.source
        FROM walk w JOIN (SELECT *, coalesce(repository, '') AS f, coalesce(source, '') AS k FROM best) n ON n.query_id = w.query_id AND n.rank = w.rank + 1,
        LATERAL (SELECT len(list_filter(w.files, lambda x: x = n.f)) < 2 AND len(list_filter(w.kinds, lambda x: x = n.k)) < 2 AS ok))
      SELECT query_id, doc_id, rank::INTEGER AS rank, repository, source FROM walk WHERE taken""",
    "exact_copies": "SELECT md5(text) AS digest, min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "searchable_content": """WITH r AS (SELECT DISTINCT entity_id, name, entity_type, file_path, content FROM search_results),
      t AS (SELECT entity_id, concat_ws(chr(10), 'Name: ' || nullif(name, ''), 'Type: ' || nullif(entity_type, ''), 'File: ' || nullif(file_path, ''), 'Module: ' || nullif(regexp_replace(replace(file_path, '/', '.'), '\\.py$', ''), ''), 'Code: ' || nullif(content, '')) AS x FROM r)
      SELECT entity_id, md5(x) AS digest, length(x)::INTEGER AS chars FROM t""",
    "node_names": "SELECT DISTINCT entity_id, split_part(entity_id, ':', 2) AS repository, 'repo:' || split_part(entity_id, ':', 2) || ':' || file_path AS file_id, string_split(file_path, '/')[-1] AS file_name, regexp_replace(replace(file_path, '/', '.'), '\\.py$', '') AS module, sha256(entity_id) AS sha, translate(to_base64(entity_id::BLOB), '+/', '-_') AS b64 FROM search_results",
    "repository_urls": "SELECT DISTINCT url, regexp_replace(string_split(regexp_replace(url, '/+$', ''), '/')[-1], '\\.git$', '') AS repository FROM repositories",
    "metadata_fields": "SELECT DISTINCT entity_id, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.repository') END AS repository, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.language') END AS language, CASE WHEN json_valid(metadata) THEN TRY_CAST(json_extract_string(metadata, '$.end_line') AS INTEGER) END AS end_line FROM search_results",
    "normalized_urls": f"WITH u AS (SELECT DISTINCT unnest(regexp_extract_all(content, '[''\"](/api/[^''\"\\s]*)[''\"]', 1)) AS url FROM search_results WHERE content IS NOT NULL) SELECT url, {sql_url('url')} AS normalized FROM u",
    "question_identifiers": f"""WITH a AS (SELECT DISTINCT id, question FROM chat_logs WHERE question IS NOT NULL),
      r AS (SELECT id, list_filter(list_concat(list_concat(regexp_extract_all(question, {_q(ct.SNAKE)}), regexp_extract_all(question, {_q(ct.CAMEL)})), regexp_extract_all(question, {_q(ct.CONSTANT)})), lambda t: length(t) >= 4 AND lower(t) NOT IN ('self', 'cls', 'true', 'false', 'none', 'null', 'undefined')) AS x,
        list_concat(list_concat(regexp_extract_all(question, {_q(ct.TERM_PATTERNS[0])}), regexp_extract_all(question, {_q(ct.TERM_PATTERNS[1])})), regexp_extract_all(question, {_q(ct.TERM_PATTERNS[2])})) AS y FROM a)
      SELECT id, list_sort(list_filter(x, lambda t, i: list_position(x, t) = i)[1:5]) AS found, list_sort(list_distinct(y)) AS terms FROM r""",
    "question_routing": f"""WITH a AS (SELECT DISTINCT id, lower(question) AS q FROM chat_logs WHERE question IS NOT NULL),
      k AS (SELECT id, q, {_hits(fixed.HYBRID_WORDS)} AS h, {_hits(fixed.FRONTEND_WORDS)} AS f, {_hits(fixed.BACKEND_WORDS)} AS b, {_hits(fixed.DOCUMENT_WORDS)} AS dn, {_hits(fixed.CODE_WORDS)} AS cn, {_hits(fixed.VISUAL_WORDS)} AS vn,
        {_hits(fixed.DATA_WORDS)} AS dw, {_hits(fixed.UI_USE_WORDS)} AS uu, {_hits(fixed.UI_WORDS)} AS uw, {_hits(fixed.DATA_LINK_WORDS)} AS dl FROM a)
      SELECT id, CASE WHEN dw > 0 AND uu > 0 THEN 'database_to_ui' WHEN uw > 0 AND dl > 0 THEN 'ui_to_database' ELSE 'semantic_only' END AS strategy,
        CASE WHEN h > 0 OR (f > 0 AND b > 0) THEN 'hybrid' WHEN f > b THEN 'frontend' WHEN b > f THEN 'backend' ELSE 'unknown' END AS scope,
        round((CASE WHEN h > 0 THEN 0.9 WHEN f > 0 AND b > 0 THEN least(0.8, (f + b) / 10) WHEN f > b THEN least(0.9, f / 5) WHEN b > f THEN least(0.9, b / 5) ELSE 0.0 END)::DOUBLE, 6) AS scope_confidence, {_task_sql()} AS task,
        CASE WHEN (dn > 0)::INT + (cn > 0)::INT + (vn > 0)::INT >= 2 THEN 'hybrid' WHEN cn >= dn AND cn >= vn THEN 'code' WHEN dn > vn THEN 'document' ELSE 'visual' END AS kind,
        (CASE WHEN (dn > 0)::INT + (cn > 0)::INT + (vn > 0)::INT >= 2 THEN 0.7 ELSE 0.6 END)::DOUBLE AS kind_confidence, {_diagram_sql()} AS diagram FROM k""",
    "structural_questions": f"""SELECT DISTINCT id FROM chat_logs WHERE question IS NOT NULL AND (regexp_matches(question, '(?i)\\b(?:how\\s+many|count|number\\s+of|total)\\b|\\b(?:inherits?|extends?|subclass|parent\\s+class|derived\\s+from)\\b|\\b(?:calls?|uses?|invokes?|imports?|renders?|depends?\\s+on)\\b|/(?:api|backend|v\\d+)/[\\p{{L}}\\p{{N}}_\\-/{{}}<>:?]+|\\b(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\\s+/')
      OR regexp_matches(question, '(?i){_EDGE}(?:наследу|подклас|базовый\\s+класс|родитель|вызывает|использует|связан|зависит|импортирует|рендерит)') OR regexp_matches(question, '(?i){_EDGE}(?:сколько|количество)(?:$|[^\\p{{L}}\\p{{N}}_])')
      OR regexp_matches(question, '\\b(?:Endpoint|Component|Model|Route|ApiCall|Function|Method|Class)s?\\b|\\b[A-Z][a-z]+[A-Z][A-Za-z0-9]*\\b'))""",
    "question_expansions": f"""WITH dict AS (SELECT * FROM (VALUES {', '.join(f"({n}, {_q(t)}, {_q(r)}, {str(w).lower()})" for n, t, r, w in expansion.dictionary())}) t(rank, term, replacement, whole)), q AS (SELECT DISTINCT id, question, lower(question) AS l FROM chat_logs WHERE question IS NOT NULL),
      w AS (SELECT id, question, i, ws[i] AS w FROM (SELECT id, question, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT id, question, regexp_extract_all(question, '[\\p{{L}}\\p{{N}}_]{{3,}}') AS ws FROM q))),
      c AS (SELECT id, question, 1000000 + i * 2 AS rank, replace(question, w, lower(regexp_replace(w, '([a-z])([A-Z])', '\\1_\\2', 'g'))) AS v FROM w WHERE regexp_matches(w, '[a-z][A-Z]')
        UNION ALL SELECT id, question, 1000001 + i * 2, replace(question, w, string_split(w, '_')[1] || array_to_string(list_transform(string_split(w, '_')[2:], lambda p: upper(p[1:1]) || lower(p[2:])), '')) FROM w WHERE contains(w, '_')),
      v AS (SELECT id, question, -1 AS rank, question AS v FROM q UNION ALL SELECT id, question, rank, replace(l, term, replacement) FROM q JOIN dict ON CASE WHEN whole THEN list_contains(regexp_split_to_array(l, '\\s+'), term) ELSE contains(l, term) END UNION ALL SELECT id, question, rank, v FROM c),
      f AS (SELECT id, question, v, min(rank) AS rank FROM v GROUP BY ALL)
      SELECT id, pos::INTEGER AS pos, v AS variant FROM (SELECT *, row_number() OVER (PARTITION BY id, question ORDER BY rank) - 1 AS pos FROM f) WHERE pos < 5""",
    "case_variants": """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(question, '[A-Za-z_][A-Za-z0-9_]{2,}')) AS word FROM chat_logs WHERE question IS NOT NULL)
      SELECT word, CASE WHEN regexp_matches(word, '[a-z][A-Z]') THEN lower(regexp_replace(word, '([a-z])([A-Z])', '\\1_\\2', 'g')) END AS snake,
        CASE WHEN contains(word, '_') THEN string_split(word, '_')[1] || array_to_string(list_transform(string_split(word, '_')[2:], lambda p: upper(p[1:1]) || lower(p[2:])), '') END AS camel FROM w WHERE regexp_matches(word, '[a-z][A-Z]') OR contains(word, '_')""",
    "document_types": """WITH r AS (SELECT DISTINCT parse_id, lower(string_split(file_path, '/')[-1]) AS n FROM parsed_documents)
      SELECT parse_id, CASE WHEN contains(n, 'инструкц') OR contains(n, 'instruction') THEN 'Instruction' WHEN contains(n, 'соп') OR contains(n, 'sop') THEN 'SOP' WHEN contains(n, 'политик') OR contains(n, 'policy') THEN 'Policy' WHEN contains(n, 'руководств') OR contains(n, 'manual') THEN 'Manual' WHEN contains(n, 'процедур') OR contains(n, 'procedure') THEN 'Procedure' ELSE 'Document' END AS document_type FROM r""",
    "document_sections": "SELECT repository, s.level AS level, count(*) AS sections, sum(length(s.content))::BIGINT AS chars FROM (SELECT repository, unnest(sections) AS s FROM parsed_documents WHERE full_text IS NOT NULL) GROUP BY 1, 2",
    "ignored_files": f"SELECT DISTINCT entity_id FROM search_results WHERE entity_type = 'File' AND regexp_matches(file_path, {_q(ignore_regex(IGNORED).replace('(?>', '(?:'))})",
    "indexed_files": "SELECT DISTINCT entity_id FROM search_results WHERE entity_type = 'File' AND regexp_matches(file_path, '\\.(py|js|jsx|ts|tsx)$') AND NOT contains(lower(string_split(file_path, '/')[-1]), 'test') AND NOT regexp_matches(file_path, 'migration|node_modules|venv|dist|build|__pycache__')",
}
