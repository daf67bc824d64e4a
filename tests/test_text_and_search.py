import math

from pyspark.sql import functions as F

from quarryline.functions import code_text as ct
from quarryline.operators import lines, retrieval


def column(spark, f, *values):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v string")
    return [r.x for r in df.select("n", f(F.col("v")).alias("x")).orderBy("n").collect()]


def test_normalize_url(spark):
    urls = ["", None, "/", "/api/users/", "https://h.example/api/x/12?y=1", "/a/${id}/b", "/a/:id", "/a/<int:pk>/", "/a/{x}/9", "/a//b", "/api/550e8400-e29b-41d4-a716-446655440000"]
    want = ["", "", "", "/api/users", "/api/x/{param}", "/a/{param}/b", "/a/{param}", "/a/{param}", "/a/{param}/{param}", "/a/b", "/api/{param}"]
    got = column(spark, ct.normalize_url, *urls)
    assert got == want
    assert column(spark, ct.normalize_url, *got) == got


def test_names(spark):
    assert column(spark, ct.repository_name, "repo:my-project", "repo:my-project/src/file.py", "repo:my-project/src/file.py:MyClass", "invalid") == ["my-project"] * 3 + ["unknown"]
    assert column(spark, ct.repository_from_url, "https://h/x/repo.git", "git@h:x/other/") == ["repo", "other"]
    assert column(spark, ct.camel_to_snake, "getUserName") == ["get_user_name"]
    assert column(spark, ct.snake_to_camel, "get_user_NAME") == ["getUserName"]
    assert column(spark, ct.trace_path, "/app/a/b/c/d.py", "src/x.py") == ["b/c/d.py", "x.py"]
    assert column(spark, lambda c: ct.numbered_items(c, 2), "1. a\n2) b\n3. c") == [["a", "b"]]
    assert column(spark, ct.clean_model_text, "<think>no</think>```sql\nSELECT 1\n```") == ["SELECT 1"]


def test_identifiers(spark):
    assert column(spark, ct.identifiers, "where is net_pos and getPosition or MAX_RETRIES, self true", "") == [["MAX_RETRIES", "getPosition", "net_pos"], []]


def test_routing(spark):
    assert column(spark, ct.detect_strategy, "where is the user model used", "button calls api", "hello") == ["database_to_ui", "ui_to_database", "semantic_only"]
    assert [s.scope for s in column(spark, ct.detect_scope, "full flow", "react page", "sql query", "zzz")] == ["hybrid", "frontend", "backend", "unknown"]
    assert column(spark, ct.detect_task, "как добавить заказ", "how to delete it", "zzz") == ["create", "delete", "unknown"]
    assert column(spark, ct.is_structural, "сколько классов", "GET /api/x", "UserView", "plain words") == [True, True, True, False]


def texts(spark, *values):
    return spark.createDataFrame([(n, v) for n, v in enumerate(values)], "id int, text string")


def test_grep_and_context(spark):
    t = texts(spark, "a\nfoo b\r\nc foo bar\n", None, "", "nothing")
    hits = lines.first_token_per_line(lines.grep(t, "id", "text", ["bar", "foo"]), "id")
    got = lines.with_context(t, "id", "text", lines.diversify(lines.cap_per_file(hits, "id", 10), "id", 5), 1).orderBy("line_no").collect()
    assert [(r.line_no, r.token, r.line) for r in got] == [(2, "foo", "foo b"), (3, "bar", "c foo bar")]
    assert got[0].context == "a\nfoo b\r\nc foo bar"


def test_diversify_model(spark):
    rows = [(f, n, "t") for f, count in (("a", 9), ("b", 2), ("c", 1)) for n in range(1, count + 1)]
    df = spark.createDataFrame(rows, "id string, line_no int, token string")
    total = 6
    quota = max(1, math.ceil(total / math.sqrt(3)))
    want, slot = [], 1
    while slot <= quota and len(want) < total:
        want += [(f, slot) for f, count in (("a", 9), ("b", 2), ("c", 1)) if slot <= count]
        slot += 1
    got = [(r.id, r.slot) for r in lines.diversify(df, "id", total).orderBy("slot", "id").collect()]
    assert got == want[:total]


def test_sub_chunks_reassemble(spark):
    long = "".join(chr(97 + i % 26) for i in range(5000))
    got = lines.sub_chunks(texts(spark, long, "short", "", None), "id", "text", 1000, 800, 100).orderBy("id", "part").collect()
    parts = [r.chunk for r in got if r.id == 0]
    assert parts[0] + "".join(p[100:] for p in parts[1:]) == long
    assert [r.chunk_id for r in got if r.id == 1] == ["1"] and [r.chunk for r in got if r.id == 2] == [""]


def test_slices(spark):
    t = texts(spark, "1\n2\n3\n4")
    f = lambda a, b: t.select(lines.slice_lines(F.col("text"), F.lit(a), F.lit(b)).alias("x")).first().x
    assert (f(2, 3), f(0, 1), f(3, 0), f(3, 99), f(9, 0)) == ("2\n3", "1", "3\n4", "3\n4", "")


def test_bm25_against_model(spark):
    docs = ["a b a c", "b c", "", "d d d", None, "a"]
    q = spark.createDataFrame([(0, "a d"), (1, "zzz")], "query_id int, query string")
    got = {r.id: r.bm25 for r in retrieval.bm25(texts(spark, *docs), "id", "text", q).collect()}
    toks = {i: (d or "").split() for i, d in enumerate(docs) if d is not None}
    mean = sum(map(len, toks.values())) / len(toks)
    want = {}
    for term in ("a", "d"):
        df = sum(term in t for t in toks.values())
        for i, t in toks.items():
            if term in t:
                tf = t.count(term)
                want[i] = want.get(i, 0) + math.log(1 + (len(toks) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_fusion_takes_every_fiftieth_id(spark):
    import random
    import tempfile

    from quarryline.plans import queries_search as qs

    rng = random.Random(3)
    words = [f"w{n}" for n in range(40)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    documents = [(n, say(rng.randint(1, 30))) for n in range(160)] + [(160, None), (161, "w1"), (162, "w1")]
    vectors = [(n, [rng.uniform(-1, 1) for _ in range(4)]) for n in range(110)]
    chats = [(n, say(4)) for n in (0, 1, 50, 50, 150, 151)]
    d = tempfile.mkdtemp()
    for name, rows, columns in (("documents", documents, "doc_id bigint, text string"), ("embeddings", vectors, "vec_id bigint, embedding array<float>"), ("chat_logs", chats, "id bigint, question string")):
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    docs, asked = spark.createDataFrame(documents, "doc_id bigint, text string"), spark.createDataFrame(list({q: t for q, t in chats if q % 50 == 0 and q != 50}.items()) + [(50, " ".join(t for q, t in chats if q == 50))], "query_id bigint, query string")
    lexical = retrieval.bm25(docs, "doc_id", "text", asked)
    stated = spark.createDataFrame([v for v in vectors if v[0] % 50 == 0], "query_id bigint, vector array<float>")
    cosines = retrieval.vector_scores(spark.createDataFrame(vectors, "doc_id bigint, embedding array<float>"), "doc_id", "embedding", stated)
    rows = lambda df, c: sorted((r.query_id, r["rank"], r.doc_id, round(r[c], 6)) for r in df.collect())
    want = rows(retrieval.top_k(retrieval.hybrid(lexical, cosines, "doc_id", 0.7).withColumn("score", F.round("score", 6)), "doc_id", "score", 20), "score")
    assert rows(qs.hybrid_top(spark, d), "score") == want and {r[0] for r in want} == {0, 50, 100, 150}
    a, b = (retrieval.top_k(x.withColumn(c, F.round(c, 6)), "doc_id", c, 50) for x, c in ((lexical, "bm25"), (cosines, "cosine")))
    want = rows(retrieval.top_k(retrieval.reciprocal_rank_fusion([a, b], "doc_id").withColumn("score", F.round("score", 9)), "doc_id", "score", 20), "score")
    assert rows(qs.rank_fusion(spark, d), "score") == want
    # Small blocks change nothing.
    blocks = {(r.query_id, r["rank"]): r.doc_id for r in retrieval.bm25_top_k(docs, "doc_id", "text", asked, 5, query_block=2, document_block=16).collect()}
    assert blocks == {(r.query_id, r["rank"]): r.doc_id for r in retrieval.top_k(lexical.withColumn("bm25", F.round("bm25", 6)), "doc_id", "bm25", 5).collect()}


def test_diversity_caps_greedy(spark):
    rows = [(0, n, f, name) for n, (f, name) in enumerate([("1", "a"), ("2", "a"), ("3", "a"), ("3", "b"), ("f", "c"), ("3", ""), ("3", "")])]
    df = spark.createDataFrame(rows, "q int, pos int, file string, name string")
    kept = {r.pos for r in retrieval.diversity_caps(df, "q", "pos", "file", "name", 2, 2).collect()}
    assert kept == {0, 1, 3, 4, 5}
    assert retrieval.diversity_caps(df, "q", "pos", "file", "name", 0, 0).count() == 7


def test_hybrid_and_rerank(spark):
    lex = spark.createDataFrame([(0, 1, 2.0), (0, 2, 1.0)], "query_id int, id int, bm25 double")
    vec = spark.createDataFrame([(0, 2, 0.9), (0, 3, 0.1)], "query_id int, id int, cosine double")
    got = {r.id: round(r.score, 3) for r in retrieval.hybrid(lex, vec, "id", 0.7).collect()}
    assert got == {1: 0.3, 2: 0.7, 3: 0.0}
    emb = {r.id: r.embedding for r in retrieval.hash_embeddings(texts(spark, "a b", "", None), "id", "text", 8).collect()}
    assert abs(sum(x * x for x in emb[0]) - 1) < 1e-5 and emb[1] == [0.0] * 8


def test_rerank_reads_whole_texts(spark):
    rows = texts(spark, "pad " * 5000 + "needle hay", "needle", "hay " * 10, None).where("text is not null").selectExpr("0 as query_id", "'needle hay' as query", "id", "text")
    ranked = lambda **k: [(r.id, r.rerank_score) for r in retrieval.rerank(rows, F.col("query"), "text", "id", 3, **k).orderBy("rank").collect()]
    assert ranked() == [(0, 1.0), (1, 0.5), (2, 0.5)]
    # In windows of a budget every place of the text is seen, also one on the border of two windows.
    assert ranked(budget=64) == ranked() and ranked(budget=19_999) == ranked()


def test_cosine_zero_vector(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id int, v array<float>")
    got = {r.id: r.cosine for r in retrieval.vector_scores(v, "id", "v", v.where("id = 2").select(F.lit(0).alias("query_id"), F.col("v").alias("vector"))).collect()}
    assert got == {1: 0.0, 2: 1.0}


def test_vector_top_k_against_model(spark):
    import random

    rng = random.Random(7)
    rows = [(n, [rng.uniform(-1, 1) for _ in range(4)]) for n in range(60)] + [(60, [0.0] * 4), (61, None)]
    rows += [(62, rows[3][1])]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    q = df.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    got = {(r.query_id, r["rank"]): (r.id, r.cosine) for r in retrieval.vector_top_k(df, "id", "v", q, 5, exclude_same=True, query_block=2, vector_block=16).collect()}
    full = retrieval.vector_scores(df.where("v is not null"), "id", "v", q).where("query_id <> id").withColumn("cosine", F.round("cosine", 6))
    want = {(r.query_id, r["rank"]): (r.id, r.cosine) for r in retrieval.top_k(full, "id", "cosine", 5).collect()}
    assert got == want


def test_context_caps_and_diagrams(spark):
    from quarryline.plans import render

    rows = [(str(n), "grep", float(n)) for n in range(12)] + [("p", "primary", 1.0)]
    df = spark.createDataFrame(rows, "id string, source string, score double")
    kept = {r.id for r in retrieval.cap_per_source(df, "score", {"grep": 3}).collect()}
    assert kept == {"11", "10", "9", "p"} and retrieval.source_counts(df).first().grep == 12
    steps = spark.createDataFrame([(2, "B", "C", "y"), (1, "A", "B", "x")], "pos int, src string, dst string, text string")
    assert render.sequence_diagram(steps).first().text == "sequenceDiagram\n    A->>B: x\n    B->>C: y"
    e = spark.createDataFrame([("Post", "FOREIGN_KEY", "User")], "src_name string, type string, dst_name string")
    assert render.entity_diagram(e).first().text == "erDiagram\n    Post }o--|| User : foreign_key"


def test_expansion(spark):
    from quarryline.functions.expansion import expand

    got = [r.variant for r in expand(texts(spark, "delete via api", None), "id", "text", most=3).orderBy("pos").collect()]
    assert got == ["delete via api", "remove via api", "destroy via api"]
