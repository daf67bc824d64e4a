"""Encoding and shared spans."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm import shared_spans, tokenizer

pytestmark = pytest.mark.skipif(not os.path.exists(tokenizer.vocabulary()), reason="no public vocabulary here")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    e = tokenizer.encoder(tokenizer.vocabulary())
    return e, tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=e.ranks, special_tokens={})


TEXTS = ["", " ", "hello world", "<|endoftext|>", "Привет, мир!", "a\r\n\tb  c", "🙂🙂 \u200b\u0301", "x" * 2000, "def f(x):\n    return x_1 + 'ü'\n" * 50, "ab" * 400 + "é" * 300]


@pytest.mark.parametrize("text", TEXTS)
def test_ids(reference, text):
    e, t = reference
    assert e.encode(text) == t.encode_ordinary(text)
    assert t.decode(e.encode(text)) == text


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_round_trip(text):
    e = tokenizer.encoder(tokenizer.vocabulary())
    inverse = {i: b for b, i in e.ranks.items()}
    assert b"".join(inverse[i] for i in e.encode(text)) == text.encode("utf-8", "surrogatepass")


def test_long_words_merge_alike():
    e = tokenizer.encoder(tokenizer.vocabulary())
    rng = random.Random(2)
    for _ in range(20):
        word = bytes(rng.choice(b"abcdefgh \xd0\xb0") for _ in range(rng.randint(2, 200)))
        assert e.merge_long(word) == e.merge(word) or word in e.ranks


def test_encode_corpus(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 8), (3, "hi", 9), (3, "hi", 9)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in tokenizer.encode_corpus(df).collect())
    assert got[0] == (1, []) and got[1] == (2, []) and got[2] == got[3] and len(got[3][1]) == 1
    assert {r.doc_id: r.n_tokens for r in tokenizer.token_counts(df, ["doc_id"]).collect()} == {1: 0, 2: 0, 3: 1}
    assert tokenizer.encode_corpus(df.limit(0)).count() == 0


def brute(docs, n=shared_spans.MIN_SPAN):
    grams = {k: {t[i : i + n] for i in range(len(t) - n + 1)} for k, t in docs.items() if t}
    return {(a, b) for a in grams for b in grams if a < b and grams[a] & grams[b]}


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    boiler, docs = text(60), {}
    for i in range(60):
        docs[i] = text(rng.randint(20, 120))
    for i in range(60, 75):
        docs[i] = text(30) + boiler + text(30)
    for i in range(75, 110):
        base, n = docs[rng.randrange(60)], rng.choice([150, 199, 200, 201, 230, 400])
        at = rng.randrange(max(1, len(base) - n))
        docs[i] = text(20) + "§" + base[at : at + n] + "ё" + text(20)
    docs |= {110: docs[3], 111: docs[3], 112: None, 113: "", 114: "a" * 900, 115: "a" * 500, 116: "short", 117: "=" * 199, 118: "=" * 199}
    return docs


def test_shared_spans_against_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(k, t, 1) for k, t in docs.items()] + [(3, docs[3], 2)], "doc_id bigint, text string, tid int")
    s = shared_spans.SharedSpans(df)
    got = {(r.doc_id_a, r.doc_id_b) for r in s.document_pairs().collect()}
    assert got == brute(docs)
    part = {r.doc_id: r for r in s.portions().collect()}
    assert len(part) == len(docs)
    for k, t in docs.items():
        mask = bytearray(len(t or ""))
        for j, u in docs.items():
            if j != k and t and u:
                grams = {u[i : i + 200] for i in range(len(u) - 199)}
                for i in range(len(t) - 199):
                    if t[i : i + 200] in grams:
                        mask[i : i + 200] = b"\1" * 200
        assert part[k].shared_chars == sum(mask), k
    assert part[110].class_id == 3 and part[110].copies == 3


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(shared_spans, "PIECE", 700)
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    assert [len(c) for _, c in shared_spans.pieces("x" * 899, 200)] == [899] and [len(c) for _, c in shared_spans.pieces("x" * 900, 200)] == [899, 200]
    docs = [(1, text)] + [(k, "y" * k + text[at : at + 200] + "x" * 50) for k, at in enumerate((0, 501, 690, 1399, 4800), 2)]
    import pyarrow as pa

    chunk = shared_spans._first_chunks(200)
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in docs]), pa.array([t for _, t in docs])], ["cid", "text"])
    rows = [t for b in chunk([batch]) for t in zip(*(c.to_pylist() for c in b.columns))]
    mine = {d for c, d in rows if c == 1}
    for k, _ in docs[1:]:
        assert mine & {d for c, d in rows if c == k}, k


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(40, 400), st.sampled_from(["ab", "abcdefgh ", "aaaaaaab", "a"]))
def test_every_common_span_holds_a_common_chunk(seed, span, alphabet):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    common, found = text(span), []
    for _ in range(2):
        before = text(rng.randint(0, 300))
        whole = before + common + text(rng.randint(0, 300))
        for reach in {shared_spans.reach_of(span), min(shared_spans.FINE, shared_spans.reach_of(span))}:
            h = shared_spans.Stretch([(1, 0, shared_spans._codes("abc" * 90)), (2, 0, shared_spans._codes(whole)), (3, 0, shared_spans._codes(common))], span)
            a, b = h.chunks(reach, shared_spans.least_of(span, reach))
            at = 270 + span
            a, b = a - at, b - at
            inside = (a >= len(before)) & (b <= len(before) + span)
            found.append((reach, {whole[i:j] for i, j in zip(a[inside], b[inside])}))
            assert at + len(before) in h.candidates(a + at, b + at, inside, span, reach)
    for reach in {r for r, _ in found}:
        x, y = (c for r, c in found if r == reach)
        assert x & y


@pytest.mark.parametrize("span", [60, 500])
def test_other_lengths(spark, span):
    docs = corpus()
    s = shared_spans.SharedSpans(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), span=span)
    assert {(r.doc_id_a, r.doc_id_b) for r in s.document_pairs().collect()} == brute(docs, span)
    with pytest.raises(ValueError):
        shared_spans.SharedSpans(s.rows, span=10)


def test_boilerplate_makes_no_pairs_in_portions(spark):
    """A passage in 20 000 texts: 2 * 10^8 pairs, but portions take a row a text."""
    head = "".join(random.Random(1).choice("abcdefghij klm") for _ in range(260))
    s = shared_spans.SharedSpans(spark.range(20_000).selectExpr("id doc_id", f"concat('{head}', sha2(cast(id as string), 256), '{head[:230]}', id) text"))
    assert s.classes.groupBy("class").count().agg({"count": "max"}).first()[0] == 20_000
    rows = s.portions().selectExpr("min(shared_chars) lo", "max(shared_chars) hi", "count(*) n", "min(links) links").first()
    assert rows.n == 20_000 and rows.lo >= 490 and rows.hi < 560 and rows.links >= 19_999


def test_empty_corpus(spark):
    s = shared_spans.SharedSpans(spark.createDataFrame([], "doc_id bigint, text string"))
    assert s.document_pairs().count() == 0 and s.portions().count() == 0
