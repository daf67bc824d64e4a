"""Pair defects, personal data and mixing."""

import random

import numpy as np
import pytest

from quarryline.llm import mixing, pair_defects, personal


@pytest.fixture(scope="module")
def field():
    return pair_defects.trained_field()


Q = "How can I change the index of `TableReader` without breaking the cache?"
SOUND = "Open the pool with `open_pool` first and then read the table. The worker keeps each row until the lock is free."
CASES = [
    (Q, None, "empty"), (Q, "", "empty"), (Q, " \u00a0\u200b\t", "empty"), (Q, "n/a", "empty"), (Q, "<empty>", "empty"), (Q, "```\n```", "empty"), (Q, "—", "empty"), (Q, "...", "empty"),
    (Q, "I'm sorry, but I can't help with that.", "refusal"), (Q, "That request is outside of what I may discuss. Please rephrase your question.", "refusal"), (Q, "Thanks for asking about `x_y`. Unfortunately, I am unable to provide this information.", "refusal"),
    ("Где хранится журнал?", "К сожалению, у меня нет доступа к журналу, поэтому ответить не получится.", "refusal"), ("Wo liegt die Tabelle?", "Dazu darf ich keine Auskunft geben.", "refusal"), ("¿Dónde está la tabla?", "Lo siento, no puedo ayudar con eso.", "refusal"),
    (Q, Q, "copy"), (Q, Q.upper(), "copy"), (Q, "> " + Q, "copy"), (Q, f"Question: {Q}", "copy"), (Q, Q + "\n" + Q, "copy"),
    (Q, "Сначала откройте пул и прочитайте таблицу. Обработчик хранит каждую строку, пока замок не свободен.", "language"),
    ("Объясни, как работает кэш.", SOUND, "language"), ("Wie kann ich den Index der Tabelle ändern?", SOUND, "language"),
    (Q, SOUND + " Without the lock the read", "truncated"), (Q, SOUND + "\n```python\nx = [1, 2", "truncated"), (Q, SOUND + "\n1. First the table is read.\n2. Then the", "truncated"), (Q, SOUND[:-1] + ",", "truncated"),
    (Q, SOUND, None), (Q, "`pool/open_pool.py`", None), (Q, "```python\nx = 1\n```", None), (Q, "Sorry for the wait. " + SOUND, None), (Q, SOUND + "\n\nSources: pool/read_rows.py", None),
    ("Объясни, как работает кэш. Ответь на английском.", SOUND, None), (Q, 'The bot answers "I am unable to help" when `open_pool` has no row, that is by design. ' + SOUND, None), (Q, "You cannot call `open_pool` before the lock is free. " + SOUND, None),
    (None, SOUND, None), ("", "I cannot answer this question.", "refusal"),
]


@pytest.mark.parametrize(("question", "answer", "want"), CASES)
def test_defects(field, question, answer, want):
    assert pair_defects.defect(field, question, answer) == want


def test_held_out_accuracy(field):
    right = total = 0
    for q, a, y in pair_defects.training_pairs(200, seed=77):
        got = field.tag(pair_defects.featurize(q, a)[1])
        right += int((got == np.array(y)).sum())
        total += len(y)
    assert right / total > 0.97


def test_viterbi_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    f = pair_defects.Field(rng.normal(size=(len(pair_defects.FEATURES), 5)), rng.normal(size=(5, 5)))
    x = (rng.random((4, len(pair_defects.FEATURES))) < 0.3).astype(float)
    s = x @ f.states
    best = max(product(range(5), repeat=4), key=lambda y: sum(s[t, y[t]] for t in range(4)) + sum(f.moves[y[t], y[t + 1]] for t in range(3)))
    assert tuple(f.tag(x)) == best


def test_defects_of_a_table(spark):
    rows = [(1, Q, None, "x"), (1, Q, None, "x"), (2, Q, SOUND * 2000, "y"), (3, None, None, None), (4, Q, Q, "z")]
    df = spark.createDataFrame(rows, "id bigint, question string, answer string, q string")
    assert {(r.id, r.defect) for r in pair_defects.pair_defects(df).collect()} == {(1, "empty"), (3, "empty"), (4, "copy")}
    assert pair_defects.pair_defects(df.limit(0)).count() == 0


FINDER = personal.Finder(["Petra", "Hugo", "Марина"])
FOUND = [
    ("mail to a.b+c@x.example please", {"email"}), ("mail a (at) x (dot) example", {"email"}), ("git@git.x.example:core/a.git", set()), ("Decorator @app.get fails", set()), ("@core/a@1.2.3 here", set()),
    ("postgres://svc:pw@db.x.example/a", set()), ("Call +34 600 000 240.", {"phone"}), ("Мой номер 8 000 107 00 69, если", {"phone"}), ("tel (555) 555-0148", {"phone"}), ("555-0166 ext. 58", {"phone"}), ("020 7946 0600", {"phone"}),
    ("It runs on 10.249.72.12:3414.", set()), ("Offset 710.392.5855.3 in", set()), ("See ticket INC-8442-9287515.", set()), ("Order 2025-3587-862510 is", set()), ("Commit 42d084068b18, build 605739171.", set()), ("Started 2025-12-08T04:37:05.355404.", set()),
    ("SSN 000-30-9313", {"id_number"}), ("паспорт серия 0047 номер 242552", {"id_number"}), ("СНИЛС 000-133-836 13", {"id_number"}), ("DNI 00084683A", {"id_number"}), ("national id 0044561636", {"id_number"}), ("NI number QQ 00 45 01 C", {"id_number"}),
    ("at 804 W. Larkspur St., Apt 46", {"address"}), ("ул. Осиновая, д. 10, кв. 82", {"address"}), ("Töpfergasse 35, 00473", {"address"}), ("Avenida de los Tilos 54, 1º", {"address"}), ("1687 holloway avenue, x", {"address"}), ("4 lanes, street map layer 76, road tile cache.", set()),
    ("Thanks,\nPetra Halfeather", {"name"}), ("hugo strandashe wrote", {"name"}), ("— D. Strandashe", {"name"}), ("Вязунов, Марина просит", {"name"}), ("The Archive Column and the Swapped Marker disagree.", set()), ("", set()), (None, set()), ("   ", set()),
]


@pytest.mark.parametrize(("text", "want"), FOUND)
def test_personal(text, want):
    assert {k for _, _, k in FINDER.find(text)} == want


def test_pseudonyms():
    p = personal.Pseudonyms(b"key")
    assert {p.permute(v, 7, 11, "t") for v in range(77)} == set(range(77))
    assert len({p.within(f"{n:03d}", "t", lambda _: True) for n in range(1000)}) == 1000
    a, b = p.of("+34 600 000 240", "phone"), p.of("+34 600 000 241", "phone")
    assert a != b and a == p.of("+34 600 000 240", "phone") and [c.isdigit() for c in a] == [c.isdigit() for c in "+34 600 000 240"]
    new = p.of("12345678Z", "id_number")
    assert new[-1] == "TRWAGMYFPDXBNJZSQVHLCKE"[int(new[:8]) % 23]
    assert p.day("2001-02-03") != "2001-02-03" and p.day("03.02.2001").count(".") == 2
    text = "Write to a@x.example or call 555-0166 ext. 58, a@x.example!"
    masked = personal.mask(text, FINDER.find(text), p)
    assert masked.startswith("Write to <EMAIL ") and masked.count(p.code("a@x.example", "email")) == 2 and masked.endswith(">!")
    assert personal.mask(None, [], p) is None


DIGITS = lambda text: "".join(c for c in text if c.isdigit())


@pytest.mark.parametrize(
    "spellings",
    [
        ["+34 600 000 240", "+34-600-000-240", "+34600000240", "+34 (600) 000240", "0034 600 000 240"],
        ["+7 912 345 67 89", "8 912 345 67 89", "8(912)345-67-89", "+79123456789"],
        ["(212) 555-0148", "212-555-0148", "212.555.0148"],
        ["+1 212 555 0148", "+1-212-555-0148", "001 212 555 0148"],
        ["+380 44 123 4567", "+380441234567"],
    ],
)
def test_spellings_of_a_phone_are_linked(spellings):
    p = personal.Pseudonyms(b"key")
    out = [p.of(x, "phone") for x in spellings]
    national = lambda x: DIGITS(x)[personal.phone_code(x, DIGITS(x))[1] :]
    assert len({national(x) for x in out}) == 1 and national(out[0]) != national(spellings[0])
    assert len({personal.phone_code(x, DIGITS(x))[0] for x in out + spellings}) == 1
    assert [[c.isdigit() or c for c in x] for x in out] == [[c.isdigit() or c for c in x] for x in spellings]


@pytest.mark.parametrize("number", ["123-45-6789", "112-233-445 95", "500100732259", "AB123456C", "12345678Z", "X1234567L"])
def test_valid_numbers_stay_valid_and_others_stay_apart(number):
    p = personal.Pseudonyms(b"key")

    def valid(text):
        _, plain = personal.canonical(text)
        _, body, complete, plausible = personal.id_check(plain)
        return complete(plain[:body]) == plain and plausible(plain)

    assert valid(number)
    new = p.of(number, "id_number")
    assert new != number and valid(new) and p.of(number.replace("-", " "), "id_number").replace(" ", "-") == new.replace(" ", "-")
    places, plain = personal.canonical(number)
    for wrong in ("000-00-0000", personal.laid_out(number, places, plain[:-1] + ("7" if plain[-1] != "7" else "8") if plain[-1].isdigit() else plain[:-1] + "A")):
        if personal.id_check(personal.canonical(wrong)[1]) and not valid(wrong):
            assert not valid(p.of(wrong, "id_number"))


def test_pseudonyms_are_one_to_one():
    p = personal.Pseudonyms(b"key")
    kept = [f"{a:03d}-{g:02d}-0001" for a in range(100, 140) for g in range(1, 60)]
    assert len({p.of(x, "id_number") for x in kept}) == len(kept)
    phones = [f"+49 30 {n:06d}" for n in range(3000)]
    assert len({p.of(x, "phone") for x in phones}) == len(phones)
    assert len(p.of("Petra Halfeather", "name")) == 32 and p.of("Petra Halfeather", "name") == p.of("petra  halfeather", "name")


def test_names_without_a_list():
    f = personal.Finder([])
    for text in ("My name is Petra Halfeather.", "Ich heiße Petra Halfeather", "Меня зовут Фёкла Вязунова.", "Ask Mrs. Petra Halfeather please", "Me llamo Ana Roble"):
        assert [k for _, _, k in f.find(text)] == ["name"], text
    assert f.find("My name is Config.Loader") == f.find("The Archive Column disagrees") == []


def test_more_names_than_a_task_takes(spark):
    users = spark.createDataFrame([(f"Name{n}",) for n in range(30)] + [("Petra",), ("Hugo",)], "first_name string")
    rows = spark.createDataFrame([(1, "Thanks, Petra Halfeather"), (2, "hugo strandashe wrote"), (3, "Nora Ashfield"), (4, None), (1, "Thanks, Petra Halfeather")], "id bigint, t string")
    few, many = personal.known_first_names(users, 100), personal.known_first_names(users, 10)
    assert isinstance(few, list) and not isinstance(many, list)
    got = [sorted(map(tuple, personal.personal_kinds(rows, "id", "t", x).collect())) for x in (few, many)]
    assert got[0] == got[1] == [(1, "name"), (2, "name")]
    texts = [sorted(map(tuple, personal.masked_texts(rows, "id", "t", x, b"k").collect()), key=str) for x in (few, many)]
    assert texts[0] == texts[1] and len(texts[0]) == 4


@pytest.mark.parametrize("name", [n for n, (_, signs) in pair_defects._TESTS.items() if signs])
def test_gates_hold_for_every_match(name):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    pattern, signs = pair_defects._TESTS[name]

    @settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(pattern))
    def check(text):
        m = pattern.search(text)
        assert any(x in m.group().casefold() for x in signs), m.group()

    check()


def test_personal_of_a_table(spark):
    long = "x " * 200_000 + "mail a@x.example"
    df = spark.createDataFrame([(1, long, "k"), (2, None, "k"), (2, None, "k"), (3, "no", "k")], "id bigint, question string, kind string")
    assert [tuple(r) for r in personal.personal_kinds(df, "id", "question", []).collect()] == [(1, "email")]
    assert personal.masked_texts(df, "id", "question", [], b"k").count() == 3
    users = spark.createDataFrame([("Petra",), (" ",), (None,), ("Petra",)], "first_name string")
    assert personal.known_first_names(users) == ["Petra"]


def _documents(spark):
    rng = random.Random(4)
    make = {"readme": lambda: "# Title\n\n" + "word " * rng.randint(30, 60), "issue": lambda: "Steps:\n1. open\n2. read\n" + "text " * rng.randint(10, 30), "commit_msg": lambda: "fix: " + "a " * 6}
    rows = []
    for n in range(600):
        s = "readme" if n < 350 else "issue" if n < 560 else "commit_msg"
        label = None if n % 40 == 0 else s.upper() + " " if n % 7 == 0 else s.replace("_", "-")
        rows.append((n, make[s](), label, "p"))
    rows += [(1000, None, "readme", None), (1001, "", "issue", None), (5, rows[5][1], rows[5][2], "p")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, p string")


def test_mixture(spark):
    targets = spark.createDataFrame([("readme", 0.5, 1), ("issue", 0.3, 2), ("commit_msg", 0.1, 4), ("wiki", 0.1, 3)], "source string, target_share double, max_repeats int")
    m = mixing.Mixture(_documents(spark), targets)
    got = {r.source: r for r in m.shares().collect()}
    assert abs(got["readme"].reached_share - 0.5 / 0.9) < 0.03 and abs(got["issue"].reached_share - 0.3 / 0.9) < 0.03 and got["wiki"].reached_share == 0
    assert all(r.most_repeats <= r.max_repeats for r in got.values())
    rows = m.mixture().collect()
    assert len({r.doc_id for r in rows}) == len(rows) and not {1000, 1001} & {r.doc_id for r in rows}


def test_mixture_of_nothing(spark):
    targets = spark.createDataFrame([("readme", 1.0, 1)], "source string, target_share double, max_repeats int")
    m = mixing.Mixture(_documents(spark).limit(0), targets)
    assert m.mixture().count() == 0 and [r.reached_share for r in m.shares().collect()] == [0.0]
    assert mixing.Mixture(_documents(spark), targets.limit(0)).mixture().count() == 0


def test_rounding_is_the_same_for_any_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 3)), int(rng.lognormal(4, 1.5)) + 1, float(rng.choice([0.04, 0.37, 1.6, 2.0]))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, s int, n_tokens bigint, rate double")
    goal = np.array([sum(t * r for _, k, t, r in rows if k == s) for s in range(3)])
    got = [{(r.doc_id, r.repeats) for r in mixing.whole_repeats(df.repartition(n), goal, np.array([3.0, 3.0, 2.0])).collect()} for n in (1, 64, 512)]
    assert got[0] == got[1] == got[2] and all(0 <= n <= (3, 3, 2)[rows[i][1]] for i, n in got[0])
    for s in range(3):
        reached = sum(rows[i][2] * n for i, n in got[0] if rows[i][1] == s)
        assert abs(reached - goal[s]) <= 2e-3 * goal.sum()


def test_rounding_of_few_long_documents(spark):
    """A rate of a fiftieth of a few documents, the longest far above the goal."""
    sizes = [50_000, 20_000, 9_000, 4_000] + [600 + 7 * i for i in range(96)]
    df = spark.createDataFrame([(i, 0, t, 0.02) for i, t in enumerate(sizes)] + [(1000 + i, 1, 100, 1.0) for i in range(500)], "doc_id bigint, s int, n_tokens bigint, rate double")
    goal = np.array([0.02 * sum(sizes), 50_000.0])
    rows = mixing.whole_repeats(df, goal, np.array([1.0, 1.0])).collect()
    assert abs(sum(r.n_tokens * r.repeats for r in rows if r.s == 0) - goal[0]) <= 600 and sum(r.repeats for r in rows if r.s == 1) == 500


@pytest.mark.parametrize("parts", [1, 64, 512])
def test_shares_for_any_partitions(spark, parts):
    """All of the corpus's sources, rare ones of few long documents included, within a point of their targets."""
    import random

    rng, words = random.Random(2), ["alpha", "beta", "gamma", "delta", "load", "table"]
    rows = []
    for i in range(1500):
        kind = rng.choices(["readme", "issue", "sop_docx", "changelog"], [0.6, 0.3, 0.02, 0.08])[0]
        mark = {"readme": "# Title\n\n", "issue": "Steps to reproduce?\n", "sop_docx": "1. Step\n2. Step\n", "changelog": "## 1.2.3\n- fix: "}[kind]
        n = {"readme": 60, "issue": 40, "sop_docx": 400, "changelog": 30}[kind]
        rows.append((i, mark + " ".join(rng.choice(words) for _ in range(rng.randint(n // 2, n * 2))), kind.upper() if i % 7 else None))
    targets = spark.createDataFrame([("readme", 0.4, 2), ("issue", 0.3, 2), ("sop_docx", 0.2, 4), ("changelog", 0.1, 4)], "source string, target_share double, max_repeats int")
    m = mixing.Mixture(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(parts), targets)
    assert m.converged and m.error <= mixing.TOLERANCE
    assert all(abs(r.reached_share - r.target_share) < 0.01 and r.most_repeats <= r.max_repeats for r in m.shares().collect())
