"""Personal data: base spans against plain patterns, estimation and classifier on planted votes, whole texts."""

import math
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import pii

ROW = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("found", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("n", T.LongType())])


def luhn(value):
    figures = [int(c) for c in reversed(value) if c.isdigit()]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(figures)) % 10 == 0


def figures(value):
    return sum(c.isdigit() for c in value)


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= figures(v) <= 19 and luhn(v)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= figures(v) <= 15),
}


def plain(text):
    out = [(m.start(), i, m.end(), k) for i, (k, (p, ok)) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if ok(m[0])]
    return [(k, s, e) for s, _, e, k in sorted(out)]


def spans(spark, texts):
    df = spark.createDataFrame([(i, t, 1, "k", None) for i, t in texts], ROW).repartition(3)
    return [(r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in pii.find(df).collect()]


def base_of(found):
    return [s for s in found if s[0] in pii.BASE]


CARD = "4539 1488 0343 6467"
CASES = [
    "", None, "a@b", "a@b.c", "a@b.c@d.e", "x@y.zz+more@host.org", ".@a.b", "a@b.c.d-e..f@g.h", "é@b.co ä.b@c.de",
    "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.002.3.255", "1.2.3.0000256", "1..2.3.4", "12.34.56.78x9.9.9.9",
    f"{CARD}", "4539148803436467", "4539148803436468", "5 4539148803436467", f"12-{CARD}", "4539-1488-0343-6467 ", "1" * 40, "0" * 14, "0" * 19, "0" * 20, "0 " * 16,
    "+1 (476) 555-6291", "+1234567890", "+12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "++49 30 1234567 ((", "+49-30-1234567-", "+1.2.3.4.5.6.7.8.9.0",
    "￿ a@b.co ￾ 10.0.0.1", "漢字 a@b.co 😀 +1 (476) 555-6291 😀 10.0.0.1",
]


def test_base_spans(spark):
    texts = list(enumerate(CASES))
    got = dict(spans(spark, texts))
    assert {i: base_of(got[i]) for i, _ in texts} == {i: plain(t) for i, t in texts}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a0159@.+-( )%é\n", max_size=60), min_size=30, max_size=60))
def test_base_spans_of_any_text(spark, texts):
    rows = list(enumerate(texts))
    got = dict(spans(spark, rows))
    assert {i: base_of(got[i]) for i, _ in rows} == {i: plain(t) for i, t in rows}


def test_very_long_texts(spark):
    """Runs of a million characters that begin a match and do not end it, and thousands of matches in one text."""
    runs = ["a" * 1_000_000, "1" * 1_000_000, "a@" + "b" * 1_000_000, "a@b" + ".c" * 300_000, "1." * 400_000, "1 " * 400_000, "+1" + " " * 1_000_000, "+1" * 300_000, "+1" + "(2)" * 200_000]
    many = " ".join(f"user{i}@host{i % 7}.org tel +1 (476) 555-{i:04d} at 10.0.{i % 300}.1" for i in range(5000))
    texts = list(enumerate([*runs, many]))
    got = dict(spans(spark, texts))
    assert base_of(got[len(runs)]) == plain(many)
    assert len(base_of(got[len(runs)])) > 13_000
    want = {3: [("email", 0, len(runs[3]))], 4: [("ip", 8 * k, 8 * k + 7) for k in range(100_000)]}
    assert {i: base_of(got[i]) for i in range(len(runs))} == {i: want.get(i, []) for i in range(len(runs))}


def test_rows_stay_apart(spark):
    rows = [(None, "a@b.co"), (None, None), (3, "a@b.co"), (3, "a@b.co"), (3, "")]
    got = spans(spark, rows)
    assert sorted(got, key=repr) == sorted([(None, [("email", 0, 6)]), (None, []), (3, [("email", 0, 6)]), (3, [("email", 0, 6)]), (3, [])], key=repr)
    assert spans(spark, []) == []


def letters(n):
    """Texts with base spans, look-alikes, and further kinds with and without words that speak for them."""
    rng = random.Random(9)
    figure = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    out = []
    for i in range(n):
        kind = i % 8
        good = {
            0: f"Please write an email to user{i}@mail.example.com soon",
            1: f"my card is {CARD}, thanks",
            2: f"call me, my phone: +1 (476) 555-{figure(4)}",
            3: f"The order {figure(16)} was sent",
            4: f"see version 300.{rng.randrange(260, 900)}.4.5 of the tool",
            5: f"server address 10.0.{rng.randrange(255)}.7",
            6: f"11 22 33 44 55 66 {figure(15)} 77 88 99 00 11 22",
            7: "nothing at all in this text",
        }[kind]
        out.append((i, good))
    return out


def test_added_spans_follow_the_votes(spark):
    text = "Social security number 219-09-9999. IBAN: DE89 3704 0044 0532 0130 00 of my bank. I was born 12.03.1984 in Bonn. My phone is (415) 555-2671, ok. Dear Mr. Smith, I live at 12 Baker Street. Mail joe (at) gmail (dot) com"
    plain_text = "ISBN 219-09-0000, on 12.03.1984 order 415-155-2671 and DE89 3704 0044 0532 0130 01 left."
    rows = [*letters(400), (9000, text), (9001, plain_text)]
    got = dict(spans(spark, rows))
    assert [text[s:e] for k, s, e in got[9000]] == ["219-09-9999", "DE89 3704 0044 0532 0130 00", "12.03.1984", "(415) 555-2671", "Mr. Smith", "12 Baker Street", "joe (at) gmail (dot) com"]
    assert [k for k, _, _ in got[9000]] == ["ssn", "iban", "born", "tel", "name", "street", "mail"]
    assert got[9001] == []
    assert all(got[i] == plain(t) for i, t in letters(400))


def test_estimation_finds_reliabilities():
    """Three labelers of known accuracy on planted truth."""
    rng = random.Random(2)
    names = len(pii.LABELERS)
    truth, counts = {}, {}
    accuracy = [0.95, 0.8, 0.7]
    for _ in range(20_000):
        y = rng.random() < 0.4
        v = tuple([(1 if (y == (rng.random() < a)) else -1) for a in accuracy] + [0] * (names - 3))
        counts[v] = counts.get(v, 0) + 1
        truth[v] = truth.get(v, 0) + y
    rows = [("tel", v, n) for v, n in sorted(counts.items())]
    q, reliability = pii.estimate(rows)
    for k, a in enumerate(accuracy):
        assert abs(reliability[pii.LABELERS[k]][1][2] - a) < 0.05
        assert abs(reliability[pii.LABELERS[k]][0][0] - a) < 0.05
    for (_, v, n), p in zip(rows, q, strict=True):
        if n > 300:
            assert abs(p - truth[v] / n) < 0.08


def test_classifier_matches_its_expression(spark):
    shape = {"size": 1, "left": 0, "right": 0}
    rows = []
    for k, (form, before, n) in enumerate([(1, 1, 900), (1, 0, 500), (-1, 0, 700), (-1, 1, 40), (0, 1, 30)]):
        votes = dict.fromkeys(pii.LABELERS, 0) | {"form": form, "before": before, "gazetteer": 1 if k == 2 else 0}
        rows.append({"kind": "tel", "n": n} | votes | shape)
    model = pii.train(rows)
    schema = ", ".join(["kind string", *[f"{c} int" for c in (*pii.LABELERS, *pii.SHAPE)]])
    df = spark.createDataFrame([tuple(r[c] for c in ("kind", *pii.LABELERS, *pii.SHAPE)) for r in rows], schema)
    got = df.withColumn("c", F.struct(*df.columns)).select(F.expr(model.score("c")).alias("p"), *df.columns).collect()
    for r in got:
        total = model.weights["bias"] + sum(model.weights.get(f"{c}={r[c]}", 0.0) for c in ("kind", *pii.LABELERS, *pii.SHAPE))
        want = 1 / (1 + math.exp(-total)) if max(r[c] for c in pii.LABELERS) > 0 else 0.0
        assert abs(r["p"] - want) < 1e-12
    by = {(r["form"], r["before"]): r["p"] for r in got}
    assert by[1, 1] > 0.9 > by[-1, 0]


def test_model_of_nothing():
    assert pii.train([]).weights == {"bias": -math.inf}


@pytest.mark.parametrize("value", ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "FR14 2004 1010 0505 0001 3M02 606"])
def test_account_numbers(spark, value):
    rows = [(value,), (value[:-1] + ("1" if value[-1] != "1" else "2"),)]
    got = spark.createDataFrame(rows, "v string").select(F.expr(pii.well_formed("iban", "v")).alias("ok")).collect()
    assert [r["ok"] for r in got] == [True, False]
