"""Retrieval for many events against a plain version; joins by grams and by month; resampling."""

import datetime as dt
import math
import random
import re
from collections import Counter


import pytest

from fundtrace.operators import evaluation as ev
from fundtrace.operators import joins as jn
from fundtrace.operators import retrieval as rt


def plain_terms(text):
    words = re.findall(r"\b\w{2,}\b", text.lower())
    return Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))


def plain_search(pieces, question, limit, cutoff, last, max_terms):
    usable = {k: plain_terms(t) for k, (d, t) in pieces.items() if d is not None and d <= last}
    n, own = len(usable) + 1, plain_terms(question)
    total, df = Counter(), Counter()
    for c in usable.values():
        total.update(c)
        df.update(set(c))
    ordered = sorted(total, key=lambda t: (-total[t], t))
    vocabulary = set(ordered[:max_terms])
    worst = ordered[max_terms - 1] if len(ordered) >= max_terms else None
    mine = {t for t in own if worst is None or (-(total[t] + own[t]), t) <= (-total[worst], worst)}
    idf = lambda t: math.log((1 + n) / (1 + df[t] + (t in own))) + 1
    weights = lambda c: {t: f * idf(t) for t, f in c.items() if t in mine or t in vocabulary and t not in own}
    q = weights(own)
    size = lambda w: math.sqrt(sum(x * x for x in w.values()))
    out = []
    for k, c in usable.items():
        if pieces[k][0] <= cutoff:
            w = weights(c)
            dot = sum(x * w.get(t, 0) for t, x in q.items())
            if dot > 0:
                out.append((-round(dot / size(w) / size(q), 9), k))
    return [(k, -s) for s, k in sorted(out)[:limit]]


@pytest.mark.parametrize("few", [500_000, 0])
def test_retrieval_for_many_events(spark, monkeypatch, few):
    monkeypatch.setattr(rt, "BROADCAST_TERMS", few)
    rng = random.Random(4)
    words = ["fund", "rate", "Market", "yield", "é", "über", "stock", "xx", "report", "a", "bond"] + [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choices(words, weights=[9] * 11 + [1] * 30, k=n))
    day = lambda i: dt.date(2000, 1, 1) + dt.timedelta(days=i)
    pieces = {i: (None if i % 13 == 0 else day(rng.randint(0, 300)), text(rng.choice([0, 1, 5, 40]))) for i in range(120)}
    pieces[200] = pieces[201] = pieces[1]  # ties
    asked = {f"e{i}": (day(rng.randint(-20, 250)), text(rng.choice([0, 2, 6]))) for i in range(25)}
    given = spark.createDataFrame([(k, d, t) for k, (d, t) in pieces.items()], "doc_id int, doc_date date, text string")
    questions = spark.createDataFrame([(e, d, q) for e, (d, q) in asked.items()] + [("none", None, "fund")], "event string, at date, q string")
    last = max(d for d, _ in asked.values())
    for max_terms in (16_000, 25):
        got = {}
        for r in rt.retrieve_many(given, ["doc_id"], "text", questions, "event", "q", 7, "doc_date", "at", max_terms).orderBy("event", "place").collect():
            got.setdefault(r.event, []).append((r.doc_id, r.score))
        for e, (d, q) in asked.items():
            want = plain_search(pieces, q, 7, d, last, max_terms)
            assert [k for k, _ in got.get(e, [])] == [k for k, _ in want]
            assert all(abs(a[1] - b[1]) < 1e-8 for a, b in zip(got.get(e, []), want, strict=True))
        assert "none" not in got
    one = rt.retrieve(given.where("doc_date is not null"), ["doc_id"], "text", "fund rate market", 5).collect()
    late = dt.date(2100, 1, 1)
    assert [r.doc_id for r in one] == [k for k, _ in plain_search(pieces, "fund rate market", 5, late, late, 16_000)]


def test_evidence_scope_and_copies(spark):
    docs = spark.createDataFrame([(3, "t", None, "x"), (1, "t", None, "x"), (2, "t", "d", "x"), (4, None, None, "GDP rises"), (5, "Fund", "d", None)], "doc_id int, title string, date string, text string")
    assert sorted(r.doc_id for r in rt.distinct_evidence(docs, "doc_id", "title", "date", "text").collect()) == [1, 2, 4, 5]
    assert [r.doc_id for r in rt.in_scope(docs, "macro_only", "title", "text").collect()] == [4]
    assert [r.doc_id for r in rt.in_scope(docs, "micro_only", "title", "text").collect()] == [5]
    assert rt.in_scope(docs, "macro_and_micro", "title", "text").count() == 5


def test_containment_by_grams(spark):
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("abAB  -.") for _ in range(rng.randint(0, 9)))
    left = [name() for _ in range(80)] + [None, "", "--", "a", "Growth Fund", "the growth fund of a"]
    right = [name() for _ in range(80)] + [None, "growth fund", "b", "a growth  fund inc"]
    clean = lambda s: re.sub("[^a-z0-9]+", " ", s.lower()).strip()
    want = set()
    for a in {x for x in left if x is not None}:
        exact = {b for b in right if b is not None and clean(b) == clean(a)}
        want |= {(a, b, "exact") for b in exact}
        if not exact and clean(a):
            want |= {(a, b, "contains") for b in right if b is not None and clean(b) and (clean(a) in clean(b) or clean(b) in clean(a))}
    out = jn.containment(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), "a", "b")
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_dates_within_intervals(spark):
    rng = random.Random(2)
    day = lambda i: dt.date(1999, 11, 5) + dt.timedelta(days=i)
    spans = [(i, day(a), rng.choice([None, day(a + rng.randint(0, 200))])) for i, a in enumerate(rng.randint(0, 500) for _ in range(60))]
    dates = sorted({day(rng.randint(-30, 600)) for _ in range(40)})
    out = jn.at_dates(spark.createDataFrame(spans, "id int, lo date, hi date"), spark.createDataFrame([(d,) for d in dates], "d date"), "lo", "hi", "d")
    assert sorted(map(tuple, out.select("id", "d").collect())) == sorted((i, d) for i, lo, hi in spans for d in dates if lo < d and (hi is None or d <= hi))


def test_bootstrap_interval_is_that_of_resampling(spark):
    rng = random.Random(6)
    rows = [(i, "ab"[i % 2], rng.gauss(5 if i % 2 else 0, 2)) for i in range(800)] + [(9000, "c", 1.5), (9001, "a", None)]
    out = {r.g: r for r in ev.bootstrap(spark.createDataFrame(rows, "k int, g string, x double"), "k", "x", ["g"], 400).collect()}
    for g in "ab":
        xs = [x for _, h, x in rows if h == g and x is not None]
        means = sorted(sum(rng.choices(xs, k=len(xs))) / len(xs) for _ in range(2000))
        wide = means[1950] - means[50]
        assert abs(out[g].low - means[50]) < 0.25 * wide and abs(out[g].high - means[1950]) < 0.25 * wide and abs(out[g].mean - sum(xs) / len(xs)) < 1e-9
    assert out["c"].low == out["c"].high == 1.5
    again = ev.bootstrap(spark.createDataFrame(rows[::-1], "k int, g string, x double").repartition(3), "k", "x", ["g"], 400)
    assert all(abs(r.low - out[r.g].low) < 1e-9 for r in again.collect())


def test_greedy_groups_against_the_plain_rule(spark, monkeypatch):
    import numpy as np

    from fundtrace.operators import models as md

    monkeypatch.setattr(md, "BLOCK", 16)
    rng = np.random.default_rng(28)
    for dim, spread in ((3, 1.0), (16, 0.15)):
        centres = rng.normal(size=(6, dim))
        vs = [list(map(float, centres[rng.integers(6)] + spread * rng.normal(size=dim) / dim**0.5)) for _ in range(150)]
        vs += [vs[3], vs[3], [2 * x for x in vs[5]], [0.0] * dim, None, [None] * dim, [float("nan")] * dim]
        rows = [(int(k), v) for k, v in zip(rng.permutation(len(vs)), vs, strict=True)]
        leaders, want = [], {}
        for k, v in sorted(rows):
            ok = v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
            near = [q for q, w in leaders if ok and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.92 - 1e-12]
            want[k] = near[0] if near else k
            if not near and ok:
                leaders.append((k, v))
        out = md.greedy_groups(spark.createDataFrame(rows, "k int, v array<double>"), "k", "v")
        assert {r.k: r.leader for r in out.collect()} == want and len(leaders) > 3
    assert md.greedy_groups(spark.createDataFrame([], "k int, v array<double>"), "k", "v").count() == 0


def test_grams_are_counted_where_the_text_is(spark):
    texts = {1: "a bb bb  bb cc", 2: "Bb\nCC bb-cc", 3: "", 4: None, 5: "x y", 6: "one"}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    counted = rt.grams(df, ["id"], "text")
    got = {}
    for r in counted.collect():
        assert (r.id, r.term) not in got
        got[r.id, r.term] = r.tf
    assert got == {(k, t): n for k, text in texts.items() for t, n in plain_terms(text or "").items()}
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()


def test_top_terms_of_units_that_leave_out_rare_ones(spark, monkeypatch):
    """Units that leave out terms still give the exact first terms: those that may lack something, as terms of few units do, are counted again."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(400)], k=60)) for _ in range(300)] + ["once more " * 40] * 3 + ["É x über_1", None, ""]
    given = spark.createDataFrame([(t,) for t in texts], "t string").repartition(6)
    total, df = Counter(), Counter()
    for t in texts:
        total.update(plain_terms(t or ""))
        df.update(set(plain_terms(t or "")))
    for unit, recounted in ((4_000_000, 500_000), (2_000, 500_000), (2_000, 0), (1, 500_000)):
        monkeypatch.setattr(rt, "UNIT_WORDS", unit)
        monkeypatch.setattr(rt, "RECOUNTED", recounted)
        for k in (30, 300, 100_000):
            want = sorted(total, key=lambda t: (-total[t], t))[:k]
            assert [tuple(r) for r in rt._top_terms(given, "t", k).collect()] == [(t, total[t], df[t]) for t in want]


def test_scores_are_not_joined_for_every_event(spark, monkeypatch):
    """No step has a row for each piece and event: a task hands on the best of each event only."""
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    pieces = spark.createDataFrame([(i, days[i % 40], "rate fund") for i in range(800)], "k int, d date, t string")
    asked = spark.createDataFrame([(f"e{i}", days[20 + i % 20], "rate fund") for i in range(60)], "e string, at date, q string")
    monkeypatch.setattr(rt, "TILE", 600)  # several tiles in a task
    sent = []
    inner = rt._nearest
    monkeypatch.setattr(rt, "_nearest", lambda *a: sent.append(inner(*a)) or sent[-1])
    out = rt.retrieve_many(pieces, ["k"], "t", asked, "e", "q", 3, "d", "at").collect()
    assert len(out) == 180 and len(sent) == 1
    assert sent[0].count() <= 60 * 3 * sent[0].rdd.getNumPartitions()
    assert {(r.e, r.place): r.k for r in out if r.e == "e0"} == {("e0", p): k for p, k in zip((1, 2, 3), (0, 1, 2), strict=True)}


def test_dated_managers_are_those_of_events(spark):
    from fundtrace.plans.evaluation import dated_managers
    from fundtrace.plans.registry import Views

    v = Views(spark, "/root/testdata/sf0.01")
    want = {tuple(r) for r in v.fx_events.select("manager", "family", "report_dt").collect()}
    got = [tuple(r) for r in dated_managers(v).collect()]
    assert len(got) == len(set(got)) > 100 and set(got) == want


def test_pieces_carry_columns_of_their_document(spark):
    docs = spark.createDataFrame([(1, "a" * 4000, "x"), (1, "b", "y"), (2, None, "z")], "doc int, t string, day string")
    assert sorted((r.doc, r.day, r.chunk, len(r.text)) for r in rt.chunks(docs, "doc", "t", keep=("day",)).collect()) == [(1, "x", 0, 1800), (1, "x", 1, 1800), (1, "x", 2, 840), (1, "y", 0, 1)]
