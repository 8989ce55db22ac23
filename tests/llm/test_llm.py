"""Operators of the llm subpackage on small inputs: odd rows, and brute-force versions where SQL has none."""

import hashlib
import json
import math
import os
import random
import re
import time
import zlib
from html import unescape

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fundtrace.llm import bpe, centroids, decontaminate, fingerprint, html, infill, licenses, minhash, ngrams, pii, quality, topk, toxicity
from fundtrace.llm.common import row_key, scratch_dir
from fundtrace.llm.graph import connected_components
from fundtrace.llm.registry import ORACLE_SQL, QUERIES
from tests.oracle import assert_same, duck

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word another third " * 20_000


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    assert_same(QUERIES[name](spark, SF).toPandas(), duck(ORACLE_SQL[name], SF))


# 1 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("grams", [100_000, 0])
def test_decontaminate_odd_rows(spark, monkeypatch, grams):
    monkeypatch.setattr(decontaminate, "BROADCAST_GRAMS", grams)  # 0: the way of a large benchmark
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["a", "b", "C", "d", "é", "zz"]) + rng.choice(["", "!", ", "]) for _ in range(n))
    items = pd.DataFrame({"item_id": [5, 10, 7, 9, 11, 12], "text": ["a b c d zz a b c d a b", "ZZ é zz a", "a", "d d d d d d d", "", None]})
    frame = pd.DataFrame({"doc_id": range(64), "text": [text(rng.randint(0, 60)) for _ in range(61)] + [None, "", "x A b-c d zz a b c d a b! q"]})
    for some in (items, items[items.item_id.isin([5, 9])], items[items.item_id > 10]):
        bench = spark.createDataFrame(some, "item_id long, text string").withColumn("words", F.lit("clash"))
        got = decontaminate.benchmark_hits(spark.createDataFrame(frame).withColumn("item", F.lit(1)).withColumn("h", F.lit(2)), bench)
        got = got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
        assert_same(got.toPandas(), duck(decontaminate.ORACLE_SQL, SF, documents=frame, benchmark=some))


def test_decontaminate_empty_and_long(spark):
    none = docs(spark, ["x"]).where("false")
    bench = spark.createDataFrame([(1, "word another third word another third word another third word")], "item_id long, text string")
    assert decontaminate.benchmark_hits(none, bench).count() == 0
    assert decontaminate.benchmark_hits(docs(spark, ["a"]), bench.where("false")).first()["n_hit"] == 0
    assert decontaminate.benchmark_hits(docs(spark, [LONG]), bench).first()["n_hit"] == 59_998
    twice = docs(spark, ["a b", None]).unionAll(docs(spark, ["a b", None]))
    assert decontaminate.benchmark_hits(twice, bench).count() == 2


# 2 ------------------------------------------------------------------------------------------------------------------


def test_quality_statistics_are_finite():
    for t in (None, "", " \n ", "x", "$$$ ###", "\x00", "é" * 5000, LONG, "a\n" * 1000):
        x = quality.statistics(t)
        assert len(x) == len(quality.FEATURES) and np.isfinite(x).all()


def test_quality_model_matches_formula():
    rng = np.random.default_rng(0)
    d = len(quality.FEATURES)
    means = rng.normal(size=(2, d))
    cov = np.stack([np.eye(d) * 2, np.eye(d) + 0.3])
    model = quality.Discriminant(means, np.linalg.cholesky(cov), 0.7)
    x = rng.normal(size=(5, d))
    log = [-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) - 0.5 * np.linalg.slogdet(c)[1] for m, c in zip(means, cov, strict=True)]
    assert np.allclose(model.difference(x), log[1] - log[0] + 0.7)


def test_quality_held_out(spark):
    out = quality.op2_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = out[out.held_out]
    assert ((held.score >= 0.3) == (held.quality == 1)).mean() > 0.95 and out.score.between(0, 1).all()


def test_quality_odd_rows(spark):
    given = docs(spark, ["good words here", None, "", "dup", "dup"]).withColumn("x", F.lit(1)).withColumn("y", F.lit(2))
    labels = spark.createDataFrame([(0, 1), (1, None), (2, 7)], "doc_id long, quality int")
    out = quality.classify(given, labels, "quality", "true").toPandas()
    assert len(out) == 5 and out.score.between(0, 1).all() and not out.held_out.any()
    assert quality.classify(given.where("false"), labels, "quality", "true").count() == 0
    assert quality.classify(given, labels.where("false"), "quality", "true").count() == 5


# 3 ------------------------------------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def fits(kind, m):
        d = re.sub(r"\D", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
            return 16 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0
        return kind != "phone" or 8 <= len(d) <= 15

    return {k: [m.span() for m in re.finditer(p, text) if fits(k, m.group())] for k, p in PLAIN.items()}


def test_pii_base_against_plain_patterns():
    rng = random.Random(5)
    for _ in range(20_000):
        t = "".join(rng.choice("0012345 9.@+-()ab_%é\n") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("4111 1111 1111 1111 x a@b.co +1 (555) 010-9999 10.0.0.255")["card"] == [(0, 19)]
    for t in ("1" * 200_000, "a" * 200_000 + "@", "+5" + "(" * 100_000, "a@" * 50_000, "1." * 100_000):
        pii.base_spans(t)


def test_pii_patterns_find_what_the_base_misses(spark):
    seeds = [f"note {i} please write to mail u{i}@host{i}.example.com now thanks" for i in range(8)]
    texts = [*seeds, "please write to mail lost@localhost now thanks", "nothing 17 here", None, "", "x@y"]
    found = pii.personal_data(docs(spark, texts).withColumn("base", F.lit("clash")).withColumn("row", F.lit(3))).toPandas().set_index("doc_id")
    assert [(s["kind"], texts[8][s["start"] : s["end"]]) for s in found.spans[8]] == [("email", "lost@localhost")]
    assert len(found.base[8]) == 0 and len(found.spans[9]) == 0 and len(found.spans[10]) == 0 and len(found.spans[12]) == 0
    assert all(len(found.spans[i]) == 1 for i in range(8))
    masked = pii.mask(docs(spark, texts), pii.personal_data(docs(spark, texts))).toPandas().set_index("doc_id").text
    assert masked[8] == "please write to mail [EMAIL] now thanks" and masked[10] is None and masked[9] == texts[9]
    assert pii.personal_data(docs(spark, texts).where("false")).count() == 0


def test_pii_spaces_and_chains(spark):
    """Spaced identifiers are candidates as a whole, and what is found teaches patterns that no seed has, to the end."""
    for text, kind, whole in (("ring (741) 555-3069 now", "phone", "(741) 555-3069"), ("ring 030 1234 5678 now", "phone", "030 1234 5678"), ("pay 1234 5678 9012 345 now", "card", "1234 5678 9012 345")):
        assert (kind, whole) in {(m["kind"], m["instance"]) for m in pii.mentions(text, pii.base_spans(text))}
    found, texts = [f"+1 741 555 000{j}" for j in range(8)], []
    for i in range(5):  # each new number stands where eight of the step before do
        new = [f"(741) 555-3{i}0{j}" for j in range(8)]
        texts += [f"ring {'abcdefgh'[i]}{'abcdefgh'[j]} {n} today" for j in range(8) for n in [*found, new[j]]]
        found = new
    out = pii.mask(docs(spark, texts), pii.personal_data(docs(spark, texts))).toPandas()
    assert not out.text.str.contains("555").any() and out.text.str.contains("[PHONE]", regex=False).all()


def test_pii_words_around():
    """Words around a mention are whole, however long or far; those that touch other mentions end there."""
    far, long = " " * 500, "w" * 300
    for text, expected in (
        (f"{long} mail:{far}a@b.co{far}thanks", ([long, "mail:"], "thanks")),
        ("x mail:a@b.co;b@c.de end", (["x", "mail:"], ";")),
        ("a@b.co", ([], "")),
        ("to a@b.co", (["to"], "")),
    ):
        base = pii.base_spans(text)["email"]
        assert next(pii._neighbours(text, base)) == expected
    assert [m["instance"] for m in pii.mentions("z" * 900 + "@b.co", pii.base_spans("z" * 900 + "@b.co"))] == ["z" * 900 + "@b.co"]
    for t in ("1.2.3.4," * 20_000, "a@b.co;" * 20_000, "1-" * 50_000, " 1234 5678" * 20_000):
        pii.mentions(t, pii.base_spans(t))


def test_pii_rounds_against_plain_graph(spark):
    """Scores of the rounds are those of the formulas over dictionaries, on random graphs."""
    rng = random.Random(12)
    for _ in range(3):
        rows = []
        for i in range(60):
            seed = rng.random() < 0.5
            kind = "phone"
            rows.append((i, [{"kind": kind, "start": 0, "end": 1, "instance": f"{'s' if seed else 'c'}{rng.randrange(12)}", "seed": seed, "patterns": [f"p{rng.randrange(5)}" for _ in range(2)]}]))
        edges = {}
        for _, m in rows:
            for p in m[0]["patterns"]:
                edges[p, m[0]["instance"]] = m[0]["seed"]
        edges = {k: v for k, v in edges.items() if sum(p == k[0] for p, _ in edges) >= pii.SUPPORT}
        score = {}
        for _ in range(50):
            known = {(p, i): 1.0 if s else score.get(i, 0.0) for (p, i), s in edges.items()}
            sure = {}
            for p in {p for p, _ in edges}:
                own = [v for (q, _), v in known.items() if q == p]
                if sum(v >= pii.KNOWN for v in own) >= pii.SUPPORT and np.mean(own) >= pii.CONFIDENCE:
                    sure[p] = float(np.mean(own))
            new = {}
            for (p, i), s in edges.items():
                if not s and p in sure:
                    new[i] = new.get(i, 1.0) * max(1 - sure[p], 1e-9)
            new = {i: round(1 - v, 6) for i, v in new.items()}
            if new == score:
                break
            score = new
        expected = {(r, max(sure[p] for p in m[0]["patterns"] if p in sure)) for r, m in rows if not m[0]["seed"] and any(p in sure for p in m[0]["patterns"])}
        got = {(r["row"], r["score"]) for r in pii.discover(spark.createDataFrame(rows, f"row long, mentions array<{pii.MENTION}>")).collect()}
        assert {r for r, _ in got} == {r for r, _ in expected} and np.allclose(sorted(s for _, s in got), sorted(s for _, s in expected), atol=1e-5)


def test_pii_query(spark):
    out = pii.op3_pii(spark, SF).toPandas()
    text = table(spark, "documents").toPandas().set_index("doc_id").text
    for r in out.itertuples():
        spans = [f"{k}:{s}:{e}" for k, v in plain_spans(text[r.doc_id]).items() for s, e in v]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r.spans.split(","))


# 4 ------------------------------------------------------------------------------------------------------------------


def test_html_pages(spark):
    out = html.op4_html(spark, "/root/testdata/sf0.01").toPandas().set_index("page_id")
    for page, source in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").toPandas().itertuples(index=False):
        article = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)[1]
        expected = " ".join(unescape(re.sub(r"<[^>]*>", " ", re.sub("</?b>", "", article))).split())
        assert out.text[page] == expected and out.n_chars[page] == len(expected)


P = "A long sentence, with commas, and enough words in it that it counts as a paragraph of the story."


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &lt;text&gt; &amp; more", "plain <text> & more"),
        (f"<div id=w><header>H</header><div class=post><h2>T</h2><p>{P}</p><p>{P}</p></div><div class='comments'><p>{P}</p></div><footer>f</footer></div>", f"T {P} {P}"),
        (f"<article><p>{P}<p>x<b>y</b>z<aside>q</aside></article><section id=comments><p>{P}", f"{P} xyz"),
        (f"<script>var a='<p>no</p>'</script><article>{P}<!-- hidden --></article>", P),
        ("<article><p>one&nbsp; two\n three<br>four</article>", "one two three four"),
        (f"<div><a href=x>l1</a> <a href=y>l2</a></div><div>{P}</div>", P),
        ("<div>" * 3000 + "deep", "deep"),
        ("<p", ""),
        (f"<article><p title='hidden costs'>{P}</p><p data-role='share'>{P}</p><p>see <a href='/page?id=menu'>this</a></p></article>", f"{P} {P} see this"),
        (f"<div class='content has-sidebar'><p>{P}</p><p>{P}</p></div><div class=sidebar>side</div>", f"{P} {P}"),
        (f"<div class=banner-page><p>{P}</p><p>{P}</p></div><div class=promo>buy</div>", f"{P} {P}"),
        (f"<div class=comments><p>{P}</p><p>{P}</p><p>{P}</p></div><div><p>short story, it is</p></div>", "short story, it is"),
        (f"<header>site</header><article><header><h1>Title</h1></header><p>{P}</p></article>", f"Title {P}"),
        (f"<div hidden>{P}</div><div STYLE='display: NONE'>{P}</div><div><p>seen, all of it</p></div>", "seen, all of it"),
    ],
)
def test_html_cases(source, text):
    assert html.extract(source) == text


@pytest.mark.parametrize("n", [1, 5, 40])
def test_html_keeps_whole_articles(n):
    """Headings, lists, quotes, tables, bare text and small sections stay, however long the page is."""
    beside = "<h1>Head</h1>bare <i>text</i>s<ul><li>item</ul><blockquote>said</blockquote><table><tr><td>cell</table>"
    body, small = f"<div class=body>{f'<p>{P}</p>' * n}</div>", "<section><h2>Small</h2><p>part</p></section>"
    said = " ".join(["Head bare texts item said cell", *[P] * n, "Small part"])
    menu = "<div><a href=a>one</a> <a href=b>two</a></div>"
    for tag in ("article", "main", "div"):
        assert html.extract(f"{menu}<{tag}>{beside}{body}{small}</{tag}>") == said
    assert html.extract(f"{menu}{beside}{body}") == said.removesuffix(" Small part")


def test_html_scores_by_plain_sums():
    """The best container, on pages without an article, has the highest discounted sum over all blocks below it."""
    rng = random.Random(11)
    for _ in range(200):
        sizes = [rng.randint(0, 6) for _ in range(4)]
        parts = [[f"Part {i} line {j}{', and' * rng.randint(0, 3)} {'word ' * rng.randint(1, 60)}".strip() for j in range(n)] for i, n in enumerate(sizes)]
        page = "<div id=top>" + "".join(f"<div class=b{i}>{''.join(f'<p>{t}</p>' for t in p)}<a href=x>{'link ' * 9}</a></div>" for i, p in enumerate(parts)) + "</div>"
        points = []
        for p in parts:
            words, link = sum(map(len, p)), len(("link " * 9).strip())
            own = 1 + min(link / 100, 3)  # the bare link is a block of its own
            points.append((sum(1 + t.count(",") + min(len(t) / 100, 3) for t in p) + own + 5) * (1 - link / (words + link)))
        nodes = html._walk(html.parse(page))
        html.extract(page)
        assert len([n for n in nodes if n.tag == "div"]) == 5
        best = max(range(4), key=lambda i: points[i])
        if sizes[best] and sorted(points)[-1] > sorted(points)[-2] + 1e-9:
            assert all(t in html.extract(page) for t in parts[best])


def test_html_keeps_article_parts_whatever_their_class():
    """Words of a class alone take nothing out of an article; short parts and lists of links go."""
    for tag in ("article", "main"):
        page = f"<{tag}><h1>T</h1><div class='share-prices'><p>{P}</p></div><section class=related-work><h2>Related</h2><p>{P}</p><p>{P}</p></section>" + f"<div class=related><a href=a>one more story of the same kind, and</a> <a href=b>another one of that kind to be read</a></div><div class=share>Share this</div><p>{P} a <label>word</label> here</p></{tag}><div class=promo><p>{P}</p></div>"
        assert html.extract(page) == f"T {P} Related {P} {P} {P} a word here"
    plain = f"<div><p>{P}</p><p>{P}</p><p>{P}</p></div><div class=promotion><p>{P}</p></div>"
    assert html.extract(plain) == f"{P} {P} {P}"


@pytest.mark.parametrize("shape", ["<div></i></b></span>", "<b><p>word ", "<article><header>h</header><i>", "<aside></i><b></x>", "<li><b><td></p>"])
def test_html_takes_time_in_proportion(shape):
    def took(n):
        began = time.process_time()
        html.extract(shape * n)
        return time.process_time() - began

    took(500)
    small, large = min(took(4_000) for _ in range(3)), min(took(16_000) for _ in range(3))
    assert large < 10 * small + 0.2  # four times the page; the square would be sixteen


def test_html_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "clash"), (1, "u", "<p>a", "clash"), (1, "u", "<p>a", "clash")], "page_id long, url string, html string, text string")
    assert sorted(r["text"] for r in html.main_text(pages).collect()) == ["", "a", "a"]
    assert html.main_text(pages.where("false")).count() == 0


# 5 ------------------------------------------------------------------------------------------------------------------


def test_licenses(spark):
    rows = [
        ("a/b/LICENSE", "Released under the MIT License."), ("a/b/c/x", "some code"), ("a/y", "other"), ("a/b/own", "code here\nLicensed under CC BY-NC 4.0."),
        ("top", None), ("a/b/c/x", "some code"), ("a/long", LONG), ("LICENSE", "GNU General Public License, version 3."), ("b/t", "a license that is none of these at all, sorry about it"),
    ]
    files = spark.createDataFrame(rows, "path string, text string").withColumn("license", F.lit("clash"))
    out = licenses.inherit(licenses.scan(files), F.col("path").endswith("LICENSE"))
    got = {(r["path"], r["license"], r["origin"], r["from_dir"]) for r in out.collect()}
    assert out.count() == 9 and got == {
        ("a/b/LICENSE", "MIT", "own", None), ("a/b/c/x", "MIT", "inherited", "a/b"), ("a/y", "GPL-3.0", "inherited", ""), ("a/b/own", "CC-BY-NC-4.0", "own", None),
        ("top", "GPL-3.0", "inherited", ""), ("a/long", "GPL-3.0", "inherited", ""), ("LICENSE", "GPL-3.0", "own", None), ("b/t", "GPL-3.0", "inherited", ""),
    }
    assert licenses.inherit(licenses.scan(files.where("false")), F.lit(True)).count() == 0


def test_licenses_weigh_all_words(spark):
    """Ordinary words weigh little however many files there are: cosines are those of a plain TF-IDF over all terms."""
    line = "This work is licensed under the GNU General Public License, version 3."
    texts = ["this work is the one under review"] * 4000 + ["unlicensed text, a licence of no kind is named here", line, "code\n" + line + "\n" + "this work is the one " * 50]
    files = spark.range(len(texts), numPartitions=4).withColumn("text", F.when(F.col("id") < 4000, texts[0]).when(F.col("id") == 4000, texts[4000]).when(F.col("id") == 4001, texts[4001]).otherwise(texts[4002]))
    got = licenses.scan(files.withColumn("path", F.col("id").cast("string"))).where("license is not null").toPandas().set_index("path")
    terms = lambda t: re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", t.lower())
    df = pd.Series([t for text in texts for t in set(terms(text))]).value_counts()
    weigh = lambda t: {x: (1 + np.log(n)) * (np.log((1 + len(texts)) / (1 + df.get(x, 0))) + 1) for x, n in pd.Series(terms(t)).value_counts().items()}
    a, b = weigh(line), weigh("GNU General Public License, version 3.")
    cosine = sum(a[x] * b.get(x, 0) for x in a) / np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    assert set(got.index) == {"4001", "4002"} and (got.license == "GPL-3.0").all() and list(got.line.sort_index()) == [1, 2] and np.allclose(got.cosine, cosine)


def test_licenses_against_plain_cosines(spark):
    """Own licences of random files, by plain cosines of every line and text with every template."""
    rng = random.Random(13)
    pool = [t for texts in licenses.TEMPLATES.values() for t in texts]
    words = "the code of this file is under a to and version work program any".split()

    def line():
        t = rng.choice(pool).split() if rng.random() < 0.6 else []
        t = [w for w in t if rng.random() > rng.choice((0, 0.1, 0.4))]
        return " ".join([*(rng.choice(words) for _ in range(rng.randint(0, 6))), *t, *(rng.choice(words) for _ in range(rng.randint(0, 6)))])

    texts = ["\n".join(line() for _ in range(rng.randint(1, 3))) for _ in range(150)] + [None, "", "This Source Code Form is subject to the terms of the Mozilla Public, v. 2.0."]
    got = licenses.scan(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")).toPandas().set_index("path")
    terms = lambda t: pd.Series(re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", (t or "").lower()), dtype=object).value_counts().to_dict()
    df = pd.Series([t for text in texts for t in terms(text)]).value_counts().to_dict()
    idf = lambda t: np.log((1 + len(texts)) / (1 + df.get(t, 0))) + 1

    def unit(counts):
        w = {t: (1 + np.log(n)) * idf(t) for t, n in counts.items()}
        size = np.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}

    templates = [(name, unit(terms(t))) for name, ts in sorted(licenses.TEMPLATES.items()) for t in ts]
    for i, text in enumerate(texts):
        lines = (text or "").split("\n")
        runs = ["\n".join(lines[i : i + n]) for n in (1, 2, 4, 8) for i in range(len(lines) - n + 1)]
        cosines = [max((sum(x * own.get(t, 0) for t, x in v.items()), name) for name, v in templates) for part in [*runs, text] for own in [unit(terms(part))]]
        best = max(c for c, _ in cosines)
        r = got.loc[str(i)]
        if best >= licenses.THRESHOLD + 1e-9:
            assert abs(r.cosine - best) < 1e-9 and r.license in {*licenses.TEMPLATES, "GPL", "LGPL"}
        else:
            assert r.license is None or best > licenses.THRESHOLD - 1e-9
    assert got.license.notna().sum() > 30 and got.license["152"] == "MPL-2.0"
    assert licenses.scan(spark.createDataFrame([("a/LICENSE", f"The MIT License\n\nCopyright (c) 2020 X\n\n{licenses.MIT}"), ("b", "x")], "path string, text string")).where("license = 'MIT'").count() == 1


def test_licenses_of_wrapped_headers_and_versions(spark):
    header = lambda name, v: f"# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU {name} as published by\n# the Free Software Foundation; either version {v} of the License, or\n# (at your option) any later version."
    code = "\n".join(f"x{i} = compute(y{i}, {i})" for i in range(60))
    texts = {
        "GPL-2.0": f"# file a\n{header('General Public License', 2)}\n{code}", "GPL-3.0": f"{code}\n{header('General Public License', 3)}\n{code}",
        "LGPL-2.1": f"{header('Lesser General Public License', '2.1')}\n{code}", "LGPL-3.0": f"{header('Lesser General Public License', 3)}\n{code}", "AGPL-3.0": f"GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3\n{code}",
        "Apache-2.0": f"Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n{code}", "GPL": f"{header('General Public License', 'x').replace('version x of', 'any version of')}\n{code}",
        "MPL-2.0": f"/* This Source Code Form is subject to the terms of the Mozilla\n * Public License, v. 2.0. If a copy of the MPL was not distributed with\n * this file, You can obtain one at https://mozilla.org/MPL/2.0/. */\n{code}", "none": code,
    }
    rows = [*texts.items(), *((f"other{i}", f"{code} and words of no licence {i}") for i in range(300))]
    got = {r.path: (r.license, r.line, r.lines) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {k: v[0] for k, v in got.items() if not k.startswith("other")} == {k: None if k == "none" else k for k in texts}
    assert got["GPL-2.0"][1:] == (2, 4) and got["GPL-3.0"][1:] == (61, 4) and got["AGPL-3.0"][1:] == (1, 2)
    assert all(v[0] is None for k, v in got.items() if k.startswith("other"))


# 6 ------------------------------------------------------------------------------------------------------------------


def brute_components(texts, shingle, percent):
    sets = [minhash.shingle_set(minhash.words_of(t), shingle) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_minhash_against_brute_force(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 80))] for _ in range(6)]
    texts = [None, "", "one", "ONE", "one two", "One  Two\n", "b a b a b", "a b a b a b", LONG]
    for b in base:  # chains and stars of edits around the threshold
        now = b
        for _ in range(25):
            now = list(rng.choice((b, now)))
            for _ in range(rng.randint(0, 4)):
                now[rng.randrange(len(now))] = f"w{rng.randrange(400)}"
            texts.append(" ".join(now))
    given = docs(spark, texts).withColumn("bands", F.lit("clash")).withColumn("component", F.lit(0))
    got = minhash.near_duplicates(given, shingle=2).orderBy("doc_id").toPandas()
    assert got.component.tolist() == brute_components(texts, 2, 80)
    assert got.n_shingles.tolist() == [len(minhash.shingle_set(minhash.words_of(t), 2)) for t in texts]


def test_minhash_odd_rows(spark):
    twice = docs(spark, ["same text here", "same text here", None]).unionAll(docs(spark, ["same text here", "other words", None]))
    got = minhash.near_duplicates(twice, shingle=2)
    assert got.count() == 6 and {r["component"] for r in got.where("doc_id < 2").collect()} == {0}
    assert minhash.near_duplicates(twice.where("false")).count() == 0


def test_minhash_ids_with_several_texts(spark):
    """An id with two texts has the links of both, whichever text is smaller, in leaders and in tiles."""
    rng = random.Random(9)
    a, b = ([f"{x}{rng.randrange(900)}" for _ in range(60)] for x in "ab")
    near = lambda w: " ".join([*w[:-1], "end"])
    for texts in ([(5, a), (5, b), (7, near(a)), (9, near(b))], [(5, b), (5, a), (9, near(b)), (7, near(a)), (5, a), (3, "own words only")]):
        rows = [(i, t if isinstance(t, str) else " ".join(t), "en", "s", None) for i, t in texts]
        got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), shingle=2).collect()
        assert len(got) == len(texts) and {(r["doc_id"], r["component"]) for r in got} == {(5, 5), (7, 5), (9, 5)} | ({(3, 3)} if len(texts) > 4 else set())


def test_bayes_bound():
    for n in (16, 64, 160):
        m = minhash.fewest_matches(n, 0.8, 1e-6)
        assert 0 < m < 0.8 * n and minhash.fewest_matches(n, 0.8, 1e-3) > m


def test_components(spark):
    edges = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(100, 200), (300, 100), (5, 5)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: i // 10 * 10 for i in range(40)} | {100: 100, 200: 100, 300: 100}


# 7 ------------------------------------------------------------------------------------------------------------------


def test_top_k_odd_rows(spark):
    v = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [-1.0, 0.0]), (6, [2.0, 2.0, 2.0]), (7, [1.0, 0.5]), (8, [float("inf"), 0.0]), (100, [0.25, 0.25]), (200, [1.0, 1.0, 1.0]), (300, None)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("part", F.lit("clash")).withColumn("score", F.lit(1))
    got = topk.exact_top_k(df, df.where("vec_id % 100 = 0"), 3, shard_rows=2, block_rows=1).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r["id"])
    assert by == {0: [1, 7, 100], 100: [0, 1, 7], 200: [6]}
    assert topk.exact_top_k(df.where("false"), df, 3).count() == 0
    assert topk.exact_top_k(df, df.where("false"), 3).count() == 0


def test_top_k_merges_in_levels(spark, monkeypatch):
    """Many shards, lists merged in twos, several blocks of queries and ties: the result is that of all products."""
    monkeypatch.setattr(topk, "MERGE", 2)
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (300, 4)) / 4
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = topk.exact_top_k(df, df.where("vec_id % 30 = 0"), 5, shard_rows=4, block_rows=3).orderBy("query_id", "rank").collect()
    scores = (np.floor(x * 1024) @ np.floor(x * 1024).T).astype(int)
    expected = [(q, r + 1, i, scores[q, i]) for q in range(0, 300, 30) for r, i in enumerate(sorted((i for i in range(300) if i != q), key=lambda i: (-scores[q, i], i))[:5])]
    assert [tuple(r) for r in got] == expected


# 8 ------------------------------------------------------------------------------------------------------------------


def test_backoff_of_three(spark):
    texts = ["a b c a b c a b d", "A b c", None, "", "x", "a b", "q"]
    import math
    from collections import Counter

    words = [(t or "").lower().split() for t in texts]
    counts = Counter(tuple(w[i : i + n]) for w in words for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total = sum(map(len, words))

    def score(w, i):
        longest = min(3, i + 1)
        for n in range(longest, 1, -1):
            g = tuple(w[i - n + 1 : i + 1])
            if counts[g] >= 2:
                return math.log(counts[g] / counts[g[:-1]]) + (longest - n) * math.log(0.4)
        return math.log(counts[(w[i],)] / total) + (longest - 1) * math.log(0.4)

    given = docs(spark, texts).withColumn("block", F.lit("clash"))
    for chars, grams in ((10**6, 10**6), (10, 5)):
        got = ngrams.stupid_backoff(given, order=3, min_count=2, block_chars=chars, part_grams=grams).orderBy("doc_id").collect()
        assert np.allclose([r["log_score"] for r in got], [sum(score(w, i) for i in range(len(w))) for w in words])
    twice = ngrams.stupid_backoff(given.unionAll(given), order=3, block_chars=10).collect()
    assert len(twice) == 2 * len(texts) and len({(r["doc_id"], round(r["log_score"], 9)) for r in twice}) == len(texts)
    assert ngrams.stupid_backoff(docs(spark, [LONG])).first()["n_words"] == 60_000
    assert ngrams.stupid_backoff(given.where("false")).count() == 0
    assert ngrams.stupid_backoff(docs(spark, [None, ""])).count() == 2


def test_backoff_to_another_corpus(spark):
    """Texts that the counts are not from: unseen n-grams back off, an unseen word counts once."""
    corpus = docs(spark, ["a b c", "a b d", None]).select("text")
    got = {r["doc_id"]: r["log_score"] for r in ngrams.stupid_backoff(docs(spark, ["a b", "b a", "z", ""]), corpus=corpus, block_chars=3).collect()}
    assert np.allclose([got[i] for i in range(4)], [np.log(2 / 6) + np.log(2 / 2), np.log(2 / 6) + np.log(0.4 * 2 / 6), np.log(1 / 6), 0])


def test_backoff_counts_of_64_bits():
    n = np.array([1, 254, 255, 256, 2**32, 2**60], dtype=np.uint64)
    assert (ngrams.unpack_counts(ngrams.pack_counts(n), 6) == n).all()
    grams = np.array([7, 2**63 + 1, 9], "<u8")
    sums = ngrams.add_counts([grams.tobytes(), grams[1:].tobytes(), b""], [ngrams.pack_counts(np.array(x, np.uint64)) for x in ([2**32, 5, 2**40], [2**33, 1], [])])
    assert ngrams.unpack_counts(sums[0], 3).tolist() == [2**32, 2**33 + 5, 2**40 + 1] and ngrams.unpack_counts(sums[1], 2).tolist() == [2**33 + 5, 2**40 + 1]


# 9 ------------------------------------------------------------------------------------------------------------------

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def automaton():
    return bpe.compile_automaton(VOCABULARY)


def test_bpe_against_library(automaton):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(2)
    odd = "aehtinorsl  \n\t'.,!?019éß*-<|>ABst 　中\U0001f600\x1c"
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 300))) for _ in range(1500)]
    texts += ["a" * n for n in range(1, 150, 7)] + ["", " " * 77, "the<|endoftext|> x<|endoftext|>", "<|endoftext|>", "=" * 200, "he said it's they'll I'm", LONG[:50_000]]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = automaton.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, t
        assert automaton.decode(ids) == library.decode(e.ids, skip_special_tokens=False)


def test_bpe_of_other_merges(tmp_path):
    """Small random vocabularies against merging by rank."""
    rng = random.Random(4)
    for case in range(60):
        letters = ["a", "b", "c"]
        vocab, merges = {x: i for i, x in enumerate(letters)}, []
        for _ in range(rng.randint(1, 12)):
            a, b = rng.choice(list(vocab)), rng.choice(list(vocab))
            if a + b not in vocab:
                vocab[a + b] = len(vocab)
                merges.append([a, b])
        file = tmp_path / f"{case}.json"
        file.write_text(json.dumps({"model": {"vocab": vocab, "merges": merges}}))
        made = bpe.compile_automaton(str(file))
        for _ in range(60):
            w = "".join(rng.choice(letters) for _ in range(rng.randint(1, 12)))
            pieces = list(w)
            for a, b in merges:
                i = 0
                while i < len(pieces) - 1:
                    if pieces[i] == a and pieces[i + 1] == b:
                        pieces[i : i + 2] = [a + b]
                    i += 1
            assert made.word(w.encode()) == [vocab[p] for p in pieces], (merges, w)


def test_bpe_odd_rows(spark):
    given = docs(spark, ["hi there", None, "", "hi there"]).withColumn("ids", F.lit("clash"))
    out = bpe.encode_decode(given, VOCABULARY).orderBy("doc_id").collect()
    assert [r["decoded"] for r in out] == ["hi there", "", "", "hi there"] and [len(r["ids"]) for r in out][1:3] == [0, 0]
    assert bpe.encode_decode(given.where("false"), VOCABULARY).count() == 0


# 10 -----------------------------------------------------------------------------------------------------------------


def test_toxicity_neighbours_are_exact(monkeypatch):
    """Blocks, dense words and bounds change nothing: neighbours are those of plain cosines over all words."""
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    monkeypatch.setattr(toxicity, "TOGETHER", 7)
    rng = random.Random(6)
    names = [b"w%d" % i for i in range(40)]
    some = lambda: {w: rng.randint(1, 4) for w in rng.sample(names, rng.randint(1, 8))}
    texts = list({tuple(sorted(v.items())): v for v in (some() for _ in range(700))}.values())
    examples = [(v, rng.randint(1, 3), rng.randint(0, 1), i) for i, v in enumerate(texts)]
    df = {w: rng.randint(1, 500) for w in names}
    place = {w: i for i, w in enumerate(names)}
    coded = [(np.array([place[w] for w in v]), np.array(list(v.values())), n, t, i) for v, n, t, i in examples]
    index = toxicity.BlockMaxIndex(place, np.array([df[w] for w in names], float), 1000, coded)
    toxic = {w: sum(w in e[0] and 2 * e[2] > e[1] for e in examples) for w in names}
    other = {w: sum(w in e[0] and 2 * e[2] <= e[1] for e in examples) for w in names}
    weight = {w: (np.log(1001 / (1 + df[w])) + 1) * np.log2(2 + toxic[w] / max(1, other[w])) for w in names}

    def dense(words):
        v = np.array([(1 + np.log(words[w])) * weight[w] if w in words else 0 for w in names])
        unknown = [(1 + np.log(n)) * (np.log(1001 / 2) + 1) for w, n in words.items() if w not in weight]
        return v / np.sqrt(v @ v + sum(x * x for x in unknown))

    rows = np.array([dense(texts[e[4]]) for e in index.examples])
    queries = [some() | ({b"new": 2} if rng.random() < 0.3 else {}) for _ in range(60)] + [{b"new": 1}, {}]
    for q, got in zip(queries, index.nearest([index.vector(q) for q in queries], 9), strict=True):
        cosines = np.round(rows @ dense(q), 12) if set(q) & set(names) else np.zeros(len(rows))
        expected = sorted((-c, i) for i, c in enumerate(cosines) if c > 0)[:9]
        assert [i for _, i in got] == [i for _, i in expected] and np.allclose([c for c, _ in got], [-c for c, _ in expected])


def plain_toxicity(texts, labels, teaching):
    """Scores by the formulas of the docstrings over whole vectors, without an index."""
    words = [toxicity.words_of(t) for t in texts]
    df = pd.Series([w for v in words for w in v]).value_counts().to_dict()
    alike = {}
    for i in teaching:
        alike.setdefault(tuple(sorted(words[i].items())), []).append(labels[i])
    share = (sum(map(sum, alike.values())) + 1) / (sum(map(len, alike.values())) + 2)
    examples = [(dict(k), len(v), sum(v)) for k, v in alike.items() if k]
    names = sorted({w for e in examples for w in e[0]})
    place = {w: i for i, w in enumerate(names)}
    toxic, other = np.zeros(len(names)), np.zeros(len(names))
    for e in examples:
        (toxic if 2 * e[2] > e[1] else other)[[place[w] for w in e[0]]] += 1
    weight = (np.log((1 + len(texts)) / (1 + np.array([df[w] for w in names]))) + 1) * np.log2(2 + toxic / np.maximum(other, 1))

    def vector(v):
        out, size = np.zeros(len(names)), 0.0
        for w, n in v.items():
            x = (1 + np.log(n)) * (weight[place[w]] if w in place else np.log((1 + len(texts)) / 2) + 1)
            size += x * x
            if w in place:
                out[place[w]] = x
        return out / np.sqrt(size) if size else out

    rows = np.array([vector(e[0]) for e in examples])

    def vote(v, own=None, y=0):
        s = np.round(rows @ vector(v), 12)
        up, down, left = 0.05 * share, 0.05, 31
        for i in np.argsort(-s, kind="stable"):
            n, t = examples[i][1] - (i == own), examples[i][2] - (i == own) * y
            if s[i] > 0 and n > 0 and left:
                w = s[i] / (1.02 - min(s[i], 1))
                up, down, left = up + w * t / n, down + w, left - 1
        return np.log(np.clip(up / down, 1e-4, 1 - 1e-4) / (1 - np.clip(up / down, 1e-4, 1 - 1e-4)))

    cases = [(vote(e[0], i, y), y) for i, e in enumerate(examples) for y, n in ((1, e[2]), (0, e[1] - e[2])) if n]
    slope, shift = toxicity.fit_logistic(*np.array([(z, y, 1) for z, y in cases], float).T)
    return [1 / (1 + np.exp(-(slope * vote(v) + shift))) if set(v) & set(names) else share for v in words]


def test_toxicity_against_plain_formula(spark):
    """The whole score, on rows of a given table; texts that share words with an example have neighbours."""
    given = table(spark, "documents").toPandas()
    labels = table(spark, "labels").toPandas().set_index("doc_id").toxic.to_dict()
    teach = [i for i, d in enumerate(given.doc_id) if d in labels and zlib.crc32(str(d).encode()) % 3 != 1]
    expected = plain_toxicity(given.text.tolist(), [labels.get(d, 0) for d in given.doc_id], teach)
    got = toxicity.score_documents(table(spark, "documents"), table(spark, "labels"), "toxic", toxicity.TRAIN).toPandas().set_index("doc_id")
    assert np.abs(got.score[given.doc_id].to_numpy() - np.array(expected)).max() < 2e-3
    known = {w for i in teach for w in toxicity.words_of(given.text[i])}
    assert all(len(got.evidence[d]) for d, t in zip(given.doc_id, given.text, strict=True) if known & set(toxicity.words_of(t)))


def test_toxicity_held_out(spark):
    out = toxicity.op10_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    held = out[out.held_out]
    assert ((held.predicted == 1) == (held.toxic == 1)).mean() > 0.9 and held[held.toxic == 0].predicted.sum() <= 2


def test_toxicity_odd_rows(spark):
    texts = ["nice", "vile slur", None, ""] + ["vile slur here", "nice words here"] * 12
    given = docs(spark, texts).withColumn("terms", F.lit("clash")).withColumn("y", F.lit(5))
    labels = spark.createDataFrame([(i, int("vile" in (texts[i] or ""))) for i in range(4, 28)] + [(0, None)], "doc_id long, toxic int")
    out = toxicity.score_documents(given, labels, "toxic", "true").toPandas().set_index("doc_id")
    assert len(out) == 28 and out.score.between(0, 1).all() and out.score[2] == out.score[3]
    long = docs(spark, [LONG + "vile slur", LONG]).unionAll(given.select("doc_id", "text", "lang", "source", "n_chars"))
    assert toxicity.score_documents(long, labels, "toxic", "true").count() == 30
    kept = toxicity.without_toxic(given.withColumn("big", F.when(F.col("doc_id") != 1, F.lit(2**53 + 1))), labels.unionAll(labels), "toxic", "true", 0.7).collect()
    assert {r["big"] for r in kept} == {2**53 + 1} and {r["doc_id"] for r in kept} == {0, 2, 3, *range(5, 28, 2)}
    for none in (labels.where("false"), labels.where("toxic = 0")):
        assert toxicity.score_documents(given, none, "toxic", "true").count() == 28
    assert toxicity.score_documents(given.where("false"), labels, "toxic", "true").count() == 0


# pipeline -----------------------------------------------------------------------------------------------------------

# 11 -----------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, v int, id int, cluster int"


def plain_clusters(rows, k, rounds, dim, scale):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        of = [[v for _, v in kept if near(v)[1] == j] for j in range(len(c))]
        c = [[sum(col) // len(vs) for col in zip(*vs, strict=True)] if vs else old for vs, old in zip(of, c, strict=True)]
    at = [(i, *near(v)[::-1]) for i, v in kept]
    return [(i, j, d, sum(x[2] for x in at if x[1] == j), sum(x[2] for x in at), c[j]) for i, j, d in at]


def test_centroids_odd_rows(spark):
    rng = np.random.default_rng(11)
    rows = [(int(i), [float(x) for x in rng.normal(size=3)]) for i in range(60)]
    rows += [(3, rows[3][1]), (7, rows[9][1]), (None, [0.5, -0.5, 0.25]), (70, None), (71, [1.0, None, 2.0]), (72, [1.0, float("nan"), 0.0]), (73, [1.0, float("inf"), 0.0]), (74, [1.0]), (75, [])]
    rows += [(80 + i, [0.1, 0.1, 0.1]) for i in range(20)]
    given = spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], VECTORS)
    as_float = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for k, rounds in ((4, 3), (1, 0), (200, 2)):
        got = [tuple(r) for r in centroids.cluster(given, k=k, rounds=rounds, dim=3).collect()]
        none_first = lambda r: (r[0] is not None, *((0, *r[1:]) if r[0] is None else r))
        assert sorted(got, key=none_first) == sorted(plain_clusters(as_float, k, rounds, 3, 64), key=none_first)
    empty = centroids.cluster(given.where("false"), dim=3)
    assert empty.count() == 0 and empty.columns == centroids.cluster(given, dim=3).columns


# 12 -----------------------------------------------------------------------------------------------------------------


def paragraphs(text):
    return set(re.findall(fingerprint.PARAGRAPH, text))


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_against_plain_sets(spark):
    rng = random.Random(12)
    line = lambda: " ".join(rng.choice(["one", "Two.", "drei!", "é", "\U0001f600x"]) for _ in range(rng.randint(1, 30)))
    lines = [line() for _ in range(40)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.choice([0, 1, 2, 5, 20, 200]))) for _ in range(60)] + [None, "", "x", LONG, "a\n\n\nb. c", *["copy.\nof it"] * 3]
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, "no id"), (5, "second text of an id"), (7, texts[1]), (7, texts[1])]
    given = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).withColumn("k", F.lit(1)).withColumn("own", F.lit(2)).withColumn("part", F.lit(3))
    got = fingerprint.fingerprints(given).collect()
    assert len(got) == len(rows)
    place = {(i, t or ""): None for i, t in rows}
    mark = {k: row_key("doc_id", F.lit(k[1])) for k in place}
    marks = {k: spark.range(1).select(F.lit(k[0]).cast("long").alias("doc_id")).select(m.alias("k")).first()[0] for k, m in mark.items() if sum(x[0] == k[0] for x in place) > 1}
    ordered = sorted(place, key=lambda k: (k[0] is not None, k[0] or 0, marks.get(k, "")))
    want = {}
    for k, after in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        e = edited(k[1], after[1])
        own = paragraphs(k[1])
        want[k] = (k[0], len(k[1]), hashlib.sha256(e.encode()).hexdigest(), round(alike(own, paragraphs(e)), 9), round(alike(own, paragraphs(after[1])), 9), len(own - paragraphs(e)), len(paragraphs(after[1]) - own))
    have = sorted((str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9), len(r.edited_lost), len(r.next_new)) for r in got)
    assert have == sorted((str(w[0]), *w[1:]) for w in (want[i, t or ""] for i, t in rows))
    prints = {}
    for r in got:
        prints.setdefault(r.fingerprint, set()).add(r.n_chars)
    copies = [r.fingerprint for r in got if r.n_chars == len("copy.\nof it")]
    assert len(copies) == 3 and len(set(copies)) == 1 and len(prints) == len({frozenset(paragraphs(k[1])) for k in place})
    assert fingerprint.fingerprints(given.where("false")).count() == 0
    one = fingerprint.fingerprints(given.where("doc_id = 14")).first()
    assert one.near_next == 1.0


def test_fingerprints_peel_and_retry(spark, monkeypatch):
    rng = random.Random(1)
    keys = lambda n: [rng.getrandbits(63) for _ in range(n)]
    shared = keys(50)
    cases = [(str(n), shared + keys(n), shared + keys(m)) for n in (0, 1, 3, 40, 300) for m in (0, 2, 30)] + [("none", [], [])]
    given = spark.createDataFrame(cases, "k string, a array<long>, b array<long>").withColumn("k", F.concat("k", F.size("b").cast("string")))
    for bucket, load in ((16, 2), (2, 6)):  # the second fails often
        monkeypatch.setattr(fingerprint, "BUCKET", bucket)
        monkeypatch.setattr(fingerprint, "LOAD", load)
        out = fingerprint.differences(given, "k", {"ab": ("a", "b")}, ["a", "b"]).collect()
        assert len(out) == len(cases)
        for r in out:
            assert r.ab_lost == sorted(set(r.a) - set(r.b)) and r.ab_new == sorted(set(r.b) - set(r.a))


def test_fingerprints_subtract_by_text(spark):
    """Fingerprints alone give the changed paragraphs away, if few are changed."""
    a, b = [11, 22, 33, 44], [11, 22, 55]
    row = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    cells = fingerprint.subtract(fingerprint.sketch(F.col("a"), 4), fingerprint.sketch(F.col("b"), 4))
    got = row.select(fingerprint.peel(cells, 4).alias("d"), fingerprint.as_text(fingerprint.sketch(F.col("a"), 4)).alias("t")).first()
    assert sorted(map(tuple, got.d)) == [(-1, 55), (1, 33), (1, 44)] and len(got.t) == 12 * 28


# 13 -----------------------------------------------------------------------------------------------------------------


def plain_infill(i, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[j : j + 8], 16) for j in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return len(units), *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


def test_infill_against_plain_units(spark):
    rng = random.Random(13)
    passage = "".join(rng.choice("abcXYZ  .\n12é\U0001f600<>PSM") for _ in range(3000)).replace("<P>", "").replace("<S>", "").replace("<M>", "")
    text = lambda n: "".join(rng.choice("abcdeABC  ,.é\U00010348\x00<>") for _ in range(n))
    texts = [text(rng.choice([0, 1, 2, 60, 300, 4000])) + (passage if rng.random() < 0.5 else "") + text(rng.randint(0, 90)) for _ in range(150)]
    texts += [None, "", "a", "a <P> b", "<S", "<M>", "x" * 50_000, LONG, "é" * 9000, "word " * 2000 + "y" * 9000, passage, passage]
    rows = [*enumerate(texts), (None, passage), (None, None), (3, texts[3])]
    given = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).withColumn("n", F.lit(9)).withColumn("form", F.lit("clash")).withColumn("h", F.lit(1))
    out = infill.fill_in_middle(given)
    got = [tuple(r) for r in out.withColumn("again", infill.restored("output", "form")).collect()]
    assert sorted(got, key=str) == sorted([(i, *plain_infill(i, t or ""), t or "") for i, t in rows], key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(given.where("false")).count() == 0


def test_infill_chunks():
    rng = random.Random(2)
    shared = "".join(rng.choice("abc de.") for _ in range(8000))
    cache = infill.ChunkCache()
    for head in ("", "some other start ", "x" * 70):
        ends = infill.boundaries(head + shared)
        assert ends == sorted(set(ends)) and ends[-1] == len(head + shared) and max(b - a for a, b in zip([0, *ends], ends, strict=False)) <= infill.MOST
        units = infill.Units(head + shared, cache)
        plain = [m.start() for m in infill.UNIT.finditer(head + shared)] + [len(head + shared)]
        assert units.n == len(plain) - 1 and [units.cut(i) for i in range(len(plain))] == plain
    assert cache.hits > 30
    small = infill.ChunkCache(limit=500)
    assert infill.Units(shared, small).n == infill.Units(shared, cache).n and small.chars <= 2500
    assert infill.Units("", cache).n == 0 and infill.Units("", cache).cut(0) == 0



def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    began = time.time()
    filler = [" ".join(f"t{i}x{j}" for j in range(30)) for i in range(6)]
    item = " ".join(f"bench{i}" for i in range(14))
    texts = [*filler, filler[0], filler[1] + " tail", "before " + item + " after", "write to a.b@c.example.com soon", None, ""]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas().set_index("doc_id")
    assert sorted(out.index) == [0, 1, 2, 3, 4, 5, 9, 10, 11] and out.round_trip.all()
    made = bpe.compile_automaton(VOCABULARY)
    assert made.decode(out.ids[9]) == "write to [EMAIL] soon" and made.decode(out.ids[3]) == texts[3]
    assert not [p for p in os.listdir(scratch_dir(spark)) if p.startswith("stage-") and "personal_data" not in p and os.path.getmtime(f"{scratch_dir(spark)}/{p}") > began]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "bpe"]


def test_pipeline_odd_rows(spark, tmp_path):
    """Rows without an id, ids with several texts, repeated rows, long texts, clashing columns, a toxic row; then no rows at all."""
    import corpus_pipeline

    words = lambda tag, n=30: " ".join(f"{tag}{j}" for j in range(n))
    item, bad = words("bench", 14), "vile nasty slur hate " * 6
    rows = [
        (1, "mail me at x.y@example.org now"), (2, "no mail at all in this row of words"), (2, "mail p.q@example.org"), (None, "mail n.n@example.org please"),
        (3, words("a")), (None, words("a") + " b"), (None, words("c")), (None, words("c")), (4, words("c")), (None, words("d")), (None, words("d") + " e"),
        (None, "then " + item), (5, "then " + item), (5, words("clean")), (6, bad + "one"), (None, bad + "two"), (7, None), (7, ""), (8, LONG), (8, LONG), (None, None),
    ]
    rows += [(100 + i, f"{bad} {i}") for i in range(12)] + [(200 + i, words(f"w{i}x")) for i in range(40)]
    given = spark.createDataFrame([(i, t, "en", "s", 3) for i, t in rows], DOCS).withColumns({c: F.lit(5) for c in ("id", "words", "node", "component", "key", "spans", "text_hash", "of_text")})
    given.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, int(100 <= i < 200)) for i in range(100, 240)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, columns = given, given.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == columns
        at.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        have = [(r.doc_id, r.text) for r in at.collect()]
        if name == "toxicity":
            assert not any(t and "vile" in t for _, t in have) and sum(i is not None and 200 <= i for i, _ in have) == 40 and (8, LONG) in have
        if name == "near_duplicates":
            assert (3, words("a")) in have and (None, words("a") + " b") not in have and (None, words("c")) not in have and have.count((8, LONG)) == 2
            assert sum(t in (words("d"), words("d") + " e") for _, t in have) == 1 and (7, None) in have and (7, "") in have and (None, None) in have
        if name == "decontamination":
            assert not any(t and "bench3" in t for _, t in have) and (5, words("clean")) in have
        if name == "personal_data":
            assert (1, "mail me at [EMAIL] now") in have and (2, "no mail at all in this row of words") in have and (2, "mail [EMAIL]") in have and (None, "mail [EMAIL] please") in have
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == at.count() and out.where("NOT round_trip").count() == 0
    nothing = given.where("false")
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, str(tmp_path))
    assert nothing.count() == 0


@pytest.mark.parametrize("grams", [100_000, 0])
def test_decontaminate_rows_without_ids(spark, monkeypatch, grams):
    monkeypatch.setattr(decontaminate, "BROADCAST_GRAMS", grams)
    item = " ".join(f"bench{i}" for i in range(14))
    given = spark.createDataFrame([(None, f"x {item} y"), (None, "clean"), (None, f"x {item} y"), (1, item), (1, "other"), (None, None)], "doc_id long, text string")
    hits = decontaminate.benchmark_hits(given, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted((str(r.doc_id), r.n_hit) for r in hits.collect()) == [("1", 0), ("1", 14), ("None", 0), ("None", 0), ("None", 14)]
