"""Sinks: what a run publishes, and what a failed one leaves."""

import pytest
from pyspark.sql import functions as F

from fundtrace.operators import levels as lv
from fundtrace.sources import tables as st


def test_publish_is_all_or_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/data"
    events = spark.createDataFrame([(1, "a", 0.5), (2, "b", 1.5), (3, None, None), (4, "z", 2.5)], "i int, label string, x double")
    assert st.published(spark, path) == (None, {})
    manifest = st.publish({"events": events, "model": events.where("x is not null")}, path, "run-1", {"events": st.Audit({"label": ["a", "b"]}, ("x",))})
    got = {(r.table, r.metric, r.value): r.figure for r in manifest.collect()}
    assert got["events", "rows", ""] == 4 and got["model", "rows", ""] == 3
    assert [got["events", "count of label", k] for k in ("a", "b", "(missing)", "(other)")] == [1, 1, 1, 1]
    assert [got["events", "x", k] for k in ("count", "mean", "min", "max")] == [3, 1.5, 0.5, 2.5] and abs(got["events", "x", "std"] - 1) < 1e-12
    run, tables = st.published(spark, path)
    assert run == "run-1" and sorted(tables) == ["events", "model"] and tables["model"].count() == 3
    broken = events.withColumn("x", F.raise_error(F.lit("stop")).cast("double"))
    with pytest.raises(Exception, match="stop"):
        st.publish({"events": events, "model": broken}, path, "run-2")
    assert st.published(spark, path)[0] == "run-1"
    st.publish({"events": events.where("i = 1")}, path, "run-3")
    run, tables = st.published(spark, path)
    assert run == "run-3" and list(tables) == ["events"] and tables["events"].count() == 1


def test_drawdown_by_blocks_is_that_of_the_path(spark):
    import math
    import random

    rng = random.Random(9)
    rows = [(k, m, rng.choice([None, rng.gauss(0, 0.1), rng.gauss(-0.02, 0.2), -0.9]) if rng.random() < 0.9 else -1.0) for k in range(12) for m in sorted(rng.sample(range(100, 260), rng.randint(1, 90)))]
    got = {r.k: r.max_drawdown for r in lv.path_drawdown(spark.createDataFrame(rows, "k int, m int, r double"), "k", "m", "r", 7).collect()}
    for k in range(12):
        wealth, peak, deep, some = 0.0, 0.0, 0.0, False
        for _, _, r in sorted(x for x in rows if x[0] == k and x[2] is not None and x[2] > -0.999999):
            wealth, some = wealth + math.log1p(r), True
            peak = max(peak, wealth)
            deep = min(deep, wealth - peak)
        assert (k in got) == some and (not some or abs(got[k] - math.expm1(deep)) < 1e-9)


def test_percentiles_of_groups_are_exact(spark, monkeypatch):
    import random

    import numpy as np

    from fundtrace.operators import scores as sc

    rng = random.Random(4)
    groups = {"few": [1.5], "two": [3.0, 1.0], "same": [2.0] * 30, "many": [rng.gauss(0, 9) for _ in range(500)], "ties": [rng.randint(0, 5) + 0.0 for _ in range(200)]}
    rows = [(g, x) for g, xs in groups.items() for x in [*xs, None]] + [("none", None)]
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    for buckets in (64, 2):
        monkeypatch.setattr(sc, "BUCKETS", buckets)
        got = {r.g: r.q for r in sc.percentiles_by(spark.createDataFrame(rows, "g string, x double").repartition(5), ["g"], "x", shares).collect()}
        assert set(got) == set(groups)
        for g, xs in groups.items():
            assert np.allclose(got[g], np.quantile(xs, shares))


def test_queries_read_what_is_there_now(spark, tmp_path):
    import gc
    from pathlib import Path

    import pandas as pd

    from fundtrace import plans

    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        (tmp_path / p.name).symlink_to(p)
    query, path = plans.queries()["a01_portfolio_month"], str(tmp_path)
    before = query(spark, path).count()
    gc.collect()
    lines = pd.read_parquet("/root/testdata/sf0.001/lineitem.parquet")
    (tmp_path / "lineitem.parquet").unlink()
    lines[lines.l_suppkey < lines.l_suppkey.median()].to_parquet(tmp_path / "lineitem.parquet", index=False)
    assert 0 < query(spark, path).count() < before
    gc.collect()


def test_knowledge_folder_reads_mixed_files_and_counts_rejects(spark, tmp_path):
    import json

    from fundtrace.sources.knowledge import knowledge_folder

    root = tmp_path / "kb"
    (root / "sub dir").mkdir(parents=True)
    put = lambda name, text: (root / name).write_text(text, encoding="utf-8")
    put("README.md", "not this one")
    put("other.pdf", "nor this")
    put("fomc_2001-05-15.txt", "  rates were cut\n\n")
    put("sub dir/notes+a.md", "seen on 1999/03 in the first lines")
    put("blank.txt", " \n\t\n")
    put("list.json", json.dumps([{"title": "T", "date": "2000-01-02", "text": "", "content": "from content", "type": "macro"}, 7, {"body": " from body ", "evidence_type": "micro", "type": "x", "url": "u"}, {"title": "no text"}]))
    put("docs.json", json.dumps({"documents": [{"text": "inside", "source": "S"}, {"text": 12}]}))
    put("one.JSON", json.dumps({"text": "single"}))
    put("number.json", "5")
    put("broken.json", '[{"text": "a"')
    put("rows.csv", '\ufefftitle,text\nA,"two\nlines"\nB,\n,"says ""so"""\n')
    put("short.csv", "title,text\nonly title\n")
    put("long.csv", "title,text\na,b,c\n")
    put("open.csv", 'title,text\na,"b\n')
    (root / "latin.txt").write_bytes(b"caf\xe9")
    docs, rejects = knowledge_folder(spark, str(root))
    got = {(r.file, r.item): (r.title, r.source, r.doc_date, r.type, r.url, r.text) for r in docs.collect()}
    assert got == {
        ("fomc_2001-05-15.txt", 1): ("fomc_2001-05-15 #1", "fomc_2001-05-15.txt", "2001-05-15", "local_document", None, "rates were cut"),
        ("sub dir/notes+a.md", 1): ("notes+a #1", "sub dir/notes+a.md", "1999-03-01", "local_document", None, "seen on 1999/03 in the first lines"),
        ("list.json", 1): ("T", "list.json", "2000-01-02", "macro", None, "from content"),
        ("list.json", 3): ("list #3", "list.json", None, "micro", "u", "from body"),
        ("docs.json", 1): ("docs #1", "S", None, "local_document", None, "inside"),
        ("docs.json", 2): ("docs #2", "docs.json", None, "local_document", None, "12"),
        ("one.JSON", 1): ("one #1", "one.JSON", None, "local_document", None, "single"),
        ("rows.csv", 1): ("A", "rows.csv", None, "local_document", None, "two\nlines"),
        ("rows.csv", 3): ("rows #3", "rows.csv", None, "local_document", None, 'says "so"'),
    }
    assert {(r.file, r.item, r.reason) for r in rejects.collect()} == {
        ("blank.txt", 1, "no text"), ("list.json", 4, "no text"), ("broken.json", None, "malformed json"), ("rows.csv", 2, "no text"), ("short.csv", 1, "no text"),
        ("long.csv", None, "malformed csv"), ("open.csv", None, "malformed csv"), ("latin.txt", None, "not utf-8"),
    }
    (tmp_path / "empty").mkdir()
    docs, rejects = knowledge_folder(spark, str(tmp_path / "empty"))
    assert docs.count() == 0 and rejects.count() == 0


def test_csv_files_are_handed_back_in_pieces(spark, tmp_path):
    import pyarrow as pa

    from fundtrace.sources.knowledge import PIECE_CHARS, _csv_rows, knowledge_folder

    texts = ["title,text\n" + "".join(f'{i},"a ""line"",\r\nand one\rmore {"x" * 20_000}"\r\n' for i in range(150)) for _ in range(3)] + ["title,text\na,b,c\n"]
    sent = pa.RecordBatch.from_pydict({"file": [f"{k}.csv" for k in range(4)], "content": texts})
    sizes, rows = [], []
    for piece in map(lambda b: b.to_pylist(), _csv_rows(iter([sent]))):
        sizes.append(sum(len(r["fields"]["text"]) for r in piece if r["fields"]))
        rows += [(r["file"], r["item"], r["reason"]) for r in piece]
    assert max(sizes) < PIECE_CHARS + 25_000 and len(sizes) > 3
    assert rows == [(f"{k}.csv", i, None) for k in range(3) for i in range(1, 151)] + [("3.csv", None, "malformed csv")]
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb" / "wide.csv").write_bytes(f'text\n"{"long " * 60_000}"\n'.encode())  # above the csv module's usual limit of a field
    docs, rejects = knowledge_folder(spark, str(tmp_path / "kb"))
    assert [len(r.text) for r in docs.collect()] == [299_999] and rejects.count() == 0
