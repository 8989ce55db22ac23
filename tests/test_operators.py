"""Hand-made cases of the operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from fundtrace import contract
from fundtrace.functions import ingest, labels
from fundtrace.operators import classify, holdings, joins, models, scores, timeseries
from fundtrace.sources import tables


def one(df, column):
    return [r[column] for r in df.collect()]


def test_typed_ingest(spark):
    raw = ["1,234.5", "(2.5)", "12%", ".", "NaN", "", "1000057.0", "202001", "20200131", "2020/1/5"]
    df = spark.createDataFrame([(x,) for x in raw], "x string")
    assert one(df.select(ingest.number(F.col("x")).alias("n")), "n") == [1234.5, -2.5, 0.12, None, None, None, 1000057.0, 202001.0, 20200131.0, None]
    assert one(df.select(ingest.identifier(F.col("x")).alias("n")), "n")[6] == "1000057"
    assert one(df.select(ingest.date(F.col("x")).alias("n")), "n")[7:] == [dt.date(2020, 1, 1), dt.date(2020, 1, 31), dt.date(2020, 1, 5)]
    t = ingest.typed(df, {"n": ("x", ingest.number), "d": ("x", ingest.date)})
    assert {r["column"]: r["n"] for r in ingest.rejects(t).collect()} == {"n": 1, "d": 4}


def panel(spark, months, rets=None):
    return spark.createDataFrame([("f", m, rets[i] if rets else 0.1 * (i + 1)) for i, m in enumerate(months)], "k string, m int, r double")


def test_calendar_lag_and_gaps(spark):
    df = panel(spark, [1, 2, 4])
    assert [r[0] for r in df.orderBy("m").select(timeseries.calendar_lag("r", ["k"], "m")).collect()] == [None, 0.1, None]
    gap = panel(spark, [1, 2, 4, 5, 6])
    by_date, by_row = (one(gap.select("m", timeseries.compounded("r", timeseries.forward(["k"], "m", 3, row_based=b), 3).alias("x")).orderBy("m"), "x")[0] for b in (False, True))
    assert by_date is None and by_row is not None


def test_drawdown(spark):
    df = panel(spark, [1, 2, 3], [-0.1, 0.2, 0.05])
    w = timeseries.trailing(["k"], "m", 12)
    assert one(df.select("m", timeseries.path_drawdown("r", "m", w).alias("x")).orderBy("m"), "x")[0] is None
    assert math.isclose(one(df.select("m", timeseries.path_drawdown("r", "m", w).alias("x")).orderBy("m"), "x")[2], -0.1)


def test_asof_tolerance(spark):
    left = spark.createDataFrame([("a", dt.date(2002, 1, 6)), ("a", dt.date(2002, 1, 7)), ("b", dt.date(2002, 1, 1))], "k string, d date")
    right = spark.createDataFrame([("a", dt.date(2001, 1, 1), 5.0)], "k string, at date, v double")
    out = {(r["k"], r["d"]): r["v"] for r in joins.asof(left, right, ["k"], "d", "at", ["v"], max_days=370).collect()}
    assert list(out.values()).count(5.0) == 1 and out["a", dt.date(2002, 1, 6)] == 5.0


def test_validity_and_overlap(spark):
    r = spark.createDataFrame([("a", dt.date(2000, 1, 1), dt.date(2000, 6, 30), 1), ("a", dt.date(2000, 6, 30), None, 2)], "k string, b date, e date, v int")
    left = spark.createDataFrame([("a", dt.date(2000, 1, 1)), ("a", dt.date(2001, 1, 1)), ("c", dt.date(2001, 1, 1))], "k string, d date")
    assert sorted(map(str, one(joins.validity(left, r, "k", "d", "b", "e"), "v"))) == ["1", "2", "None"]
    assert joins.overlapping(r, "k", "b", "e").count() == 1


def test_fallback(spark):
    b = spark.createDataFrame([("x", 1999, 1.0), ("x", 2001, 2.0)], "t string, y int, beta double")
    left = spark.createDataFrame([("x", 2000), ("x", 2005)], "t string, y int")
    assert {r["y"]: r["beta"] for r in joins.fallback(left, b, "t", "y", ["beta"]).collect()} == {2000: 1.0, 2005: None}


def test_fallback_of_rows_that_come_in_another_order_each_time(spark):
    import numpy as np

    left = spark.range(4000).select(F.concat(F.lit("k"), F.col("id") % 40).alias("t"), (F.col("id") / 40).cast("int").alias("y"))
    mixed = left.repartition(3).mapInPandas(lambda bs: (b.sample(frac=1, random_state=np.random.default_rng()) for b in bs), left.schema)
    b = left.where("y % 4 = 0").select("t", "y", (F.col("y") * 100 + F.substring("t", 2, 3).cast("int")).cast("double").alias("beta"))
    got = {(r["t"], r["y"]): (r["offset"], r["beta"]) for r in joins.fallback(mixed, b, "t", "y", ["beta"]).collect()}
    offset = {0: 0, 1: -1, 2: None, 3: 1}
    want = {(f"k{k}", y): (o, None if o is None else 100.0 * (y + o) + k) if (o := offset[y % 4]) is None or y + o < 100 else (None, None) for k in range(40) for y in range(100)}
    assert got == want


def test_evidence_shared_by_events_is_gathered_once(spark):
    events = spark.createDataFrame([("e1", 1, "m"), ("e2", 2, "m"), ("e3", 3, "n"), ("e4", 4, None)], "id string, p int, manager string")
    funds = spark.createDataFrame([("m", 7), ("m", 5), ("n", 9), (None, 1)], "manager string, fund int")
    held = spark.createDataFrame([(1, "m", "b", 2), (1, "m", "a", 2), (2, "x", "c", 1)], "p int, manager string, name string, nth int")
    sources = {"funds": (funds, ["manager"], F.col("fund"), F.col("fund")), "held": (held, ["p", "manager"], F.col("nth"), F.col("name"))}
    out = joins.event_evidence(events, "id", sources)
    got = {r["id"]: (r["funds_names"], r["held_names"], len(r["funds"])) for r in out.collect()}
    assert got == {"e1": (["5", "7"], ["a", "b"], 2), "e2": (["5", "7"], [], 2), "e3": (["9"], [], 1), "e4": ([], [], 0)}
    assert out.where("id = 'e1'").first()["held"][0] == '{"p":1,"manager":"m","name":"a","nth":2}'
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # lists are joined whole; nothing is gathered after the join
    assert joins.event_evidence(events, "id", sources, records=False).columns == ["id", "funds_names", "held_names"]


def test_ranks(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, 3.0, None)], "x double")
    got = df.select("x", scores.pct_rank_avg("x", []).alias("a"), scores.share_at_or_below("x", []).alias("b")).orderBy(F.asc_nulls_last("x")).collect()
    assert [r["a"] for r in got] == [0.25, 0.625, 0.625, 1.0, None]
    assert [r["b"] for r in got] == [0.25, 0.75, 0.75, 1.0, 0.5]


def test_constant_history_gives_no_score(spark):
    rows = [("m", dt.date(2000, i, 1), 0.1, 0.1) for i in range(1, 6)]
    out = scores.trailing_deviation(spark.createDataFrame(rows, "m string, d date, x double, y double"), "m", "d", ["x", "y"]).orderBy("d").collect()
    assert [r["deviation"] for r in out] == [None] * 5 and [r["n"] for r in out] == [0, 1, 2, 3, 4]


def test_window_of_36_months(spark):
    rows = [("m", dt.date(2000, 1, 31), 1.0), ("m", dt.date(2003, 1, 31), 2.0), ("m", dt.date(2003, 2, 1), 3.0)]
    out = scores.trailing_deviation(spark.createDataFrame(rows, "m string, d date, x double"), "m", "d", ["x"]).orderBy("d").collect()
    assert [r["n"] for r in out] == [0, 1, 1]


def test_future_rows_change_nothing_before(spark):
    rows = [("m", dt.date(2000, i, 1), 0.1 * i * i, 0.2) for i in range(1, 9)]
    make = lambda n: scores.expanding_scores(spark.createDataFrame(rows[:n], "m string, d date, x double, y double"), "m", "d", "x").where("d <= '2000-06-01'").orderBy("d").collect()
    assert make(6) == make(8)


def test_snapshot_diff(spark):
    d0, d1 = dt.date(2000, 3, 31), dt.date(2000, 6, 30)
    rows = [(1, d0, "up", 1.0), (1, d0, "same", 2.0), (1, d0, "gone", 3.0), (1, d1, "up", 2.0), (1, d1, "same", 2.19), (1, d1, "new", 1.0)]
    df = spark.createDataFrame(rows, "portfolio int, report_dt date, identity string, pct double")
    assert {r["identity"]: r["action"] for r in holdings.snapshot_diff(df).collect()} == {"up": "increase", "gone": "decrease", "new": "new_position"}
    assert {r["action"] for r in holdings.snapshot_diff(df, split_exit=True).collect()} == {"increase", "exit", "new_position"}


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in (-0.03, -0.005, 0.0, 0.005, 0.03, None)], "x double")
    got = df.select(labels.five_classes(F.col("x")).alias("c"), labels.direction(F.col("x")).alias("d")).collect()
    assert [(r["c"], r["d"]) for r in got] == [("large_loss", -1), ("neutral", -1), ("neutral", 0), ("small_win", 1), ("large_win", 1), (None, None)]


def test_forbidden_columns():
    assert contract.check_features(["stock", "bond"]) == ["stock", "bond"]
    with pytest.raises(ValueError, match="ret_3m"):
        contract.check_features(["stock", "ret_3m"])


def test_fingerprint_ignores_order(spark):
    a, b = (spark.createDataFrame(rows, "x int, y string") for rows in ([(1, "a"), (2, "b")], [(2, "b"), (1, "a")]))
    assert tables.fingerprint(a).collect() == tables.fingerprint(b).collect()


def test_documents_of_files(spark, tmp_path):
    (tmp_path / "a_2001-02-03.txt").write_text("one\ntwo")
    (tmp_path / "b.json").write_text('{"documents": [{"title": "t", "date": "2001-01-01", "body": "three"}]}')
    (tmp_path / "c.csv").write_text("title,date,content\nu,2002-02-02,four\n")
    got = tables.knowledge_documents(spark, str(tmp_path / "*.txt"), str(tmp_path / "b.json"), str(tmp_path / "c.csv")).collect()
    assert sorted(r["text"] for r in got) == ["four", "one\ntwo", "three"]


def test_report_split_over_files_rolls_up_once(spark, tmp_path):
    row = (1, dt.date(2000, 3, 31), 1.0, 10.0, 0.5, 1, "A")
    schema = "portfolio int, report_dt date, pct double, value double, beta double, security_rank int, sector string"
    for part in "xy":
        spark.createDataFrame([row], schema).write.parquet(str(tmp_path / part))
    both = spark.read.parquet(str(tmp_path / "x"), str(tmp_path / "y"))
    got = holdings.report_rollup(both).collect()
    assert len(got) == 1 and got[0]["n"] == 2 and got[0]["value"] == 20.0


def test_write_dataset(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2000, 1, 1), 1), (dt.date(2001, 1, 1), 2)], "d date, x int")
    tables.write_dataset(df, str(tmp_path / "out"), "d")
    assert spark.read.parquet(str(tmp_path / "out")).where("year = 2001").count() == 1


def test_exclusion_reasons(spark):
    cases = [
        ("Apple Inc", "AAPL", None), ("Berkshire Hathaway", " brk.b ", None), ("Some Corp", "912828", "invalid_or_missing_ticker"), ("Some Corp", None, "invalid_or_missing_ticker"),
        ("Some Corp", "NA", "invalid_or_missing_ticker"), (None, "ABC", "missing_security_name"), ("Some Co", "ABCDX", "likely_mutual_fund_ticker_5_letters_ending_x"),
        ("Vornado Realty Trust", "VNO", None), ("Gold Trust", "GLD", "excluded_trust_not_likely_company_equity"), ("Growth Fund", "GF", r"excluded_name_pattern:\bFUND\b"),
        ("Senior debt due 2030", "SD", r"excluded_name_pattern:\bSENIOR\b.*\bDUE\b"), ("Index Fund of Notes", "IX", r"excluded_name_pattern:\bFUND\b"), ("Refunding Co", "RF", None),
    ]
    df = spark.createDataFrame([(n, t, i) for i, (n, t, _) in enumerate(cases)], "name string, ticker string, i int")
    assert one(df.orderBy("i").select(classify.exclusion_reason("name", "ticker").alias("r")), "r") == [r for *_, r in cases]


def test_two_groups(spark):
    cases = [
        ("AGG", "iShares", "", False, classify.BOND, "high", "Bond ETF / bond index product", False),
        ("SPY", "SPDR 500", "", False, classify.EQUITY, "high", "Equity ETF / passive index product", False),
        ("X", "Total stock market fund", "", False, classify.EQUITY, "high", "Stock fund / equity index fund", False),
        ("X", "Short term fund", "", False, classify.BOND, "review", "Other money-related / fixed-income-like", False),
        ("X", "Plain fund", "", False, classify.EQUITY, "review", "Other equity fund-like holding", False),
        ("X", "Treasury deposit", "", True, classify.BOND, "high", "Cash / money market / liquidity", False),
        ("BRK.B", "Apple", None, True, classify.BOND, "review", "Other money-related / fixed-income-like", True),
        (None, None, None, None, classify.BOND, "review", "Other money-related / fixed-income-like", False),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, ticker string, name string, reason string, company boolean")
    got = classify.two_groups(df, "name", "ticker", "reason", "company").orderBy("i").select("category", "confidence", "subcategory", "stock_like").collect()
    assert [tuple(r) for r in got] == [c[4:] for c in cases]


def test_classified_items(spark):
    df = spark.createDataFrame([(" Bond ", " Note ", " N "), ("Bond", "Note", None), ("Bond", "", "N"), ("Bond", " ", ""), ("", "Note", "N"), (None, "Note", "N")], "category string, name string, ticker string")
    assert sorted(one(classify.classified_items(df, "category", "name", "ticker"), "item_label")) == ["N | N", "N | Note", "Note"]


def test_event_table(spark, tmp_path):
    rows = [("7.0", "2020-01-05", 3), ("8", "2020-01-06", 5), ("9", None, None), ("10.0", "2020-02-01", None)]
    spark.createDataFrame(rows, "id string, day string, training_window_years int").write.parquet(str(tmp_path / "old"))
    got = tables.event_table(spark, [str(tmp_path / "new"), str(tmp_path / "old")], ["id"], "day")
    assert sorted((r["id"], r["day"]) for r in got.collect()) == [("10", "2020-02-01"), ("7", "2020-01-05")]
    with pytest.raises(FileNotFoundError):
        tables.event_table(spark, [str(tmp_path / "new")], ["id"], "day")


def test_weighted_signal(spark):
    names = list(scores.SIGNAL)
    df = spark.createDataFrame([(0.1, *[1.0] * 7), (0.3, *[2.0] * 7), (-0.2, *[3.0] * 7), (None, *[99.0] * 7)], ", ".join(f"{c} double" for c in ["future", *names]))
    got = {r["future"]: r for r in scores.weighted_signal(df, "future").collect()}
    total = sum(scores.SIGNAL.values())
    assert set(got) == {0.1, 0.3, -0.2} and got[0.3]["signal"] == pytest.approx(0) and got[-0.2]["signal"] == pytest.approx(total)
    assert [got[k]["future_high_positive"] for k in (0.1, 0.3, -0.2)] == [False, True, False] and got[0.1]["future_positive"]
    flat = scores.weighted_signal(df.withColumn("flow", F.lit(None).cast("double")), "future").collect()
    assert {round(r["signal"], 9) for r in flat} == {0.0, round(total - 0.12, 9), round(0.12 - total, 9)}


def test_direction_candidates():
    assert [c for c in models.direction_candidates() if c.startswith("boosted")] == [f"boosted_{i}" for i in range(1, 7)]


def test_dictionary(spark):
    got = {r["name"]: tuple(r)[1:] for r in contract.dictionary(spark.createDataFrame([(1, None, 2.0, 3)], "portfolio int, bond double, ret_3m double, z int")).collect()}
    assert got == {"portfolio": ("identity", False, 1), "bond": ("feature", False, 0), "ret_3m": ("target", True, 1), "z": ("other", False, 1)}


def test_snapshot_diff_reads_positions_once(spark):
    """Against a plain version, with gaps, missing identities, weights, dates and portfolios; and without a join."""
    import random

    rng = random.Random(5)
    rows = {(p, d, i): rng.choice([None, 0.0, 10.0, 10.1, 30.0]) for p in (1, 2, None) for d in (None, 3, 5, 9, 12) for i in ("a", "b", "c", "d", None) if rng.random() < 0.6}
    df = spark.createDataFrame([(p, d, i, w) for (p, d, i), w in rows.items()], "portfolio int, report_dt int, identity string, pct double")
    want = []
    for p in (1, 2):
        dates = sorted({d for q, d, _ in rows if q == p and d is not None})
        for before, d in zip(dates, dates[1:], strict=False):
            for i in ("a", "b", "c", "d"):
                if (p, d, i) in rows or (p, before, i) in rows:
                    want.append((p, d, i, rows.get((p, d, i)), rows.get((p, before, i))))
            want += [(p, d, None, rows.get((p, d, None)), None)] * ((p, d, None) in rows) + [(p, d, None, None, rows.get((p, before, None)))] * ((p, before, None) in rows)
    plain = []
    for p, d, i, now, old in want:
        change = (now or 0) / 100 - (old or 0) / 100
        if abs(change) >= 0.002:
            plain.append((p, d, i, "new_position" if old is None else "exit" if now is None else "increase" if change > 0 else "decrease", round(change, 9)))
    out = holdings.snapshot_diff(df, split_exit=True)
    got = [(r.portfolio, r.report_dt, r.identity, r.action, round(r.change, 9)) for r in out.collect()]
    assert len(got) > 15 and sorted(got, key=str) == sorted(plain, key=str)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_as_text_is_made_once_for_each_key(spark):
    events = spark.createDataFrame([(f"e{i}", i, "mn"[i % 2]) for i in range(200)], "id string, p int, manager string")
    funds = spark.createDataFrame([("m", 7), ("m", 5), ("n", None)], "manager string, fund int")
    held = spark.createDataFrame([(1, "x", 2), (1, None, 1), (0, "y", 1)], "p int, name string, nth int")
    sources = {"funds": (funds, ["manager"], F.col("fund"), F.col("fund")), "held": (held, ["p", "manager"], F.col("nth"), F.col("name"))}
    sources["held"] = (held.withColumn("manager", F.when(F.col("p") == 1, "n").otherwise("m")), *sources["held"][1:])
    out = joins.event_evidence(events, "id", sources, records=False, separator=",")
    got = {r.id: tuple(r)[1:] for r in out.collect()}
    assert len(got) == 200 and got["e0"] == (2, "5,7", 1, "y") and got["e1"] == (1, "", 2, "x") and got["e2"] == (2, "5,7", 0, "")
    tasks = out.withColumn("task", F.spark_partition_id()).groupBy("funds_names").agg(F.collect_set("task").alias("t")).collect()
    assert all(len(r.t) <= 2 for r in tasks) and "transform" not in str(out._jdf.queryExecution().optimizedPlan().toString()).split("Join")[0]


def test_holdings_with_a_large_part_are_dealt_twice(spark, monkeypatch):
    """Lines, part and the lines with their part are dealt once each; missing parts and keys that occur twice give what the text of the view gives."""
    from fundtrace.plans import fixtures as fx

    lines = fx.view(spark, "/root/testdata/sf0.001", "fx_line")
    part = fx.view(spark, "/root/testdata/sf0.001", "part").where("p_partkey % 5 <> 0")
    twice = part.unionAll(part.where("p_partkey % 7 = 0").withColumn("p_brand", F.lit(None).cast("string")))
    key = lambda r: tuple(map(str, r))
    for given, exchanges in ((part, 3), (twice, 4)):
        want = sorted(map(key, spark.sql(fx.VIEWS["fx_holdings"], fx_line=lines, part=given).drop("security_rank").collect()))
        for most in (1_500_000, 0):
            monkeypatch.setattr(fx, "BROADCAST_PARTS", most)
            for by in (("portfolio", "report_dt"), ("portfolio",)):
                out = fx.holdings(lines, given, by=by)
                assert sorted(map(key, out.drop("security_rank").collect())) == want and len(want) > 1000
                if not most:
                    assert out._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == exchanges


def test_evidence_of_reports_and_actions_reads_one_shuffle(spark, monkeypatch):
    from fundtrace import plans
    from fundtrace.plans import fixtures as fx

    monkeypatch.setattr(fx, "BROADCAST_PARTS", 0)
    out = plans.queries()["j23_evidence_by_source"](spark, "/root/testdata/sf0.001")
    assert len(out.collect()) > 100
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    assert len([x for x in plan if "FileScan" in x and "l_extendedprice" in x]) == 1
