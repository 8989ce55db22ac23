"""Filters, eligibility and case rules, by cases written by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fundtrace.functions import labels as lb
from fundtrace.operators import filters as fl

DAY = dt.date


def test_net_flow_counts_missing_parts_as_nothing(spark):
    rows = spark.createDataFrame([(1, 5.0, None, 2.0, 3.0), (2, None, None, None, None), (3, float("nan"), 1.0, 1.0, 4.0)], "i int, new_sls double, rein_sls double, oth_sls double, redemp double")
    assert [r[1] for r in rows.select("i", fl.net_flow(rows)).orderBy("i").collect()] == [4.0, 0.0, -2.0]
    given = spark.createDataFrame([(1, 7.5), (2, None)], "i int, net_flow double")
    assert [r[1] for r in given.select("i", fl.net_flow(given)).orderBy("i").collect()] == [7.5, None]
    assert given.drop("net_flow").select(fl.net_flow(given.drop("net_flow"))).first()[0] is None


def test_reports_by_labels_and_managers_in_order(spark):
    rows = spark.createDataFrame([(3, "a", DAY(1998, 8, 1)), (1, "b", DAY(1998, 7, 1)), (2, "a", DAY(1998, 7, 1)), (4, "a", DAY(1999, 1, 1)), (5, None, DAY(1998, 9, 1)), (6, "a", None)], "i int, manager string, d date")
    who = spark.createDataFrame([("a",), ("a",), (None,)], "manager string")
    ids = lambda df: [r.i for r in df.select("i").collect()]
    assert ids(fl.report_filter(rows, "d", ["i"], brushed=("1998 Q3",), mode="quarter")) == [1, 2, 3, 5]
    assert ids(fl.report_filter(rows, "d", ["i"], who, focus="1998")) == [2, 3]
    assert ids(fl.report_filter(rows.where("false"), "d", ["i"], who, focus="1998")) == []


def test_holdings_by_rank_and_words(spark):
    rows = [(1, 10, DAY(1998, 1, 1), 1, "Ring", None), (2, 9, DAY(1998, 1, 1), 3, "ring", "x"), (3, 10, DAY(1999, 1, 1), None, "RING", "x"), (4, 10, DAY(1998, 1, 1), 0, "a ring", None), (5, 10, DAY(1998, 1, 1), 2, None, "ear ring x")]
    df = spark.createDataFrame(rows, "i int, port int, d date, k int, name string, kind string")
    got = lambda *a, **k: [r.i for r in fl.holding_filter(df, "d", "port", "k", ["port", "name", "kind"], *a, **k).select("i").collect()]
    assert got() == [3, 1, 5, 4, 2]  # newest first, portfolio as text, a missing rank or 0 last
    assert got(2) == [1, 5] and got(None, " RING X ") == [3, 5, 2] and got(3, "10 ring ") == [1]
    assert got(3, "%") == [] and got(focus="1999") == [3]


def test_products_and_model_rows(spark):
    df = spark.createDataFrame([(1, 2.0, "3", None, 1.0), (2, None, "x", 0.1, None), (3, None, None, 0.2, 0.5)], "i int, a double, b string, y double, z double")
    out = {r.i: (r.ab, r.ac) for r in fl.interactions(df, {"ab": ("a", "b"), "ac": ("a", "c")}).collect()}
    assert out == {1: (6.0, None), 2: (None, None), 3: (None, None)}
    roles = {"identity": ["i"], "feature": ["a", "q"], "target": ["y", "z"]}
    t = fl.model_table(df, roles, ["y", "z", "absent"], ["a", "absent"])
    assert t.columns == ["i", "a", "y", "z"] and [r.i for r in t.collect()] == [1]
    assert sorted(r.i for r in fl.model_table(df, roles, ["y", "z"], ["absent"]).collect()) == [1, 2, 3]


def test_horizon_rows_need_label_target_and_dates(spark):
    rows = [(1, "2000-01-31", "0.1", 1, "2001-01-31", "True"), (2, "2000-01-31", "0.1", 1, "2001-01-31", "0"), (3, None, "0.1", 1, "2001-01-31", "1"), (4, "2000-01-31", "nan", 1, "2001-01-31", "1"), (5, "2000-01-31", "0.2", None, None, "1"), (6, "2000-01-31", "0.2", None, "2001-01-31", None)]
    df = spark.createDataFrame(rows, "i int, d string, t string, s int, e string, ok string")
    ids = lambda x: sorted(r.i for r in x.collect())
    assert ids(fl.horizon_slice(df, "d", "t", "s", "e", "ok")) == [1]
    assert ids(fl.horizon_slice(df, "d", "t", "s", "e")) == [1, 2, 6]
    with pytest.raises(ValueError, match="absent"):
        fl.horizon_slice(df, "d", "absent", "s", "e")


def test_schema_issues(spark):
    df = spark.createDataFrame([("a", 1.0, None, "7", 1.0)] * 3, "words string, x double, none double, digits string, label_x double")
    got = {(r.issue, r.feature) for r in fl.schema_issues(df, ["words", "x", "none", "digits", "gone"], ["label_x"]).collect()}
    assert got == {("missing", "gone"), ("forbidden", "label_x"), ("all_null", "words"), ("non_numeric", "words"), ("all_null", "none")}
    assert {(r.issue, r.feature) for r in fl.schema_issues(df, ["gone"], []).collect()} == {("missing", "gone")}


def test_case_warnings_status_and_readiness(spark):
    d, before = DAY(2000, 6, 30), DAY(2000, 3, 31)
    rows = [
        (1, "e", d, before, before, True, True, "5"), (2, "", d, before, before, True, True, "5"), (3, "e", None, before, before, True, True, "5"), (4, "e", d, DAY(2000, 7, 1), before, True, True, "5"),
        (5, "e", d, None, None, None, None, None), (6, "e", d, d, before, True, True, "0"), (7, "e", d, before, d, False, True, "x"), (8, "e", d, before, before, True, True, "x"),
    ]
    df = spark.createDataFrame(rows, "i int, id string, d date, a date, s date, ok boolean, h boolean, n string")
    w = lb.case_warnings(*[F.col(c) for c in ("id", "d", "a", "s", "ok", "h", "n")])
    got = {r.i: (r.w, r.t, r.r.split("_")[0] + "_" + r.r.split("_")[2]) for r in df.withColumn("w", w).select("i", "w", lb.temporal_status(F.col("w")).alias("t"), lb.case_readiness(F.col("w")).alias("r")).collect()}
    assert got[1] == ([], "passed", "ready_reliability")
    assert got[2] == (["missing_event_id"], "failed", "reject_temporal") and got[3] == (["missing_report_date"], "failed", "reject_temporal")
    assert got[4] == (["feature_available_after_event_anchor"], "failed", "reject_temporal")
    assert got[5] == (["missing_feature_available_at", "missing_style_window_end", "dataset_availability_check_unverified", "manager_history_unavailable_or_unverified", "style_baseline_has_no_observations"], "unverified", "ready_critic")
    assert got[6] == (["style_baseline_has_no_observations"], "passed", "ready_critic")
    assert got[7] == (["style_window_not_strictly_ex_ante", "dataset_availability_check_failed", "style_observation_count_invalid"], "failed", "reject_temporal")
    assert got[8] == (["style_observation_count_invalid"], "passed", "ready_critic")


def test_audit_of_leaks(spark):
    d, before = DAY(2000, 6, 30), DAY(2000, 3, 31)
    rows = [(1, d, before, before, before, True), (2, d, d, before, before, True), (3, d, before, d, before, True), (4, d, before, before, d, True), (5, d, before, before, None, False), (6, d, before, before, None, True), (7, d, None, before, before, True), (8, d, before, before, None, None)]
    out = fl.leakage_audit(spark.createDataFrame(rows, "i int, d date, a date, s date, m date, h boolean"), "d", "a", "s", "m", "h")
    assert sorted(r.i for r in out.where("leakage_check_passed").collect()) == [1, 5, 8]


def test_actions_meet_one_prediction(spark):
    actions = spark.createDataFrame([(1, "7.0", DAY(2000, 1, 1), -2.0), (2, "7", DAY(2000, 1, 1), 1.0), (3, "8", DAY(2000, 1, 1), 9.0), (4, None, DAY(2000, 1, 1), None)], "i int, port string, d date, delta double")
    predictions = spark.createDataFrame([(7, DAY(2000, 1, 1), 0.4, 0.1), (7, DAY(2000, 1, 1), 0.6, -0.1), (8, DAY(2000, 2, 1), 0.9, 0.1)], "port int, d date, p double, future double")
    got = [(r.i, r.p, r.result_bucket, r.outcome_text) for r in fl.actions_with_predictions(actions, predictions, "port", "d", "future", "p", "delta", ["i"]).collect()]
    assert got == [(1, 0.6, "bad", "Bad: future 12M negative excess"), (2, 0.6, "bad", "Bad: future 12M negative excess"), (3, None, "unknown", "Outcome unknown"), (4, None, "unknown", "Outcome unknown")]


def test_themes(spark):
    rows = [(1, "Bond / Credit", "AGG", None, "x", 5), (2, "Bond / Credit", None, "us treasury note", "x", 9), (3, "Equity", "SPY", "spdr", "x", None), (4, "Equity", "AGG", "agg", "y", 1), (5, "Bond", "ZZ", "plain", None, 1)]
    df = spark.createDataFrame(rows, "i int, c string, ticker string, name string, sub string, n int")
    got = lambda t: [r.i for r in fl.thematic(df, t, "c", ["ticker", "name", "sub"], "n").collect()]
    assert got("rate") == [2, 1] and got("equity") == [3]


def test_regimes_take_bars_from_training_rows(spark):
    train = spark.createDataFrame([(float(i), 0.0) for i in range(11)], "rate_level double, market_return double")  # median 5
    rows = [(4.9 + 0.2 * (i % 2), 1.0 if i % 3 else -1.0, 1 if i % 4 < 2 else -1, 0.9 if i % 4 < 2 else 0.1, 0.05 if i % 4 < 2 else -0.05, 0.02) for i in range(200)] + [(9.0, 1.0, 0, 0.5, 0.0, 0.0)] * 60 + [(None, -1.0, 1, 0.5, 0.01, 0.0)]
    test = spark.createDataFrame(rows, "rate_level double, market_return double, dir int, p double, excess double, expected double")
    got = {r.regime: r for r in fl.regime_metrics(train, test, "dir", "p", "excess", "expected", 0.5).collect()}
    assert sorted(got) == ["bear_trend", "bull_trend", "high_rate"]
    assert got["high_rate"].n == 100 and got["high_rate"].positives == 50 and got["high_rate"].auc == 1.0 and got["high_rate"].balanced_accuracy == 1.0 and got["high_rate"].hit_rate == 0.5
    assert got["bear_trend"].n == 68 and got["bull_trend"].n == 133
    few = {r.regime: r for r in fl.regime_metrics(train, test.where("dir >= 0"), "dir", "p", "excess", "expected", 0.5).collect()}
    assert few["high_rate"].status == "insufficient_support" and few["high_rate"].positive_rate == 1.0 and few["high_rate"].auc is None


def test_fund_panel_keeps_months_of_the_objective(spark):
    from fundtrace.operators import joins as j

    d = lambda y, m: DAY(y, m, 28)
    make = spark.createDataFrame
    tables = {
        "returns": make([(1, d(2000, 1), 0.1), (1, d(2000, 2), 0.2), (1, d(1999, 1), 0.3), (2, d(2000, 1), 0.4), (3, d(2000, 1), 0.5), (4, d(2000, 1), 0.6)], "fund int, caldt date, mret double"),
        "nav": make([(1, d(2000, 1), 10.0)], "fund int, caldt date, mnav double"),
        "tna": make([(1, d(2000, 2), 99.0)], "fund int, caldt date, mtna double"),
        "header": make([(1, 7), (2, 8)], "fund int, portfolio int"),
        "fees": make([(1, d(1998, 1), d(2000, 1), 0.01), (1, DAY(2000, 1, 29), None, 0.02)], "fund int, begdt date, enddt date, fee double"),
        "style": make([(1, d(1990, 1), None, "B ", None), (2, d(1990, 1), DAY(2000, 1, 27), "B", "Balanced"), (3, d(1990, 1), None, None, " Balanced "), (4, d(1990, 1), None, "G", "Growth")], "fund int, begdt date, enddt date, objective_code string, objective_name string"),
        "flows": make([(7, DAY(2000, 1, 3), 5.0), (7, DAY(1999, 12, 31), 6.0)], "portfolio int, trans_dt date, flow double"),
        "dividends": make([(1, d(2000, 2), 1.0), (1, d(2000, 2), 2.0)], "fund int, caldt date, paid double"),
    }
    got = sorted((r.fund, r.caldt.month, r.mnav, r.mtna, r.portfolio, r.fee, r.flow, r.paid) for r in j.fund_panel(tables, (2000, 2001)).collect())
    assert got == [(1, 1, 10.0, None, 7, 0.01, 5.0, None), (1, 2, None, 99.0, 7, 0.02, None, 1.0), (1, 2, None, 99.0, 7, 0.02, None, 2.0), (3, 1, None, None, None, None, None, None)]
