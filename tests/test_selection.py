"""Threshold and window choice, stability and drift references on hand-made rows."""

import math

import pytest

from fundtrace.operators import selection as sl


def sweep(spark, rows):
    return spark.createDataFrame([("a", *r) for r in rows], "k string, t int, tp long, fp long, pos long, neg long")


def test_safe_threshold_prefers_the_score_over_balanced_accuracy(spark):
    # at 30: recall 1, specificity 0.7, gap 0.15 -> 0.85 - 0.0375; at 50: 0.8, 0.9 -> 0.85, gap 0.05 - ...
    got = sl.safe_threshold(sweep(spark, [(30, 50, 15, 50, 50), (50, 40, 5, 50, 50), (90, 45, 5, 50, 50)]), ["k"]).first()
    assert (got.t, got.status, got.n_safe) == (50, "selected_safe_threshold", 2)
    assert got.score == pytest.approx(0.85 - 0.25 * 0.05)


def test_threshold_reasons_and_fallback(spark):
    rows = sweep(spark, [(10, 50, 50, 50, 50), (50, 0, 0, 50, 50), (60, 1, 0, 50, 50)])
    why = {r.t: r.reasons for r in sl.threshold_safety(rows).collect()}
    assert why[10] == ["outside_safe_threshold_range", "predicted_positive_rate_collapse", "positive_rate_gap_exceeded"]
    assert why[60] == ["predicted_positive_rate_collapse", "positive_rate_gap_exceeded"]
    got = sl.safe_threshold(rows, ["k"]).first()
    assert (got.t, got.status, got.n_safe) == (50, "fallback_no_eligible_threshold", 0)


FOLD = "w string, fold int, auc double, average_precision double, balanced double, brier double, spearman double, predicted_rate double, actual_rate double, warning boolean, failed boolean"


def folds(spark):
    return spark.createDataFrame([
        ("good", 1, 0.6, 0.5, 0.6, 0.2, 0.1, 0.5, 0.4, False, False), ("good", 2, 0.7, 0.5, 0.6, 0.3, 0.3, 0.5, 0.6, True, False),
        ("low", 1, 0.4, 0.5, 0.6, 0.2, None, 0.99, 0.4, False, True), ("low", 2, 0.9, 0.5, 0.6, 0.2, None, 0.97, 0.6, False, False),
        ("bare", 1, None, None, None, None, None, None, None, None, False),
    ], FOLD)


def test_window_score_and_reasons(spark):
    got = {r.w: r for r in sl.choose_window(sl.window_summary(folds(spark), ["w"], 2), "w", []).collect()}
    spread = math.sqrt(((0.6 - 0.65) ** 2 + (0.7 - 0.65) ** 2))
    assert got["good"].stability == pytest.approx(0.65 - 0.5 * spread + 0.3 * 0.6 - 0.3 * 0.25 + 0.1 * 0.2 + 0.1 * 0.1 - 0.5 * 0.1 - 0.2 * 0.5)
    assert got["good"].selected and got["good"].status == "stable_window_selected" and got["good"].reasons == []
    assert got["low"].reasons == ["unstable_below_random_auc", "class_collapse", "probability_rate_drift", "threshold_selection_failure"]
    assert got["low"].collapses == 2 and got["low"].below_random == pytest.approx(0.1)
    assert got["bare"].reasons == ["insufficient_valid_inner_folds", "missing_required_inner_validation_metrics"]
    assert got["bare"].stability == pytest.approx(-0.25) and got["bare"].place == 3


def test_window_choice_without_an_eligible_one(spark):
    only = sl.window_summary(folds(spark).where("w != 'good'"), ["w"], 2)
    assert [(r.w, r.status) for r in sl.choose_window(only, "w", []).where("selected").collect()] == [("low", "no_stable_window_found")]


def test_increment_and_stability(spark):
    full = spark.createDataFrame([("h", 1, 0.6), ("h", 2, 0.7), ("h", 3, None), ("g", 1, 0.6), ("g", 2, 0.5)], "k string, fold int, auc double")
    part = spark.createDataFrame([("h", 1, 0.5), ("h", 2, 0.5), ("h", 3, 0.5), ("g", 1, 0.5), ("g", 2, 0.6)], "k string, fold int, auc double")
    got = {r.k: (r.folds, r.positive, r.negative, r.status) for r in sl.incremental_value(full, part, "fold", ["k"]).collect()}
    assert got == {"h": (2, 2, 0, "consistent_positive"), "g": (2, 1, 1, "regime_dependent")}
    d = spark.createDataFrame([("a", 0.1, -0.1), ("a", 0.1, 0.0), ("a", -0.01, 0.0), ("b", 0.3, -0.1), ("b", 0.3, -0.1), ("b", -0.02, 0.0), ("c", 0.1, 0.1), ("d", None, None)], "g string, delta_auc double, delta_brier double")
    assert {r.g: r.status for r in sl.group_stability(d, "g").collect()} == {"a": "selected", "b": "excluded_unstable", "c": "excluded_unstable", "d": "missing_group_features"}


def test_drift_reference_with_ties_nulls_and_constants(spark):
    df = spark.createDataFrame([(float(i), 1.0, None) for i in range(1, 11)] + [(None, 1.0, None)], "a double, b double, c double")
    got = {r.feature: r for r in sl.drift_reference(df, ["a", "b", "c"]).collect()}
    assert got["a"].edges == pytest.approx([1.9, 2.8, 3.7, 4.6, 5.5, 6.4, 7.3, 8.2, 9.1]) and got["a"].shares == pytest.approx([0.1] * 10)
    assert got["a"].missing_rate == pytest.approx(1 / 11) and (got["a"].low, got["a"].high) == (1.0, 10.0)
    assert got["b"].edges == [] and got["b"].shares == [] and got["b"].missing_rate == 0
    assert got["c"].low is None and got["c"].shares == [] and got["c"].missing_rate == 1


def test_consistency_finds_breaches(spark):
    s = sl.choose_window(sl.window_summary(folds(spark), ["w"], 2), "w", [])
    t = spark.createDataFrame([(50,), (None,)], "t int")
    ref = spark.createDataFrame([("a", 0.0, 1.0, 2.0, 3.0, 4.0), ("b", 0.0, 3.0, 2.0, 3.0, 4.0)], "feature string, low double, p01 double, p50 double, p99 double, high double")
    got = {r.check: r.broken for r in sl.consistency(s, t, ref, ["a", "b", "z"]).collect()}
    assert got == {"quantiles_missing": 1, "quantiles_out_of_order": 1, "selected_window_not_best": 0, "threshold_invalid": 1, "orientation_reversed": 0}
