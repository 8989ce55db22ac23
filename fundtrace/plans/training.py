"""Queries of nested training: three-month outcomes of actions, judged over folds and training windows.

No SQL can say what a fitted model predicts; tests hold every choice made over the predictions against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundtrace.operators import evaluation as ev
from fundtrace.operators import selection as sl
from fundtrace.operators import training as tr
from fundtrace.plans.fixtures import ACTIONS
from fundtrace.plans.registry import Views, query

LAYERS = {
    "market": ["market", "yield10"],
    "action_deltas": ["d_stock", "d_bond_money", "d_beta"],
    "holdings": ["tech", "beta"],
    "costs": ["exp_ratio", "turn_ratio"],
}
FEATURES = [c for cs in LAYERS.values() for c in cs]
#: Classifiers that the queries fit, each weighted and not; the operator takes all of them.
CANDIDATES = ("logistic", "boosted_1", "boosted_5")


def training_rows(v: Views) -> DataFrame:
    """Events with their three-month excess return, its direction outside the neutral band, and the last day of the label."""
    if "training_rows" in v.kept:
        return v.kept["training_rows"]
    v.keep(*ACTIONS)
    excess = F.col("excess3")
    direction = F.when(excess > tr.NEUTRAL, 1).when(excess < -tr.NEUTRAL, -1).otherwise(0)
    rows = v.fx_actions.drop("excess").join(v.fx_excess3, ["portfolio", "report_dt"])
    rows = rows.select(F.concat_ws("_", "portfolio", "report_dt").alias("event_id"), "report_dt", F.last_day(F.add_months("report_dt", 3)).alias("label_end"), direction.alias("direction"), excess.alias("excess"), *FEATURES)
    v.kept["training_rows"] = tr.written(rows, "training_rows")
    return v.kept["training_rows"]


def _trained(v: Views, candidates: tuple[str, ...] = CANDIDATES, sizes: bool = True) -> tuple[tr.Trained, DataFrame]:
    run = tr.train_nested(training_rows(v), FEATURES, candidates=candidates, sizes=sizes)
    return run, tr.choose_candidates(run.scores, tr.choose_calibrations(run.scores))


def predictions(v: Views, candidates: tuple[str, ...] = CANDIDATES) -> DataFrame:
    run, chosen = _trained(v, candidates)
    return tr.out_of_fold(run, chosen, tr.choose_sizes(run.sizes))


@query("m06_candidate_choice")
def candidate_choice(v: Views):
    return _trained(v, sizes=False)[1].select(*tr.GROUP, "candidate", "method", "t", "balanced", "gap", "brier", "auc", "average_precision", "candidate_score", "eligible", "place", "choice")


@query("m06_out_of_fold")
def out_of_fold(v: Views):
    return predictions(v)


@query("m07_calibration")
def calibration(v: Views):
    run = tr.train_nested(training_rows(v), FEATURES, candidates=("logistic",), sizes=False)
    return tr.choose_calibrations(run.scores).select(*tr.GROUP, "candidate", "method", "t", "balanced", "gap", "brier", "choice_score", "eligible", "place")


@query("m12_magnitude_models")
def magnitude_models(v: Views):
    return tr.choose_sizes(tr.train_nested(training_rows(v), FEATURES, candidates=()).sizes)


@query("m14_baselines")
def baselines(v: Views):
    only = {"market_only": ["market"], "manager_action_only": ["action_deltas", "holdings"]}
    scores = tr.written(tr.baselines(training_rows(v), LAYERS, only), "baselines")
    by = ["fold", "baseline"]
    return ev.direction_metrics(scores, "y", "p", by, 0.5).join(ev.roc_auc(scores, "y", "p", by), by, "left")


@query("m15_permutation_importance")
def permutation_importance(v: Views):
    run = tr.train_nested(training_rows(v), FEATURES, candidates=("logistic",), windows=(None,), folds=2, sizes=False)
    return tr.permutation_importance(run, tr.choose_candidates(run.scores, tr.choose_calibrations(run.scores)), FEATURES)


@query("m29_trained_reliability")
def trained_reliability(v: Views):
    """Which training window fitted models do best with, its outer tests, and what actions add to it."""
    made = tr.written(predictions(v, ("logistic",)), "predictions")
    inner, outer = tr.fold_figures(made, "validation"), tr.fold_figures(made, "test")
    chosen = sl.choose_window(sl.window_summary(inner, ["window_years"], 3), "window_years", [])
    market = ev.roc_auc(tr.baselines(training_rows(v), {"market": LAYERS["market"]}, {}).where("baseline = 'logistic_full'"), "y", "p", ["fold"])
    added = sl.incremental_value(outer.select(*tr.GROUP, "auc"), outer.select(*tr.GROUP).join(market, "fold"), "fold", ["window_years"])
    tested = sl.outer_summary(outer, ["window_years"])
    return sl.reliability(chosen, tested, added, ["window_years"])
