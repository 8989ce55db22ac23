"""Rules that label rows: actions, outcomes, regimes, styles, flags. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def market_regime(rate: Column, market: Column) -> Column:
    """Rate bucket (percent) and market bucket (trailing return)."""
    by_rate = F.when(rate.isNull(), "unknown_rate").when(rate >= 4.0, "high_rate").when(rate <= 2.0, "low_rate").otherwise("mid_rate")
    by_market = F.when(market.isNull(), "unknown_market").when(market >= 0.08, "strong_equity_market").when(market <= 0.0, "weak_equity_market").otherwise("moderate_equity_market")
    return F.concat_ws("__", by_rate, by_market)


#: The five manager styles.
STYLES = ("Defensive / risk-control style", "High-return / high-flow style", "Equity-tilted / growth style", "Flow-supported core style", "Balanced core style")


def style_label(defensive: Column, flow: Column, growth: Column) -> Column:
    """First style whose scores pass its bars; a missing score passes none."""
    grows = growth >= 0.66
    return (
        F.when((defensive >= 0.66) & (growth < 0.66), STYLES[0]).when(grows & (flow >= 0.55), STYLES[1]).when(grows, STYLES[2])
        .when(flow >= 0.66, STYLES[3]).otherwise(STYLES[4])
    )


#: What a report did, in order of precedence, and how it was carried out.
ACTIONS = {
    "increase_equity_plus_technology": "direct_equity_growth_tilt",
    "increase_stock_allocation": "direct_equity_risk_on",
    "reduce_stock_increase_bond_money": "risk_off_bond_money_rotation",
    "reduce_portfolio_beta": "beta_reduction_defensive",
    "increase_technology_exposure": "sector_rotation_technology",
    "increase_bond_money_exposure": "bond_money_defensive_execution",
    "increase_indirect_equity_exposure": "indirect_equity_execution",
    "minor_allocation_rotation": "minor_cross_asset_rotation",
    "stable_or_no_clear_action": "stable_or_minor_rebalance",
}


def action_type(stock: Column, beta: Column, technology: Column, bond_money: Column, indirect: Column) -> Column:
    """The first action whose changes reach their thresholds (stock 0.03, beta 0.05, exposures 0.01); missing ones reach none."""
    bars = [
        (stock >= 0.03) & (technology >= 0.01), stock >= 0.03, (stock <= -0.03) & (bond_money >= 0.01), beta <= -0.05, technology >= 0.01, bond_money >= 0.01, indirect >= 0.01,
        action_strength(stock, beta, technology, bond_money, indirect) >= 0.01,
    ]
    *named, quiet = ACTIONS
    return F.coalesce(*[F.when(bar, F.lit(name)) for bar, name in zip(bars, named, strict=True)], F.lit(quiet))


def execution_type(action: Column) -> Column:
    """How an action was carried out."""
    return F.coalesce(*[F.when(action == a, F.lit(e)) for a, e in ACTIONS.items()])


def action_strength(*deltas: Column) -> Column:
    """Largest absolute change; nulls are left out."""
    return F.greatest(*[F.abs(d) for d in deltas])


def outcome_label(excess: Column, drawdown: Column) -> Column:
    """Outcome; a deep fall is told apart only where the excess is positive."""
    return (
        F.when(excess.isNull(), "missing_future_outcome").when((excess > 0) & (drawdown <= -0.20), "positive_excess_high_drawdown")
        .when(excess > 0, "positive_excess").when(excess < 0, "negative_excess").otherwise("neutral")
    )


def direction(excess: Column, band: float = 0.005) -> Column:
    """1, 0 or -1 with a neutral band whose lower bound counts as down."""
    return F.when(excess > 0, F.when(excess >= band, 1).otherwise(0)).when(excess <= -band, -1).when(excess.isNotNull(), 0)


def five_classes(excess: Column, band: float = 0.005, large: float = 0.03) -> Column:
    return F.when(excess >= large, "large_win").when(excess >= band, "small_win").when(excess <= -large, "large_loss").when(excess < -band, "small_loss").when(excess.isNotNull(), "neutral")


def label_window(date: Column, horizon: int) -> tuple[Column, Column]:
    """First day after the event's month and last day of the horizon."""
    start = F.add_months(F.trunc(date, "MM"), 1)
    return start, F.date_sub(F.add_months(start, horizon), 1)


def quality_flags(flags: dict[str, Column]) -> Column:
    """Names of the flags that hold, joined by semicolons, or ok."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))
    return F.when(F.size(found) == 0, "ok").otherwise(F.array_join(found, ";"))


def prediction_class(p: Column, expected: Column, large: Column, low: float = 0.4, high: float = 0.6, band: float = 0.005) -> Column:
    """Neutral if the probability is within [low, high] or the expected excess within the band, else win or loss by size; unknown without both."""
    size = F.when(F.abs(expected) >= large, "large").otherwise("small")
    side = F.when(expected > 0, "win").otherwise("loss")
    return F.when(p.isNull() | expected.isNull(), "unknown").when(((p >= low) & (p <= high)) | (F.abs(expected) < band), "neutral").otherwise(F.concat_ws("_", size, side))


def actual_class(excess: Column, large: Column, band: float = 0.005) -> Column:
    """Class of what came, at the size that counts as large."""
    size = F.when(F.abs(excess) >= large, "large").otherwise("small")
    return F.when(excess.isNull(), "unknown").when(F.abs(excess) < band, "neutral").otherwise(F.concat_ws("_", size, F.when(excess > 0, "win").otherwise("loss")))


def cluster_name(top_features: Column) -> Column:
    """Name of a cluster by the first theme that its top features (an array of names) speak of."""
    text = F.lower(F.array_join(top_features, " "))
    return (
        F.when(text.contains("technology"), "Technology Allocation Logic").when(text.rlike("turn|rotation|action_strength"), "High-Rotation Direction Logic")
        .when(text.rlike("bond|cash|defensive"), "Cross-Asset Defensive Direction Logic").when(text.contains("style_deviation"), "Style-Drift Direction Logic")
        .when(text.contains("flow"), "Flow-Sensitive Direction Logic").otherwise("Mixed Direction Logic")
    )


def readiness(warnings: Column, hard: list[str]) -> Column:
    """blocked if a hard warning is there, review if any, else ready."""
    return F.when(F.arrays_overlap(warnings, F.array(*map(F.lit, hard))), "blocked").when(F.size(warnings) > 0, "review").otherwise("ready")


#: Warnings that reject a case, and its three states of readiness.
HARD_WARNINGS = ("missing_event_id", "missing_report_date", "feature_available_after_event_anchor", "style_window_not_strictly_ex_ante", "dataset_availability_check_failed")
CASE_READINESS = ("reject_until_temporal_or_identity_issue_is_fixed", "ready_for_critic_with_explicit_data_warnings", "ready_for_reliability_aware_critic")


def case_warnings(event_id: Column, report: Column, available: Column, style_end: Column, check: Column, history: Column, observations: Column) -> Column:
    """What speaks against the dates and the history of a case, in order. ``check`` and ``history`` are booleans, ``observations`` text or a number."""
    seen = observations.cast("string")
    n = F.when(seen.isNull() | (seen == ""), 0.0).otherwise(seen.try_cast("double"))
    return F.array_compact(F.array(
        F.when(F.coalesce(event_id.cast("string"), F.lit("")) == "", F.lit("missing_event_id")),
        F.when(report.isNull(), F.lit("missing_report_date")),
        F.when(available.isNull(), F.lit("missing_feature_available_at")).when(available > report, F.lit("feature_available_after_event_anchor")),
        F.when(style_end.isNull(), F.lit("missing_style_window_end")).when(style_end >= report, F.lit("style_window_not_strictly_ex_ante")),
        F.when(check.isNull(), F.lit("dataset_availability_check_unverified")).when(~check, F.lit("dataset_availability_check_failed")),
        F.when(~F.coalesce(history, F.lit(False)), F.lit("manager_history_unavailable_or_unverified")),
        F.when(n.isNull(), F.lit("style_observation_count_invalid")).when(n <= 0, F.lit("style_baseline_has_no_observations")),
    ))


def temporal_status(warnings: Column) -> Column:
    """failed with a hard warning, unverified if a warning speaks of something missing or unverified, else passed."""
    open_ = F.exists(warnings, lambda w: w.contains("unverified") | w.contains("missing"))
    return F.when(F.arrays_overlap(warnings, F.array(*map(F.lit, HARD_WARNINGS))), "failed").when(open_, "unverified").otherwise("passed")


def case_readiness(warnings: Column) -> Column:
    """What a reader may do with a case that has these warnings."""
    hard = F.arrays_overlap(warnings, F.array(*map(F.lit, HARD_WARNINGS)))
    return F.when(hard, CASE_READINESS[0]).when(F.size(warnings) > 0, CASE_READINESS[1]).otherwise(CASE_READINESS[2])


def outcome_bucket(future: Column) -> Column:
    """good above 0, bad otherwise, unknown if missing or not finite."""
    finite = future.isNotNull() & ~F.isnan(future) & (F.abs(future) < float("inf"))
    return F.when(~finite, "unknown").when(future > 0, "good").otherwise("bad")


def outcome_text(future: Column) -> Column:
    """The outcome of twelve months in words."""
    words = {"good": "Good: future 12M positive excess", "bad": "Bad: future 12M negative excess", "unknown": "Outcome unknown"}
    return F.coalesce(*[F.when(outcome_bucket(future) == k, F.lit(w)) for k, w in words.items()])
