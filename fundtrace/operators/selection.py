"""Choice of thresholds and training windows from evaluation tables, and how stable features are over folds.

All inputs are tables with a row for each fold, threshold or feature, however large the data that they sum up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fundtrace.operators.scores import percentiles_all, percentiles_by

#: Fixed values of the safety rules: thresholds in hundredths, predicted rates, gap of rates, weight of the gap.
SAFE_THRESHOLDS, SAFE_RATES, MOST_GAP, GAP_WEIGHT = (20, 80), (0.02, 0.98), 0.2, 0.25
#: Fixed values of the window rules: least area, rates of a collapse and of a warning, most mean gap.
LEAST_AUC, COLLAPSED, NARROW, MOST_MEAN_GAP = 0.48, (0.02, 0.98), (0.05, 0.95), 0.25
#: What each figure of a window adds to its score.
SCORE_WEIGHTS = {
    "auc_mean": 1.0, "auc_spread": -0.5, "auc_worst": 0.3, "brier_mean": -0.3, "spearman_mean": 0.1, "spearman_worst": 0.1,
    "mean_gap": -0.5, "collapses": -0.15, "warning_share": -0.2, "below_random": -0.5,
}


def _reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))


def threshold_safety(sweep: DataFrame) -> DataFrame:
    """Add to a threshold sweep (t, tp, fp, pos, neg) the rates, the score and why a threshold is not safe."""
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    n = F.col("pos") + F.col("neg")
    out = sweep.withColumns({"recall": share("tp", "pos"), "false_rate": share("fp", "neg"), "predicted_rate": (F.col("tp") + F.col("fp")) / n, "actual_rate": F.col("pos") / n})
    specificity = F.when(F.col("neg") > 0, 1 - F.col("false_rate")).otherwise(0.0)
    out = out.withColumns({"balanced": (F.col("recall") + specificity) / 2, "gap": F.round(F.abs(F.col("predicted_rate") - F.col("actual_rate")), 12)})
    return out.withColumns({
        "score": F.col("balanced") - GAP_WEIGHT * F.col("gap"),
        "reasons": _reasons({
            "outside_safe_threshold_range": ~F.col("t").between(*SAFE_THRESHOLDS),
            "predicted_positive_rate_collapse": ~F.col("predicted_rate").between(*SAFE_RATES),
            "positive_rate_gap_exceeded": F.col("gap") > MOST_GAP,
        }),
    })


def safe_threshold(sweep: DataFrame, by: list[str]) -> DataFrame:
    """The safe threshold of highest score; ties to higher balanced accuracy, smaller gap, nearer to a half, fewer false
    positives, the lower. Without a safe one it is a half, with the status of a fallback. A row for each ``by``."""
    rows = threshold_safety(sweep).withColumn("safe", F.size("reasons") == 0)
    low = lambda c: F.round(F.negative(F.col(c)), 9)
    order = F.struct((~F.col("safe")).cast("int"), F.when(F.col("safe"), low("score")), F.when(F.col("safe"), low("balanced")), F.when(F.col("safe"), F.round("gap", 9)), F.abs(F.col("t") - 50), F.round("false_rate", 9), "t")
    best = rows.groupBy(*by).agg(F.min_by(F.struct("t", "safe", "balanced", "gap", "score", "predicted_rate", "actual_rate"), order).alias("b"), F.count_if("safe").alias("n_safe"))
    return best.select(*by, "b.t", F.when(F.col("b.safe"), "selected_safe_threshold").otherwise("fallback_no_eligible_threshold").alias("status"), "n_safe", *[f"b.{c}" for c in ("balanced", "gap", "score", "predicted_rate", "actual_rate")])


def _spread(c: str) -> Column:
    """Sample deviation; 0 for a single value, null for none."""
    return F.when(F.count(c) == 1, 0.0).otherwise(F.stddev_samp(c))


def window_summary(folds: DataFrame, by: list[str], required: int) -> DataFrame:
    """Figures of each training window over its validation folds, its score, and why it is not eligible.

    ``folds`` has a row for each window and fold: auc, average_precision, balanced, brier, spearman, predicted_rate,
    actual_rate, warning (calibration) and failed (no safe threshold).
    """
    rate, gap = F.col("predicted_rate"), F.col("predicted_rate") - F.col("actual_rate")
    figures = [f(c).alias(f"{c}_{n}") for c in ("auc", "average_precision", "balanced", "spearman") for n, f in (("mean", F.avg), ("spread", _spread), ("worst", F.min))]
    s = folds.groupBy(*by).agg(
        F.count("*").alias("folds"), *figures, F.avg("brier").alias("brier_mean"), _spread("brier").alias("brier_spread"), F.max("brier").alias("brier_worst"),
        F.avg(F.abs(gap)).alias("mean_gap"), F.count_if(~rate.between(*NARROW)).alias("collapses"), F.count_if(~rate.between(*COLLAPSED)).alias("_collapsed"),
        F.avg(F.coalesce(F.col("warning"), F.lit(False)).cast("double")).alias("warning_share"), F.count_if("failed").alias("failures"),
    )
    s = s.withColumn("below_random", F.when(F.col("auc_worst").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 0.5 - F.col("auc_worst"))))
    s = s.withColumn("stability", sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in SCORE_WEIGHTS.items()), F.lit(0.0)))
    return s.withColumn("reasons", _reasons({
        "unstable_below_random_auc": F.col("auc_worst") < LEAST_AUC,
        "class_collapse": F.col("_collapsed") > 0,
        "probability_rate_drift": F.col("mean_gap") > MOST_MEAN_GAP,
        "threshold_selection_failure": F.col("failures") > 0,
        "insufficient_valid_inner_folds": F.col("folds") < required,
        "missing_required_inner_validation_metrics": F.col("auc_mean").isNull() | F.col("brier_mean").isNull(),
    })).withColumn("eligible", F.size("reasons") == 0).drop("_collapsed")


def choose_window(summary: DataFrame, window: str, by: list[str]) -> DataFrame:
    """Rank of each window by score (ties to the smaller name) and the chosen one: the best eligible, else the best of all."""
    score = F.desc(F.round("stability", 9))
    ranked = summary.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(score, window)))  # a row for each window
    first = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("eligible"), score, window)) == 1
    status = F.when(~first, "not_selected").when(F.col("eligible"), "stable_window_selected").otherwise("no_stable_window_found")
    return ranked.withColumn("selected", first).withColumn("status", status)


def outer_summary(folds: DataFrame, by: list[str]) -> DataFrame:
    """Means, spread and worst values over outer tests, which take no part in any choice."""
    gap = F.col("predicted_rate") - F.col("actual_rate")
    return folds.groupBy(*by).agg(
        F.count("*").alias("folds"), F.avg("auc").alias("auc_mean"), _spread("auc").alias("auc_spread"), F.min("auc").alias("auc_worst"), F.avg("balanced").alias("balanced_mean"), F.min("balanced").alias("balanced_worst"),
        F.avg("brier").alias("brier_mean"), F.avg("spearman").alias("spearman_mean"), F.min("spearman").alias("spearman_worst"), F.avg(gap).alias("gap_mean"), F.count_if("warning").alias("warnings"),
    )


def incremental_value(full: DataFrame, partial: DataFrame, fold: str, by: list[str]) -> DataFrame:
    """What the full model adds in area over a partial one on the folds that both have, and whether it always does."""
    both = full.select(*by, fold, "auc").join(partial.select(*by, fold, F.col("auc").alias("_less")), [*by, fold])
    d = F.round(F.col("auc") - F.col("_less"), 12)
    out = both.where(d.isNotNull()).groupBy(*by).agg(F.count("*").alias("folds"), F.avg(d).alias("mean_increment"), F.count_if(d > 0).alias("positive"), F.count_if(d < 0).alias("negative"))
    return out.withColumn("status", F.when(F.col("positive") == F.col("folds"), "consistent_positive").when(F.col("negative") == F.col("folds"), "consistent_negative").otherwise("regime_dependent"))


def group_stability(deltas: DataFrame, group: str) -> DataFrame:
    """Keep a feature group if leaving it in helps on two thirds of folds and on the mean, never hurts by 0.02 in area and
    does not raise the Brier score: group, fold, delta_auc, delta_brier -> figures and status."""
    s = deltas.groupBy(group).agg(F.avg((F.col("delta_auc") > 0).cast("double")).alias("positive_share"), F.avg("delta_auc").alias("mean_auc"), F.min("delta_auc").alias("worst_auc"), F.avg("delta_brier").alias("mean_brier"))
    keep = (F.round("positive_share", 9) >= round(2 / 3, 9)) & (F.col("mean_auc") > 0) & (F.col("worst_auc") > -0.02) & (F.col("mean_brier") <= 0)
    status = F.when(F.col("mean_auc").isNull() & F.col("mean_brier").isNull(), "missing_group_features").when(keep, "selected").otherwise("excluded_unstable")
    return s.withColumn("status", status)


def rank_stability(ranks: DataFrame, feature: str, top: int = 15) -> DataFrame:
    """Mean, spread, best and worst rank of each feature over folds, and the share of folds with it among the top."""
    return ranks.where("rank is not null").groupBy(feature).agg(F.avg("rank").alias("mean_rank"), _spread("rank").alias("rank_spread"), F.min("rank").alias("best"), F.max("rank").alias("worst"), F.avg((F.col("rank") <= top).cast("double")).alias("top_share"))


def drift_reference(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """For each column: range, p01, p50, p99, missing rate, inner edges of the deciles without repeats, and the share of
    known values in each bin (closed below). Percentiles come from sorted partitions; all counts from one pass."""
    shares = [0.0, 0.01, 0.5, 0.99, 1.0, *[i / bins for i in range(1, bins)]]
    stats = {c: percentiles_all(df, c, shares) for c in columns}
    inner = {c: sorted({x for x in s[5:] if s[0] < x < s[4]}) if s[0] is not None else [] for c, s in stats.items()}
    at = lambda c: F.size(F.filter(F.array(*map(F.lit, inner[c])), lambda e: e <= F.col(c))) if inner[c] else F.lit(0)
    known = df.select(*[F.when(F.col(c).isNotNull(), at(c)).alias(c) for c in columns]).withColumn("_", F.lit(1)).unpivot(["_"], columns, "feature", "bin")
    counts = known.groupBy("feature", "bin").agg(F.count("*").alias("n")).groupBy("feature").agg(F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))).alias("_n"), F.sum("n").alias("_all"))
    have = F.aggregate(F.map_values("_n"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    edges = df.sparkSession.createDataFrame([(c, *map(lambda x: None if x is None else float(x), s[:5]), inner[c], bool(s[0] is not None and s[0] < s[4])) for c, s in stats.items()], "feature string, low double, p01 double, p50 double, p99 double, high double, edges array<double>, _spread boolean")
    share = F.when(F.col("_spread"), F.transform(F.sequence(F.lit(0), F.size("edges")), lambda b: F.coalesce(F.element_at("_n", b), F.lit(0)) / have)).otherwise(F.array().cast("array<double>"))
    return edges.join(counts, "feature").select("feature", "low", "p01", "p50", "p99", "high", "edges", share.alias("shares"), ((F.col("_all") - have) / F.col("_all")).alias("missing_rate"))


def top_drift(report: DataFrame, k: int = 20) -> DataFrame:
    """The k features of a drift report with the highest sum of median shift, outside rate, missing shift and PSI."""
    parts = [F.abs("median_shift"), F.col("outside"), F.abs("missing_shift"), F.col("psi")]
    score = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    return report.withColumn("severity_score", score).orderBy(F.desc(F.round("severity_score", 9)), "feature").limit(k)


def fold_diagnostics(rows: DataFrame, fold: list[str], role: str, date: str, value: str, market: str, band: float = 0.005) -> DataFrame:
    """For each fold: first and last date, share of gains among rows outside the neutral band and benchmark quantiles of
    training rows against test rows, and how far the share moves."""
    clear = F.when(F.abs(value) >= band, (F.col(value) > 0).cast("double"))
    figures = []
    for r in ("train", "test"):
        mine = lambda c, r=r: F.when(F.col(role) == r, c)
        figures += [F.min(mine(F.col(date))).alias(f"{r}_start"), F.max(mine(F.col(date))).alias(f"{r}_end"), F.count_if(F.col(role) == r).alias(f"{r}_n"), F.avg(mine(clear)).alias(f"{r}_rate")]
    per = rows.groupBy(*fold).agg(*figures)
    at = percentiles_by(rows, [*fold, role], market, [0.1, 0.5, 0.9])
    for r in ("train", "test"):
        per = per.join(at.where(F.col(role) == r).select(*fold, F.col("q").alias(f"{r}_market")), fold, "left")
    q = lambda r, i, n: F.get(f"{r}_market", F.lit(i)).alias(f"{r}_market_{n}")
    return per.select(*fold, "train_start", "train_end", "test_start", "test_end", "train_n", "test_n", "train_rate", "test_rate", F.abs(F.col("test_rate") - F.col("train_rate")).alias("prevalence_shift"), q("train", 0, "p10"), q("train", 1, "p50"), q("train", 2, "p90"), q("test", 1, "p50"))


def reliability(chosen: DataFrame, outer: DataFrame, increments: DataFrame, by: list[str]) -> DataFrame:
    """A row for each horizon: the chosen window with its validation figures, its outer test and what actions add."""
    a = chosen.where("selected").select(*by, "status", F.col("stability").alias("selection_score"), *[F.col(c).alias(f"inner_{c}") for c in ("auc_mean", "auc_worst", "brier_mean")])
    b = outer.select(*by, *[F.col(c).alias(f"outer_{c}") for c in ("auc_mean", "auc_worst", "brier_mean", "spearman_mean")], F.col("warnings").alias("outer_warnings"))
    return a.join(b, by, "left").join(increments.select(*by, F.col("status").alias("contribution"), "mean_increment"), by, "left")


def consistency(chosen: DataFrame, thresholds: DataFrame, reference: DataFrame, features: list[str]) -> DataFrame:
    """Checks of what a model run leaves behind, a row for each: check, broken (number of breaches; 0 if it holds)."""
    wanted = reference.sparkSession.createDataFrame([(f,) for f in features], "feature string").join(reference, "feature", "left")
    disordered = F.col("low").isNotNull() & ~((F.col("low") <= F.col("p01")) & (F.col("p01") <= F.col("p50")) & (F.col("p50") <= F.col("p99")) & (F.col("p99") <= F.col("high")))
    best = F.max(F.when(F.col("eligible"), F.col("stability"))).over(W.partitionBy())  # a row for each window
    picked = chosen.withColumn("_top", best).where("selected")
    return _breaches(wanted, {"quantiles_missing": F.col("p01").isNull() | F.col("p50").isNull() | F.col("p99").isNull(), "quantiles_out_of_order": disordered}).union(
        _breaches(picked, {"selected_window_not_best": F.abs(F.col("stability") - F.col("_top")) > 1e-9, "orientation_reversed": F.col("eligible") & (F.col("auc_mean") < 0.5)})
    ).union(_breaches(thresholds, {"threshold_invalid": F.col("t").isNull() | ~F.col("t").between(0, 100)}))


def _breaches(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """How often each check is broken, all in one pass over the rows."""
    return rows.agg(*[F.count_if(c).alias(n) for n, c in checks.items()]).withColumn("_", F.lit(1)).unpivot(["_"], list(checks), "check", "broken").drop("_")
