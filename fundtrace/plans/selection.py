"""Queries of threshold and window choice, stability, drift references and fold diagnostics.

``fx_fold_scores`` holds, for each year as a fold and each training window, the hit rate of a manager's matured past as the
probability of a gain.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fundtrace.functions import ingest
from fundtrace.functions.labels import label_window
from fundtrace.operators import classify as cl
from fundtrace.operators import evaluation as ev
from fundtrace.operators import selection as sl
from fundtrace.plans.evaluation import DRIFT_COLS, FOLDS, SECS
from fundtrace.plans.fixtures import ACTIONS, EVENTS
from fundtrace.plans.registry import Views, query

BY, OUTER = ["window_years", "fold"], 2000
SAFE = """SELECT *, CASE WHEN t NOT BETWEEN 20 AND 80 OR predicted_rate < 0.02 OR predicted_rate > 0.98 OR gap > 0.2 THEN 0 ELSE 1 END AS safe, balanced - 0.25 * gap AS score FROM
  (SELECT *, (coalesce(tp / nullif(pos, 0), 0) + CASE WHEN neg > 0 THEN 1 - fp / neg ELSE 0 END) / 2 AS balanced, coalesce(fp / nullif(neg, 0), 0) AS false_rate, (tp + fp) / (pos + neg) AS predicted_rate, pos / (pos + neg) AS actual_rate, round(abs((tp + fp) / (pos + neg) - pos / (pos + neg)), 12) AS gap FROM """
PLACE = "1 - safe, CASE safe WHEN 1 THEN round(-score, 9) END, CASE safe WHEN 1 THEN round(-balanced, 9) END, CASE safe WHEN 1 THEN round(gap, 9) END, abs(t - 50), round(false_rate, 9), t"
COUNTS = "count(*) FILTER (y = 1 AND p >= t / 100.0) AS tp, count(*) FILTER (y = 0 AND p >= t / 100.0) AS fp, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg"
FOLD_ROWS = f"""
WITH t AS (SELECT unnest(generate_series(5, 95))::INTEGER AS t), c AS (SELECT window_years, fold, t, {COUNTS} FROM {{fx_fold_scores}}, t GROUP BY 1, 2, 3),
bt AS (SELECT window_years, fold, sum(safe) = 0 AS failed FROM ({SAFE} c)) GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY window_years, fold ORDER BY expected) + (count(*) OVER (PARTITION BY window_years, fold, expected) - 1) / 2.0 AS re, rank() OVER (PARTITION BY window_years, fold ORDER BY excess) + (count(*) OVER (PARTITION BY window_years, fold, excess) - 1) / 2.0 AS ra,
  sum(y) OVER pr AS ptp, count(*) OVER pr AS pk FROM {{fx_fold_scores}} WINDOW pr AS (PARTITION BY window_years, fold ORDER BY p DESC)),
au AS (SELECT x.window_years, x.fold, avg(CASE WHEN x.p > z.p THEN 1.0 WHEN x.p = z.p THEN 0.5 ELSE 0 END) AS auc, avg(CASE WHEN x.market > z.market THEN 1.0 WHEN x.market = z.market THEN 0.5 ELSE 0 END) AS market_auc FROM {{fx_fold_scores}} x JOIN {{fx_fold_scores}} z ON x.window_years = z.window_years AND x.fold = z.fold WHERE x.y = 1 AND z.y = 0 GROUP BY 1, 2),
m AS (SELECT window_years, fold, sum(y * ptp / pk) / nullif(sum(y), 0) AS average_precision, avg((p - y) ** 2) AS brier, avg(y) AS actual_rate, avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0 END) AS predicted_rate,
  (count(*) FILTER (y = 1 AND p >= 0.5) / nullif(count(*) FILTER (y = 1), 0) + count(*) FILTER (y = 0 AND p < 0.5) / nullif(count(*) FILTER (y = 0), 0)) / 2 AS balanced, round(abs(avg(p) - avg(y)), 9) > 0.1 AS warning, CASE WHEN count(DISTINCT expected) > 1 AND count(DISTINCT excess) > 1 THEN corr(re, ra) END AS spearman FROM r GROUP BY 1, 2),
f AS (SELECT m.*, auc, market_auc, failed FROM m JOIN bt USING (window_years, fold) LEFT JOIN au USING (window_years, fold)),
"""
CHOSEN = FOLD_ROWS + f"""
s AS (SELECT window_years, count(*) AS folds, avg(auc) AS auc_mean, CASE count(auc) WHEN 1 THEN 0 ELSE stddev_samp(auc) END AS auc_spread, min(auc) AS auc_worst, avg(brier) AS brier_mean, avg(spearman) AS spearman_mean, min(spearman) AS spearman_worst, avg(abs(predicted_rate - actual_rate)) AS mean_gap,
  count(*) FILTER (predicted_rate < 0.05 OR predicted_rate > 0.95) AS collapses, count(*) FILTER (predicted_rate < 0.02 OR predicted_rate > 0.98) AS collapsed, avg(warning::INT) AS warning_share, count(*) FILTER (failed) AS failures FROM f WHERE fold < {OUTER} GROUP BY 1),
g AS (SELECT *, coalesce(auc_mean, 0) - 0.5 * coalesce(auc_spread, 0) + 0.3 * coalesce(auc_worst, 0) - 0.3 * coalesce(brier_mean, 0) + 0.1 * coalesce(spearman_mean, 0) + 0.1 * coalesce(spearman_worst, 0) - 0.5 * coalesce(mean_gap, 0) - 0.15 * collapses - 0.2 * warning_share - 0.5 * CASE WHEN auc_worst IS NULL THEN 0.5 ELSE greatest(0, 0.5 - auc_worst) END AS stability,
  concat_ws(',', CASE WHEN auc_worst < 0.48 THEN 'unstable_below_random_auc' END, CASE WHEN collapsed > 0 THEN 'class_collapse' END, CASE WHEN mean_gap > 0.25 THEN 'probability_rate_drift' END, CASE WHEN failures > 0 THEN 'threshold_selection_failure' END, CASE WHEN folds < 3 THEN 'insufficient_valid_inner_folds' END, CASE WHEN auc_mean IS NULL OR brier_mean IS NULL THEN 'missing_required_inner_validation_metrics' END) AS reasons FROM s),
k AS (SELECT *, row_number() OVER (ORDER BY round(stability, 9) DESC, window_years) AS place, row_number() OVER (ORDER BY (reasons = '') DESC, round(stability, 9) DESC, window_years) = 1 AS selected FROM g),
h AS (SELECT *, CASE WHEN NOT selected THEN 'not_selected' WHEN reasons = '' THEN 'stable_window_selected' ELSE 'no_stable_window_found' END AS status FROM k),
o AS (SELECT window_years, count(*) AS folds, avg(auc) AS auc_mean, CASE count(auc) WHEN 1 THEN 0 ELSE stddev_samp(auc) END AS auc_spread, min(auc) AS auc_worst, avg(balanced) AS balanced_mean, min(balanced) AS balanced_worst, avg(brier) AS brier_mean, avg(spearman) AS spearman_mean, min(spearman) AS spearman_worst, avg(predicted_rate - actual_rate) AS gap_mean, count(*) FILTER (warning) AS warnings FROM f WHERE fold >= {OUTER} GROUP BY 1),
d AS (SELECT window_years, fold, round(auc - market_auc, 12) AS d FROM f WHERE fold >= {OUTER} AND auc IS NOT NULL AND market_auc IS NOT NULL),
i AS (SELECT window_years, count(*) AS folds, avg(d) AS mean_increment, count(*) FILTER (d > 0) AS positive, count(*) FILTER (d < 0) AS negative FROM d GROUP BY 1),
"""
STATUS = "CASE WHEN positive = folds THEN 'consistent_positive' WHEN negative = folds THEN 'consistent_negative' ELSE 'regime_dependent' END"
END = "z AS (SELECT 1) "


def fold_metrics(v: Views):
    """A row for each window and fold, as the window rules want it."""
    s = v.keep(*ACTIONS, "fx_fold_scores").fx_fold_scores  # read by each part below
    area, precision = ev.roc_auc(s, "y", "p", BY), ev.average_precision(s, "y", "p", BY)
    market = ev.roc_auc(s, "y", "market", BY).withColumnRenamed("auc", "market_auc")
    sizes = ev.regression_metrics(s, "excess", "expected", BY).select(*BY, "spearman")
    varied = s.groupBy(*BY).agg((F.min("excess") < F.max("excess")).alias("_a"), (F.min("expected") < F.max("expected")).alias("_b"), F.avg("p").alias("_p"), F.avg("y").alias("actual_rate"))
    failed = sl.safe_threshold(ev.threshold_sweep(s, "y", "p", BY), BY).select(*BY, (F.col("n_safe") == 0).alias("failed"))
    m = ev.direction_metrics(s, "y", "p", BY, 0.5).select(*BY, "brier", ((F.col("recall") + F.col("specificity")) / 2).alias("balanced"), ((F.col("tp") + F.col("fp")) / F.col("n")).alias("predicted_rate"))
    for other in (varied, failed, area, market, precision, sizes):
        m = m.join(other, BY, "left")
    return m.withColumn("spearman", F.when(F.col("_a") & F.col("_b"), F.col("spearman"))).withColumn("warning", F.round(F.abs(F.col("_p") - F.col("actual_rate")), 9) > 0.1).drop("_a", "_b", "_p")


def chosen(folds):
    return sl.choose_window(sl.window_summary(folds.where(F.col("fold") < OUTER), ["window_years"], 3), "window_years", [])


def outer(folds):
    return folds.where(F.col("fold") >= OUTER)


def increments(folds):
    return sl.incremental_value(outer(folds), outer(folds).select(*BY, F.col("market_auc").alias("auc")), "fold", ["window_years"])


@query("m08_safe_threshold", f"""
WITH t AS (SELECT unnest(generate_series(5, 95))::INTEGER AS t), c AS (SELECT lang, t, {COUNTS} FROM {{fx_scores}}, t GROUP BY 1, 2), s AS ({SAFE} c)),
k AS (SELECT *, sum(safe) OVER (PARTITION BY lang)::BIGINT AS n_safe, row_number() OVER (PARTITION BY lang ORDER BY {PLACE}) AS place FROM s)
SELECT lang, t, CASE safe WHEN 1 THEN 'selected_safe_threshold' ELSE 'fallback_no_eligible_threshold' END AS status, n_safe, round(balanced, 6) AS balanced, round(gap, 6) AS gap, round(score, 6) AS score, round(predicted_rate, 6) AS predicted_rate, round(actual_rate, 6) AS actual_rate FROM k WHERE place = 1""")
def safe_threshold(v: Views):
    return sl.safe_threshold(ev.threshold_sweep(v.fx_scores, "y", "p", ["lang"]), ["lang"])


@query("m17_fold_metrics", FOLD_ROWS + END + "SELECT window_years, fold, round(auc, 6) AS auc, round(market_auc, 6) AS market_auc, round(average_precision, 6) AS average_precision, round(brier, 6) AS brier, round(balanced, 6) AS balanced, round(predicted_rate, 6) AS predicted_rate, round(actual_rate, 6) AS actual_rate, round(spearman, 6) AS spearman, warning, failed FROM f")
def window_folds(v: Views):
    return fold_metrics(v)


@query("m17_window_stability", CHOSEN + END + "SELECT window_years, folds, round(auc_mean, 6) AS auc_mean, round(auc_spread, 6)::DOUBLE AS auc_spread, round(auc_worst, 6) AS auc_worst, round(mean_gap, 6) AS mean_gap, collapses, failures, round(stability, 6) AS stability, reasons, place::INT AS place, selected, status FROM h")
def window_stability(v: Views):
    return chosen(fold_metrics(v)).select("window_years", "folds", "auc_mean", "auc_spread", "auc_worst", "mean_gap", "collapses", "failures", "stability", F.array_join("reasons", ",").alias("reasons"), "place", "selected", "status")


@query("m18_outer_summary", CHOSEN + END + "SELECT window_years, folds, " + ", ".join(f"round({c}, 6)::DOUBLE AS {c}" for c in "auc_mean auc_spread auc_worst balanced_mean balanced_worst brier_mean spearman_mean spearman_worst gap_mean".split()) + ", warnings FROM o")
def outer_summary(v: Views):
    return sl.outer_summary(outer(fold_metrics(v)), ["window_years"])


@query("m18_incremental_value", CHOSEN + END + f"SELECT window_years, folds, round(mean_increment, 6) AS mean_increment, positive, negative, {STATUS} AS status FROM i")
def incremental_value(v: Views):
    return increments(fold_metrics(v))


@query("m19_group_stability", FOLD_ROWS + """
e AS (SELECT CASE b.window_years WHEN 1 THEN 'one_year' ELSE 'two_years' END AS grp, b.auc - a.auc AS delta_auc, b.brier - a.brier AS delta_brier FROM f a JOIN f b ON a.fold = b.fold AND a.window_years = 0 AND b.window_years > 0),
s AS (SELECT grp, avg(CASE WHEN delta_auc > 0 THEN 1.0 WHEN delta_auc IS NOT NULL THEN 0 END) AS positive_share, avg(delta_auc) AS mean_auc, min(delta_auc) AS worst_auc, avg(delta_brier) AS mean_brier FROM e GROUP BY 1)
SELECT grp, round(positive_share, 6) AS positive_share, round(mean_auc, 6) AS mean_auc, round(worst_auc, 6) AS worst_auc, round(mean_brier, 6) AS mean_brier,
  CASE WHEN mean_auc IS NULL AND mean_brier IS NULL THEN 'missing_group_features' WHEN round(positive_share, 9) >= 0.666666667 AND mean_auc > 0 AND worst_auc > -0.02 AND mean_brier <= 0 THEN 'selected' ELSE 'excluded_unstable' END AS status FROM s""")
def group_stability(v: Views):
    f = fold_metrics(v).select(*BY, "auc", "brier")
    base = f.where("window_years = 0").select("fold", F.col("auc").alias("_auc"), F.col("brier").alias("_brier"))
    deltas = f.where("window_years > 0").join(base, "fold").select(F.when(F.col("window_years") == 1, "one_year").otherwise("two_years").alias("grp"), (F.col("auc") - F.col("_auc")).alias("delta_auc"), (F.col("brier") - F.col("_brier")).alias("delta_brier"))
    return sl.group_stability(deltas, "grp")


RANKED = ("stock", "bond_money", "tech", "beta", "exp_ratio", "turn_ratio")


@query("m19_rank_stability", "WITH c AS (" + " UNION ALL ".join(f"SELECT year(report_dt) AS fold, '{c}' AS feature, round(abs(corr({c}, excess)), 9) AS r FROM {{fx_actions}} GROUP BY 1" for c in RANKED) + """),
k AS (SELECT feature, row_number() OVER (PARTITION BY fold ORDER BY r DESC, feature) AS k FROM c WHERE r IS NOT NULL AND NOT isnan(r))
SELECT feature, round(avg(k), 6) AS mean_rank, round(CASE count(*) WHEN 1 THEN 0 ELSE stddev_samp(k) END, 6)::DOUBLE AS rank_spread, min(k)::INT AS best, max(k)::INT AS worst, round(avg(CASE WHEN k <= 2 THEN 1.0 ELSE 0 END), 6) AS top_share FROM k GROUP BY 1""")
def rank_stability(v: Views):
    per = v.fx_actions.groupBy(F.year("report_dt").alias("fold")).agg(*[F.round(F.abs(F.corr(c, "excess")), 9).alias(c) for c in RANKED])
    long = per.unpivot(["fold"], list(RANKED), "feature", "r").where("r is not null and not isnan(r)")
    return sl.rank_stability(long.withColumn("rank", F.row_number().over(W.partitionBy("fold").orderBy(F.desc("r"), "feature"))), "feature", 2)


@query("m20_drift_reference", " UNION ALL ".join(f"""
SELECT '{c}' AS feature, round(low, 6) AS low, round(p01, 6) AS p01, round(p50, 6) AS p50, round(p99, 6) AS p99, round(high, 6) AS high, round(missing, 6) AS missing_rate, bin::INT AS bin, round(n / known, 6) AS share FROM
  (SELECT min({c}) AS low, max({c}) AS high, quantile_cont({c}, 0.01) AS p01, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.99) AS p99, count({c}) AS known, 1 - count({c}) / count(*) AS missing FROM {{fx_events}}),
  (SELECT len(list_filter(e, lambda x: x <= {c})) AS bin, count(*) AS n FROM {{fx_events}}, (SELECT list_distinct(quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM {{fx_events}}) WHERE {c} IS NOT NULL GROUP BY 1)""" for c in ("bond", "stock", "turn_ratio")))
def drift_reference(v: Views):
    v.keep(*EVENTS)
    r = sl.drift_reference(v.fx_events, ["bond", "stock", "turn_ratio"])
    return r.select("feature", "low", "p01", "p50", "p99", "high", "missing_rate", F.posexplode("shares").alias("bin", "share"))


@query("k07_top_drift", "WITH " + ", ".join(f"""
q_{c} AS (SELECT quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e, quantile_cont({c}, [0.01, 0.25, 0.5, 0.75, 0.99]) AS q, 1 - count({c}) / count(*) AS miss FROM {{fx_events}} WHERE report_dt < DATE '1998-06-01'),
b_{c} AS (SELECT len(list_filter(e, lambda x: x < {c})) AS b, count(*) FILTER (report_dt < DATE '1998-06-01') AS r, count(*) FILTER (report_dt >= DATE '1998-06-01') AS k FROM {{fx_events}}, q_{c} WHERE {c} IS NOT NULL GROUP BY 1),
s_{c} AS (SELECT greatest(r / sum(r) OVER (), 1e-6) AS r, greatest(k / sum(k) OVER (), 1e-6) AS k FROM b_{c}),
n_{c} AS (SELECT avg(CASE WHEN {c} IS NOT NULL THEN ({c} < q[1] OR {c} > q[5])::INT END) AS outside, abs(median({c}) - max(q[3])) / nullif(max(q[4] - q[2]), 0) AS shift, abs(1 - count({c}) / count(*) - max(miss)) AS miss FROM {{fx_events}}, q_{c} WHERE report_dt >= DATE '1998-06-01')""" for c in DRIFT_COLS) + " " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(coalesce(outside, 0) + coalesce(shift, 0) + coalesce(miss, 0) + (SELECT sum((k - r) * ln(k / r)) FROM s_{c}), 4) AS severity_score FROM n_{c}" for c in DRIFT_COLS))
def top_drift(v: Views):
    e = v.fx_events
    return sl.top_drift(ev.drift(e.where("report_dt < '1998-06-01'"), e.where("report_dt >= '1998-06-01'"), list(DRIFT_COLS))).select("feature", F.round("severity_score", 4).alias("severity_score"))


@query("m23_fold_diagnostics", FOLDS.replace("{fx_events}", "{fx_actions}") + ", " + ", ".join(f"""
{r} AS (SELECT fold, min(r.report_dt) AS s, max(r.report_dt) AS e, count(*) AS n, avg(CASE WHEN abs(excess) >= 0.005 THEN (excess > 0)::INT END) AS rate, quantile_cont(market, [0.1, 0.5, 0.9]) AS q FROM r JOIN {{fx_actions}} USING (portfolio, report_dt) WHERE role = '{r}' GROUP BY 1)""" for r in ("train", "test")) + """
SELECT fold, a.s AS train_start, a.e AS train_end, b.s AS test_start, b.e AS test_end, a.n AS train_n, b.n AS test_n, round(a.rate, 6) AS train_rate, round(b.rate, 6) AS test_rate, round(abs(b.rate - a.rate), 6) AS prevalence_shift,
  round(a.q[1], 6) AS train_market_p10, round(a.q[2], 6) AS train_market_p50, round(a.q[3], 6) AS train_market_p90, round(b.q[2], 6) AS test_market_p50 FROM train a FULL JOIN test b USING (fold)""")
def fold_diagnostics(v: Views):
    rows = ev.walk_forward(v.fx_actions.withColumn("label_end", label_window(F.col("report_dt"), 3)[1]), "report_dt", "label_end")
    return sl.fold_diagnostics(rows, ["fold"], "role", "report_dt", "excess", "market")


@query("m29_reliability", CHOSEN + END + f"SELECT h.window_years, h.status, round(stability, 6) AS selection_score, round(h.auc_mean, 6) AS inner_auc_mean, round(h.auc_worst, 6) AS inner_auc_worst, round(h.brier_mean, 6) AS inner_brier_mean, round(o.auc_mean, 6) AS outer_auc_mean, round(o.auc_worst, 6) AS outer_auc_worst, round(o.brier_mean, 6) AS outer_brier_mean, round(o.spearman_mean, 6) AS outer_spearman_mean, o.warnings AS outer_warnings, CASE WHEN i.folds IS NOT NULL THEN {STATUS.replace('folds', 'i.folds')} END AS contribution, round(mean_increment, 6) AS mean_increment FROM h LEFT JOIN o USING (window_years) LEFT JOIN i USING (window_years) WHERE selected")
def reliability(v: Views):
    f = fold_metrics(v)
    return sl.reliability(chosen(f), sl.outer_summary(outer(f), ["window_years"]), increments(f), ["window_years"])


@query("m30_consistency")
def consistency(v: Views):
    f = fold_metrics(v)
    thresholds = sl.safe_threshold(ev.threshold_sweep(v.fx_fold_scores, "y", "p", BY), BY)
    return sl.consistency(chosen(f), thresholds, sl.drift_reference(v.fx_actions, ["stock", "beta"]), ["stock", "beta"])


@query("p23_horizon_aliases", """
SELECT portfolio, report_dt, 1 AS training_window_years, 12 AS training_window_months, round(avg(exp_ratio) OVER w + 1e-10, 6) AS trailing_avg_exp_ratio, round(avg(turn_ratio) OVER w + 1e-10, 6) AS trailing_avg_turn_ratio, round(sum(flow) OVER w, 2) AS trailing_sum_net_flow, NULL::DOUBLE AS trailing_avg_age
FROM {fx_events} WINDOW w AS (PARTITION BY portfolio ORDER BY report_dt ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def horizon_aliases(v: Views):
    w = W.partitionBy("portfolio").orderBy("report_dt").rowsBetween(-4, -1)
    wide = v.fx_events.select("portfolio", "report_dt", (F.avg("exp_ratio").over(w) + 1e-10).alias("trailing_avg_exp_ratio_1y"), (F.avg("turn_ratio").over(w) + 1e-10).alias("trailing_avg_turn_ratio_1y"), F.round(F.sum("flow").over(w), 2).alias("trailing_sum_net_flow_1y"))
    return ingest.horizon_aliases(wide, 1, ["trailing_avg_exp_ratio", "trailing_avg_turn_ratio", "trailing_sum_net_flow", "trailing_avg_age"], ["portfolio", "report_dt"])


@query("p24_calendar_parts", """
WITH o AS (SELECT fund, min(begdt) AS first_dt FROM {fx_validity} GROUP BY 1)
SELECT fund, caldt, year(caldt)::INT AS year, month(caldt)::INT AS month, (year(caldt) * 100 + month(caldt))::INT AS time, year(first_dt)::INT AS first_year, month(first_dt)::INT AS first_month, (year(first_dt) * 100 + month(first_dt))::INT AS first_time, round((caldt - first_dt) / 365.25, 6)::DOUBLE AS age_exact, datesub('year', first_dt, caldt)::INT AS age FROM {fx_fund_month} JOIN o USING (fund)""")
def calendar_parts(v: Views):
    o = v.fx_validity.groupBy("fund").agg(F.min("begdt").alias("first_dt"))
    return v.fx_fund_month.join(o, "fund").select("fund", "caldt", *ingest.calendar_parts("caldt", "first_dt"))


@query("a09_excluded_audit", "WITH " + SECS + """
SELECT s.ticker, s.name, reason, min(report_dt) AS first_dt, max(report_dt) AS last_dt, count(*) AS records, count(DISTINCT portfolio) AS portfolios
FROM {fx_holdings} h JOIN s ON h.security = s.security WHERE reason IS NOT NULL GROUP BY 1, 2, 3""")
def excluded_audit(v: Views):
    secs = v.fx_secs.select("security", "name", "ticker", cl.exclusion_reason("name", "ticker").alias("reason"))
    return cl.excluded_audit(v.fx_holdings.select("security", "report_dt", "portfolio").join(secs, "security"), ["ticker", "name", "reason"], "report_dt", "portfolio")
