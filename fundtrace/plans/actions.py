"""Queries of manager actions: labels, styles, unusual decisions, candidates, outcome tables and horizon views."""

from __future__ import annotations

from pyspark.sql import functions as F

from fundtrace.functions import labels as lb
from fundtrace.operators import cases as cs
from fundtrace.operators import models as md
from fundtrace.operators.joins import first_by
from fundtrace.operators.scores import number_rows, percentiles_all
from fundtrace.plans.fixtures import ACTIONS
from fundtrace.plans.registry import Views, query

DELTAS = {"d_stock": "large stock change", "d_beta": "large beta change", "d_tech": "large technology change", "d_bond_money": "large bond/money change", "d_indirect": "large indirect equity change"}
LABELLED = """
WITH s AS (SELECT *, greatest(abs(d_stock), abs(d_beta), abs(d_tech), abs(d_bond_money), abs(d_indirect)) AS strength FROM {fx_actions}),
lab AS (SELECT *, CASE WHEN d_stock >= 0.03 AND d_tech >= 0.01 THEN 'increase_equity_plus_technology' WHEN d_stock >= 0.03 THEN 'increase_stock_allocation' WHEN d_stock <= -0.03 AND d_bond_money >= 0.01 THEN 'reduce_stock_increase_bond_money'
  WHEN d_beta <= -0.05 THEN 'reduce_portfolio_beta' WHEN d_tech >= 0.01 THEN 'increase_technology_exposure' WHEN d_bond_money >= 0.01 THEN 'increase_bond_money_exposure' WHEN d_indirect >= 0.01 THEN 'increase_indirect_equity_exposure'
  WHEN strength >= 0.01 THEN 'minor_allocation_rotation' ELSE 'stable_or_no_clear_action' END AS action,
  CASE WHEN yield10 IS NULL THEN 'unknown_rate' WHEN yield10 >= 4 THEN 'high_rate' WHEN yield10 <= 2 THEN 'low_rate' ELSE 'mid_rate' END || '__' || CASE WHEN market IS NULL THEN 'unknown_market' WHEN market >= 0.08 THEN 'strong_equity_market' WHEN market <= 0 THEN 'weak_equity_market' ELSE 'moderate_equity_market' END AS regime,
  stock IS NOT NULL AND beta IS NOT NULL AND excess IS NOT NULL AS clean FROM s)"""
EXECUTION = "CASE action " + " ".join(f"WHEN '{a}' THEN '{e}'" for a, e in lb.ACTIONS.items()) + " END"
RANKED = ", ".join(
    f"CASE WHEN {c} IS NULL OR count({c}) OVER () < 2 THEN 0 ELSE (rank() OVER (ORDER BY {c} NULLS LAST) + (count({c}) OVER (PARTITION BY {c}) - 1) / 2.0) / count({c}) OVER () END AS r{i}"
    for i, c in enumerate(["deviation", "strength", *(f"abs({c})" for c in DELTAS)])
)
UNUSUAL = (
    LABELLED
    + f""", rk AS (SELECT *, {RANKED} FROM lab), un AS (SELECT *, action NOT IN ('stable_or_no_clear_action', 'minor_allocation_rotation') AS clear FROM rk),
    u AS (SELECT *, least(1, greatest(0, 0.3 * r0 + 0.2 * r1 + 0.06 * (r2 + r3 + r4 + r5 + r6) + CASE WHEN clear THEN 0.15 ELSE 0 END + CASE WHEN clean THEN 0.05 ELSE 0 END)) AS unusual,
    coalesce(nullif(concat_ws('; ', CASE WHEN deviation >= 0.75 THEN 'high style deviation' END, CASE WHEN strength >= 0.1 THEN 'large action strength' END, {", ".join(f"CASE WHEN abs({c}) >= 0.05 THEN '{w}' END" for c, w in DELTAS.items())}, CASE WHEN clear THEN 'clear action: ' || action END), ''), 'moderate or stable action') AS reason FROM un)"""
)
STYLES = """
b AS (SELECT manager, count(*) AS n, round(avg(mret), 9) AS ret, round(stddev_samp(mret), 9) AS vol, round(avg(mret - bret), 9) AS excess, round(min(mret), 9) AS fall, round(avg(exp_ratio), 9) AS fee, round(avg(new_sls - redemp), 9) AS flow, round(avg(mtna), 9) AS size,
      round(CASE WHEN stddev_samp(mret) > 0 THEN avg(mret) / stddev_samp(mret) END, 9) AS sharpe FROM {fx_fund_month} JOIN {fx_benchmark} USING (month_idx) GROUP BY 1),
r AS (SELECT manager, n, cume_dist() OVER (ORDER BY ret) AS ret, 1 - cume_dist() OVER (ORDER BY vol) AS vol, cume_dist() OVER (ORDER BY excess) AS excess, cume_dist() OVER (ORDER BY fall) AS fall, 1 - cume_dist() OVER (ORDER BY fee) AS fee,
      cume_dist() OVER (ORDER BY flow) AS flow, cume_dist() OVER (ORDER BY size) AS size, cume_dist() OVER (ORDER BY sharpe) AS sharpe FROM b),
m AS (SELECT manager, n, (fall + vol + fee) / 3 AS defensive, (flow + size) / 2 AS flow, (ret + excess + sharpe) / 3 AS growth, least(1, ln(1 + n) / ln(1 + max(n) OVER ())) AS reliability FROM r),
st AS (SELECT *, CASE WHEN defensive >= 0.66 AND growth < 0.66 THEN 'Defensive / risk-control style' WHEN growth >= 0.66 AND flow >= 0.55 THEN 'High-return / high-flow style' WHEN growth >= 0.66 THEN 'Equity-tilted / growth style' WHEN flow >= 0.66 THEN 'Flow-supported core style' ELSE 'Balanced core style' END AS style FROM m)"""


def labelled(v: Views):
    d = [F.col(c) for c in DELTAS]
    e = v.fx_actions.withColumn("strength", lb.action_strength(*d)).withColumn("action", lb.action_type(*d))
    e = e.withColumn("regime", lb.market_regime(F.col("yield10"), F.col("market")))
    return e.withColumn("clean", F.col("stock").isNotNull() & F.col("beta").isNotNull() & F.col("excess").isNotNull())


def unusual(v: Views):
    return cs.unusual_scores(labelled(v), "deviation", "strength", DELTAS, "action", F.col("clean"))


def styles(v: Views):
    f = v.fx_fund_month.join(v.fx_benchmark.drop("caldt"), "month_idx").withColumn("excess", F.col("mret") - F.col("bret")).withColumn("flow", F.col("new_sls") - F.col("redemp"))
    return cs.manager_styles(f, "manager", "mret", "excess", "mret", "exp_ratio", "flow", "mtna")


@query("l03_event_labels", LABELLED + """
SELECT portfolio, report_dt, regime, action, round(strength, 6) AS strength, CASE WHEN excess > 0 THEN CASE WHEN excess >= 0.005 THEN 1 ELSE 0 END WHEN excess <= -0.005 THEN -1 WHEN excess IS NOT NULL THEN 0 END AS direction,
  CASE WHEN excess >= 0.03 THEN 'large_win' WHEN excess >= 0.005 THEN 'small_win' WHEN excess <= -0.03 THEN 'large_loss' WHEN excess < -0.005 THEN 'small_loss' WHEN excess IS NOT NULL THEN 'neutral' END AS five,
  CASE WHEN stock IS NULL AND excess IS NULL THEN 'missing_stock_allocation;missing_future_12m' WHEN stock IS NULL THEN 'missing_stock_allocation' WHEN excess IS NULL THEN 'missing_future_12m' ELSE 'ok' END AS flags,
  CASE WHEN stock IS NULL THEN 'blocked' WHEN excess IS NULL THEN 'review' ELSE 'ready' END AS readiness,
  CAST(date_trunc('month', report_dt) + INTERVAL 1 MONTH AS DATE) AS label_start, CAST(date_trunc('month', report_dt) + INTERVAL 13 MONTH - INTERVAL 1 DAY AS DATE) AS label_end FROM lab""")
def event_labels(v: Views):
    start, end = lb.label_window(F.col("report_dt"), 12)
    gaps = {"missing_stock_allocation": F.col("stock").isNull(), "missing_future_12m": F.col("excess").isNull()}
    warnings = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in gaps.items()]))
    return labelled(v).select(
        "portfolio", "report_dt", "regime", "action", "strength", lb.direction(F.col("excess")).alias("direction"), lb.five_classes(F.col("excess")).alias("five"),
        lb.quality_flags(gaps).alias("flags"), lb.readiness(warnings, ["missing_stock_allocation"]).alias("readiness"), start.alias("label_start"), end.alias("label_end"),
    )


@query("l05_execution_type", LABELLED + f" SELECT portfolio, report_dt, action, {EXECUTION} AS execution FROM lab")
def execution(v: Views):
    return labelled(v).select("portfolio", "report_dt", "action", lb.execution_type(F.col("action")).alias("execution"))


@query("l07_outcome_label", """
SELECT portfolio, report_dt, CASE WHEN excess IS NULL THEN 'missing_future_outcome' WHEN excess > 0 AND drawdown <= -0.2 THEN 'positive_excess_high_drawdown' WHEN excess > 0 THEN 'positive_excess' WHEN excess < 0 THEN 'negative_excess' ELSE 'neutral' END AS outcome FROM {fx_actions}""")
def outcome(v: Views):
    return v.fx_actions.select("portfolio", "report_dt", lb.outcome_label(F.col("excess"), F.col("drawdown")).alias("outcome"))


@query("l04_style_label", "WITH " + STYLES.lstrip() + " SELECT manager, style FROM st")
def style_label(v: Views):
    return styles(v).select("manager", "style")


@query("a07_manager_styles", "WITH " + STYLES.lstrip() + " SELECT manager, n AS observations, round(defensive, 6) AS defensive, round(flow, 6) AS flow, round(growth, 6) AS growth, round(reliability, 6) AS reliability, style FROM st")
def manager_styles(v: Views):
    return styles(v)


@query("l10_unusual_score", UNUSUAL + " SELECT portfolio, report_dt, round(unusual, 6) AS score, reason FROM u")
def unusual_score(v: Views):
    return unusual(v).select("portfolio", "report_dt", F.col("unusual").alias("score"), "reason")


@query("k02_unusual_events", UNUSUAL + " SELECT manager, portfolio, report_dt, round(unusual, 6) AS score, reason FROM u ORDER BY round(unusual, 9) DESC NULLS LAST, portfolio, report_dt LIMIT 200")
def unusual_events(v: Views):
    top = unusual(v).orderBy(F.desc_nulls_last(F.round("unusual", 9)), "portfolio", "report_dt").limit(200)
    return top.select("manager", "portfolio", "report_dt", F.col("unusual").alias("score"), "reason")


@query("k02_top_per_manager", UNUSUAL + " SELECT manager, portfolio, report_dt, place FROM (SELECT *, row_number() OVER (PARTITION BY manager ORDER BY round(unusual, 9) DESC, report_dt, portfolio) AS place FROM u) WHERE place <= 10")
def top_per_manager(v: Views):
    from pyspark.sql import Window as W

    w = W.partitionBy("manager").orderBy(F.round("unusual", 9).desc(), "report_dt", "portfolio")
    return unusual(v).withColumn("place", F.row_number().over(w)).where("place <= 10").select("manager", "portfolio", "report_dt", F.col("place").cast("long").alias("place"))


@query("a24_manager_candidates", UNUSUAL + """
, g AS (SELECT manager, count(*) AS row_count, count(*) FILTER (clean) AS clean_rows, count(excess) AS outcomes, count(DISTINCT portfolio) AS funds, count(DISTINCT action) AS actions, count(*) FILTER (clear) AS clear_actions,
        avg(CASE WHEN excess IS NOT NULL THEN CASE WHEN excess > 0 THEN 1.0 ELSE 0 END END) AS positive_rate, avg(excess) AS mean_excess, avg(unusual) AS mean_unusual, max(unusual) AS max_unusual FROM u GROUP BY 1)
SELECT manager, row_count, clean_rows, outcomes, funds, actions, clear_actions, round(positive_rate, 6) AS positive_rate, round(mean_excess, 6) AS mean_excess, round(mean_unusual, 6) AS mean_unusual, round(max_unusual, 6) AS max_unusual,
  round(0.3 * ln(1 + outcomes) / ln(1 + greatest(max(outcomes) OVER (), 1)) + 0.25 * mean_unusual + 0.2 * max_unusual + 0.15 * clear_actions / row_count + 0.1 * least(actions / 6.0, 1), 6) AS recommendation FROM g""")
def manager_candidates(v: Views):
    return cs.manager_candidates(unusual(v), "manager", "portfolio", "action", "excess", "unusual", F.col("clean"))


@query("a27_outcome_by_action", LABELLED + " SELECT action, count(*) AS n, round(avg(CASE WHEN excess > 0 THEN 1.0 ELSE 0 END), 6) AS positive_rate, round(avg(excess), 6) AS mean_excess FROM lab WHERE excess IS NOT NULL GROUP BY 1 HAVING count(*) >= 30")
def outcome_by_action(v: Views):
    return cs.group_outcomes(labelled(v), ["action"], "excess", 30)


@query("a28_style_action_matrix", LABELLED + ", " + STYLES.lstrip() + ", c AS (SELECT style, action, avg(CASE WHEN excess > 0 THEN 1.0 ELSE 0 END) AS x FROM lab JOIN st USING (manager) WHERE excess IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20) SELECT style, " + ", ".join(f"round(max(CASE WHEN action = '{a}' THEN x END), 6) AS {a}" for a in lb.ACTIONS) + " FROM c GROUP BY 1")
def style_action_matrix(v: Views):
    cells = cs.group_outcomes(labelled(v).join(styles(v).select("manager", "style"), "manager"), ["style", "action"], "excess", 20)
    return cs.matrix(cells, "style", "action", "positive_rate", list(lb.ACTIONS))


@query("a29_regime_matrix", LABELLED + f", c AS (SELECT regime, {EXECUTION} AS execution, avg(excess) AS x FROM lab WHERE excess IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20) SELECT regime, " + ", ".join(f"round(max(CASE WHEN execution = '{e}' THEN x END), 6) AS {e}" for e in lb.ACTIONS.values()) + " FROM c GROUP BY 1")
def regime_matrix(v: Views):
    cells = cs.group_outcomes(labelled(v).withColumn("execution", lb.execution_type(F.col("action"))), ["regime", "execution"], "excess", 20)
    return cs.matrix(cells, "regime", "execution", "mean_excess", list(lb.ACTIONS.values()))


TRAINING = "report_dt <= DATE '1996-12-31'"
EXPECTED = """e AS (SELECT *, round(0.4 * coalesce(d_stock, 0) - 0.2 * coalesce(d_bond_money, 0) + 0.1 * coalesce(d_tech, 0), 9) AS expected FROM {fx_actions}),
q AS (SELECT quantile_cont(abs(excess), 0.67) AS large FROM {fx_actions} WHERE report_dt <= DATE '1996-12-31')"""


def expected(v: Views):
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return v.fx_actions.withColumn("expected", F.round(0.4 * zero("d_stock") - 0.2 * zero("d_bond_money") + 0.1 * zero("d_tech"), 9))


def large_excess(v: Views):
    """The size from which an excess is large: the 0.67 quantile of absolute excess over training rows."""
    return F.lit(percentiles_all(v.fx_actions.where(TRAINING).withColumn("size", F.abs("excess")), "size", [0.67])[0]).cast("double")


def probability(h: int):
    return 1 / (1 + F.exp(-F.col("expected") * h * 4))


@query("l12_prediction_class", "WITH " + EXPECTED + """
SELECT portfolio, report_dt, CASE WHEN 1 / (1 + exp(-expected * 48)) BETWEEN 0.4 AND 0.6 OR abs(expected) < 0.005 THEN 'neutral' ELSE CASE WHEN abs(expected) >= large THEN 'large' ELSE 'small' END || CASE WHEN expected > 0 THEN '_win' ELSE '_loss' END END AS class FROM e, q""")
def prediction_class(v: Views):
    v.keep(*ACTIONS)
    return expected(v).select("portfolio", "report_dt", lb.prediction_class(probability(12), F.col("expected"), large_excess(v)).alias("class"))


@query("l13_actual_class", "WITH " + EXPECTED + """
SELECT portfolio, report_dt, CASE WHEN excess IS NULL THEN 'unknown' WHEN abs(excess) < 0.005 THEN 'neutral' ELSE CASE WHEN abs(excess) >= large THEN 'large' ELSE 'small' END || CASE WHEN excess > 0 THEN '_win' ELSE '_loss' END END AS class FROM e, q""")
def actual_class(v: Views):
    v.keep(*ACTIONS)
    return v.fx_actions.select("portfolio", "report_dt", lb.actual_class(F.col("excess"), large_excess(v)).alias("class"))


HORIZONS = (3, 6, 9, 12)
WIDE = "WITH " + EXPECTED + ", w AS (SELECT portfolio, report_dt, expected, " + ", ".join(f"1 / (1 + exp(-expected * {4 * h})) AS p_{h}" for h in HORIZONS) + " FROM e) "


def wide(v: Views):
    return expected(v).select("portfolio", "report_dt", "expected", *[probability(h).alias(f"p_{h}") for h in HORIZONS])


def by_horizon(rows):
    """A row for each event and horizon of a table with one column for each horizon."""
    return rows.unpivot(["portfolio", "report_dt", "expected"], [f"p_{h}" for h in HORIZONS], "horizon", "positive").withColumn("horizon", F.substring("horizon", 3, 2).cast("int"))


@query("p25_horizon_view", WIDE + "SELECT portfolio, report_dt, round(p_6, 6) AS positive, round(1 - p_6, 6) AS negative FROM w")
def horizon_view(v: Views):
    return by_horizon(wide(v)).where("horizon = 6").select("portfolio", "report_dt", "positive", (1 - F.col("positive")).alias("negative"))


@query("a23_horizon_summary", WIDE + "SELECT horizon, count(*) FILTER (p > 0.5) AS up, count(*) FILTER (p <= 0.5) AS down, round(avg(p), 6) AS mean_p, round(avg(abs(expected)), 6) AS mean_size FROM (" + " UNION ALL ".join(f"SELECT {h} AS horizon, p_{h} AS p, expected FROM w" for h in HORIZONS) + ") GROUP BY 1")
def horizon_summary(v: Views):
    p = F.col("positive")
    return by_horizon(wide(v)).groupBy("horizon").agg(F.count_if(p > 0.5).alias("up"), F.count_if(p <= 0.5).alias("down"), F.avg(p).alias("mean_p"), F.avg(F.abs("expected")).alias("mean_size"))


@query("a34_signal_quintiles", "WITH " + EXPECTED + """
, k AS (SELECT least(4, floor((row_number() OVER (ORDER BY expected, portfolio, report_dt) - 1) * 5.0 / count(*) OVER ()))::INTEGER AS bucket, excess FROM e WHERE excess IS NOT NULL)
SELECT bucket, count(*) AS n, round(avg(excess), 6) AS mean_excess, round(avg(CASE WHEN excess > 0 THEN 1.0 ELSE 0 END), 6) AS hit_rate FROM k GROUP BY 1""")
def signal_quintiles(v: Views):
    known = expected(v).where("excess is not null").select("expected", "portfolio", "report_dt", "excess")
    ranked = number_rows(known, ["expected", "portfolio", "report_dt"]).join(F.broadcast(known.agg(F.count("*").alias("n"))), F.lit(True))
    at = F.least(F.lit(4), F.floor(F.col("nth") * 5.0 / F.col("n"))).cast("int").alias("bucket")
    return ranked.groupBy(at).agg(F.count("*").alias("n"), F.avg("excess").alias("mean_excess"), F.avg((F.col("excess") > 0).cast("double")).alias("hit_rate"))


WEIGHTS = {"d_stock": 0.4, "d_bond_money": -0.2, "d_tech": 0.1}
PARTS = " UNION ALL ".join(f"SELECT portfolio, report_dt, manager, '{f}' AS feature, coalesce({f} * {w}, 0) AS c FROM {{fx_actions}}" for f, w in WEIGHTS.items())


def contributions(v: Views):
    rows = v.fx_actions.na.fill(0.0, list(WEIGHTS)).withColumn("k", F.struct("portfolio", "report_dt", "manager"))
    return md.linear_contributions(rows, WEIGHTS, dict.fromkeys(WEIGHTS, 0.0), 0.0, "k").select("k.*", "feature", F.col("contribution").alias("c"))


@query("a22_attribution_rollup", f"SELECT feature, round(sum(abs(c)), 5) AS total, round(avg(c), 6) AS mean, round(sum(greatest(c, 0)), 5) AS up, round(sum(least(c, 0)), 5) AS down FROM ({PARTS}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 14")
def attribution_rollup(v: Views):
    c, r = F.col("c"), lambda x: F.round(F.sum(x), 5)
    return contributions(v).groupBy("feature").agg(r(F.abs(c)).alias("total"), F.avg(c).alias("mean"), r(F.greatest(c, F.lit(0.0))).alias("up"), r(F.least(c, F.lit(0.0))).alias("down")).orderBy(F.desc("total"), "feature").limit(14)


@query("p26_explanation_rows", f"SELECT portfolio, report_dt, coalesce(manager, 'Unknown manager') || ' | ' || report_dt AS event_label, feature, round(c, 6) AS contribution, CASE WHEN c >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM ({PARTS})")
def explanation_rows(v: Views):
    per_event = contributions(v).groupBy("portfolio", "report_dt", "manager").agg(F.collect_list(F.struct("feature", "c")).alias("features"))
    rows = per_event.select("*", F.explode("features").alias("x")).where("x.c is not null and not isnan(x.c)")
    label = F.concat(F.coalesce("manager", F.lit("Unknown manager")), F.lit(" | "), F.col("report_dt").cast("string"))
    return rows.select("portfolio", "report_dt", label.alias("event_label"), "x.feature", F.col("x.c").alias("contribution"), F.when(F.col("x.c") >= 0, "positive").otherwise("negative").alias("direction"))


@query("l17_cluster_names", f"""
WITH p AS ({PARTS}), f AS (SELECT manager, feature, row_number() OVER (PARTITION BY manager ORDER BY round(sum(abs(c)), 9) DESC, feature) AS n FROM p GROUP BY 1, 2)
SELECT manager, CASE feature WHEN 'd_bond_money' THEN 'Cross-Asset Defensive Direction Logic' ELSE 'Mixed Direction Logic' END AS name FROM f WHERE n = 1""")
def cluster_names(v: Views):
    sums = contributions(v).groupBy("manager", "feature").agg(F.round(F.sum(F.abs("c")), 9).alias("s"))
    top = first_by(sums, ["manager"], [F.desc("s"), F.col("feature")])
    return top.select("manager", lb.cluster_name(F.array("feature")).alias("name"))
