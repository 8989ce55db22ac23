"""Queries of ranks, point-in-time scores, labels and expert weights."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fundtrace.operators import scores as sc
from fundtrace.plans.fixtures import ACTIONS
from fundtrace.plans.registry import Views, query


@query("w08_expanding_scores", """
WITH d AS (SELECT manager, report_dt, avg(mret) AS v FROM {fx_events} GROUP BY 1, 2), s AS (SELECT DISTINCT report_dt FROM {fx_events}),
     h AS (SELECT manager, s.report_dt, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std FROM s JOIN d ON d.report_dt < s.report_dt GROUP BY 1, 2),
     r AS (SELECT *, round(CASE WHEN n >= 3 AND std > 0 THEN mean / std END, 9) AS ratio, CASE WHEN n >= 3 THEN ln(1 + n) / ln(1 + max(n) OVER (PARTITION BY report_dt)) END AS reliability FROM h)
SELECT manager, report_dt, n, round(ratio, 5) AS ratio, round(reliability, 6) AS reliability,
       round(CASE WHEN ratio IS NOT NULL THEN (rank() OVER (PARTITION BY report_dt ORDER BY ratio NULLS LAST) + (count(ratio) OVER (PARTITION BY report_dt, ratio) - 1) / 2.0) / count(ratio) OVER (PARTITION BY report_dt) END, 6) AS score FROM r""")
def expanding_scores(v: Views):
    return sc.expanding_scores(v.fx_events, "manager", "report_dt", "mret").select("manager", "report_dt", "n", F.round("ratio", 5).alias("ratio"), "reliability", "score")


PTI = {"annual_return": "mret", "avg_excess": "deviation", "max_drawdown": "d_stock", "avg_fee": "exp_ratio", "avg_flow": "flow", "avg_mtna": "turn_ratio"}
PTI_RANKS = {"defensive": ("max_drawdown", "-annual_volatility", "-avg_fee"), "flow": ("avg_flow", "avg_mtna"), "growth_tilt": ("annual_return", "avg_excess", "sharpe")}


def _mean_rank(fields) -> str:
    """SQL: mean of the known ranks, those of fields with a minus turned round."""
    one = lambda f: ("1 - " if f[0] == "-" else "") + f"CASE WHEN {f.strip('-')} IS NOT NULL THEN (rank() OVER (PARTITION BY report_dt ORDER BY {f.strip('-')} NULLS LAST) + (count(*) OVER (PARTITION BY report_dt, {f.strip('-')}) - 1) / 2.0) / count({f.strip('-')}) OVER (PARTITION BY report_dt) END"
    return f"list_avg([{', '.join(one(f) for f in fields)}])"


@query("w08_manager_scores", f"""
WITH p AS (SELECT manager, report_dt, {', '.join(f'avg({c}) AS {n}' for n, c in PTI.items())} FROM {{fx_actions}} GROUP BY 1, 2), s AS (SELECT DISTINCT report_dt FROM {{fx_actions}}),
h AS (SELECT manager, s.report_dt, count(*) AS n, count(DISTINCT date_trunc('month', p.report_dt)) AS months, min(p.report_dt) AS lo, max(p.report_dt) AS hi, stddev_samp(annual_return) AS annual_volatility,
  min(max_drawdown) AS max_drawdown, {', '.join(f'avg({c}) AS {c}' for c in ('annual_return', 'avg_excess', 'avg_fee', 'avg_flow', 'avg_mtna'))} FROM s JOIN p ON p.report_dt < s.report_dt GROUP BY 1, 2),
g AS (SELECT manager, report_dt, n, months, lo, hi, {', '.join(f'round({c}, 12) AS {c}' for c in ('annual_return', 'avg_excess', 'avg_fee', 'avg_flow', 'avg_mtna', 'max_drawdown', 'annual_volatility'))},
  round(CASE WHEN annual_volatility > 0 THEN (annual_return - 0.01) / annual_volatility END, 12) AS sharpe FROM h),
k AS (SELECT *, ln(1 + n) / ln(1 + max(n) OVER (PARTITION BY report_dt)) AS reliability, {', '.join(f'{_mean_rank(fs)} AS {n}' for n, fs in PTI_RANKS.items())} FROM g)
SELECT manager, report_dt, n AS history_count, months AS history_months, lo AS window_start, hi AS window_end, n >= 3 AS history_available, {', '.join(f'round(CASE WHEN n >= 3 THEN {c} END, 6) AS {c}' for c in ('reliability', *PTI_RANKS))} FROM k""")
def manager_scores(v: Views):
    return sc.point_in_time_scores(v.fx_actions, "manager", "report_dt", PTI)


@query("w09_trailing_deviation", """
WITH d AS (SELECT manager, report_dt, avg(bond) AS bond, avg(turn_ratio) AS turn_ratio FROM {fx_events} GROUP BY 1, 2),
     h AS (SELECT a.manager, a.report_dt, any_value(a.bond) AS xb, any_value(a.turn_ratio) AS xt, count(b.manager) AS n, avg(b.bond) AS mb, stddev_samp(b.bond) AS sb, avg(b.turn_ratio) AS mt, stddev_samp(b.turn_ratio) AS st
           FROM d a LEFT JOIN d b ON a.manager = b.manager AND b.report_dt < a.report_dt AND b.report_dt >= a.report_dt - INTERVAL 36 MONTH GROUP BY 1, 2)
SELECT manager, report_dt, n, round(sb, 6) AS std_bond, round(st, 6) AS std_turn_ratio,
       round(CASE WHEN n >= 2 THEN (coalesce(abs(xb - mb) / nullif(sb, 0), 0) + coalesce(abs(xt - mt) / nullif(st, 0), 0)) / nullif((CASE WHEN sb > 0 AND xb IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN st > 0 AND xt IS NOT NULL THEN 1 ELSE 0 END), 0) END, 4) AS deviation FROM h""")
def trailing_deviation(v: Views):
    return sc.trailing_deviation(v.fx_events, "manager", "report_dt", ["bond", "turn_ratio"]).withColumn("deviation", F.round("deviation", 4))


@query("w13_average_rank", """
WITH e AS (SELECT portfolio, report_dt, round(bond, 2) AS b FROM {fx_events})
SELECT portfolio, report_dt, round(CASE WHEN b IS NOT NULL THEN (rank() OVER (PARTITION BY report_dt ORDER BY b NULLS LAST) + (count(b) OVER (PARTITION BY report_dt, b) - 1) / 2.0) / count(b) OVER (PARTITION BY report_dt) END, 6) AS score FROM e""")
def average_rank(v: Views):
    return v.fx_events.withColumn("b", F.round("bond", 2)).select("portfolio", "report_dt", sc.pct_rank_avg("b", ["report_dt"]).alias("score"))


@query("w14_share_at_or_below", """
WITH e AS (SELECT portfolio, report_dt, round(stock, 2) AS s FROM {fx_events})
SELECT portfolio, report_dt, round(CASE WHEN s IS NULL THEN 0.5 ELSE cume_dist() OVER (PARTITION BY report_dt, s IS NULL ORDER BY s) END, 6) AS score FROM e""")
def share_at_or_below(v: Views):
    return v.fx_events.withColumn("s", F.round("stock", 2)).select("portfolio", "report_dt", sc.share_at_or_below("s", ["report_dt"]).alias("score"))


@query("w15_legacy_deviation", """
SELECT portfolio, report_dt, round(abs(bond - avg(bond) OVER (PARTITION BY manager)) / nullif((SELECT stddev_samp(bond) FROM {fx_events}), 0), 6) AS legacy_deviation FROM {fx_events}""")
def legacy_deviation(v: Views):
    return sc.whole_history_deviation(v.fx_events, "manager", "bond").select("portfolio", "report_dt", "legacy_deviation")


@query("w16_first_per_key", """
SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_date DESC NULLS LAST, doc_id) AS n FROM {fx_docs}) WHERE n = 1""")
def first_per_key(v: Views):
    from fundtrace.operators.joins import first_by

    return first_by(v.fx_docs, ["source"], [F.desc_nulls_last("doc_date"), F.col("doc_id")]).select("doc_id", "source", "lang")


@query("w17_expert_weights", """
WITH v AS (SELECT report_dt, manager, family, round(avg(mret), 5) AS s FROM {fx_events} GROUP BY 1, 2, 3),
     r AS (SELECT *, greatest(0.05, CASE WHEN count(*) OVER (PARTITION BY report_dt, family) = 1 THEN s ELSE (rank() OVER (PARTITION BY report_dt, family ORDER BY s) + (count(*) OVER (PARTITION BY report_dt, family, s) - 1) / 2.0) / count(*) OVER (PARTITION BY report_dt, family) END) AS rel FROM v)
SELECT report_dt, manager, round(rel, 6) AS relative, round(rel / sum(rel) OVER (PARTITION BY report_dt), 6) AS weight FROM r""")
def expert_weights(v: Views):
    votes = v.fx_events.groupBy("report_dt", "manager", "family").agg(F.round(F.avg("mret"), 5).alias("s"))
    return sc.expert_weights(votes, "report_dt", "family", "s").select("report_dt", "manager", "relative", "weight")


SIGNAL_PARTS = {"trailing_return": "mret", "trailing_excess": "mret - market / 12", "drawdown": "drawdown", "flow": "flow", "turnover": "turn_ratio", "portfolio_change": "abs(d_stock)", "expense": "exp_ratio"}
PART = lambda c: f"abs({c})" if c == "drawdown" else c


@query("w20_weighted_signal", "WITH r AS (SELECT portfolio, report_dt, excess, " + ", ".join(f"{e} AS {c}" for c, e in SIGNAL_PARTS.items()) + " FROM {fx_actions} WHERE excess IS NOT NULL), "
    "z AS (SELECT portfolio, report_dt, excess, " + " + ".join(f"{w} * coalesce(({PART(c)} - avg({PART(c)}) OVER ()) / nullif(stddev_samp({PART(c)}) OVER (), 0), 0)" for c, w in sc.SIGNAL.items())
    + " AS signal FROM r) SELECT portfolio, report_dt, round(signal, 6) AS signal, excess > 0 AS future_positive, excess > 0 AND excess >= (SELECT quantile_cont(excess, 0.75) FROM z) AS future_high_positive FROM z")
def weighted_signal(v: Views):
    v.keep(*ACTIONS)
    rows = v.fx_actions.select("portfolio", "report_dt", "excess", *[F.expr(e).alias(c) for c, e in SIGNAL_PARTS.items()])
    return sc.weighted_signal(rows, "excess").select("portfolio", "report_dt", "signal", "future_positive", "future_high_positive")


@query("w21_portfolio_change", """
SELECT portfolio, report_dt, round(bond - lag(bond) OVER w, 6) AS bond_change, report_dt - lag(report_dt) OVER w AS days FROM {fx_allocation} WINDOW w AS (PARTITION BY portfolio ORDER BY report_dt)""")
def portfolio_change(v: Views):
    w = W.partitionBy("portfolio").orderBy("report_dt")
    return v.fx_allocation.select("portfolio", "report_dt", (F.col("bond") - F.lag("bond").over(w)).alias("bond_change"), F.datediff("report_dt", F.lag("report_dt").over(w)).cast("long").alias("days"))


@query("w22_leakage_audit", """
WITH d AS (SELECT manager, report_dt, count(*) AS c FROM {fx_events} GROUP BY 1, 2), h AS (SELECT a.manager, a.report_dt, max(b.report_dt) AS last_dt FROM d a LEFT JOIN d b ON a.manager = b.manager AND b.report_dt < a.report_dt GROUP BY 1, 2)
SELECT manager, report_dt, last_dt, last_dt IS NULL OR last_dt < report_dt AS no_leak, last_dt IS NOT NULL AS has_history FROM h""")
def leakage_audit(v: Views):
    d = v.fx_events.select("manager", "report_dt").distinct()
    last = F.max("report_dt").over(W.partitionBy("manager").orderBy("report_dt").rowsBetween(W.unboundedPreceding, -1))
    return d.withColumn("last_dt", last).select("manager", "report_dt", "last_dt", F.coalesce(F.col("last_dt") < F.col("report_dt"), F.lit(True)).alias("no_leak"), F.col("last_dt").isNotNull().alias("has_history"))


@query("w23_previous_report", "SELECT portfolio, report_dt, lag(report_dt) OVER (PARTITION BY portfolio ORDER BY report_dt) AS before_dt FROM (SELECT DISTINCT portfolio, report_dt FROM {fx_holdings})")
def previous_report(v: Views):
    from fundtrace.operators.holdings import previous_report

    return previous_report(v.fx_holdings)


@query("w24_order_bucket", """
SELECT portfolio, report_dt, CAST(least(4, floor((row_number() OVER (PARTITION BY report_dt ORDER BY bond, portfolio) - 1) * 5.0 / count(*) OVER (PARTITION BY report_dt))) AS INT) AS bucket FROM {fx_events}""")
def order_bucket(v: Views):
    nth = F.row_number().over(W.partitionBy("report_dt").orderBy("bond", "portfolio"))
    return v.fx_events.select("portfolio", "report_dt", F.least(F.lit(4), F.floor((nth - 1) * 5.0 / F.count("*").over(W.partitionBy("report_dt")))).cast("int").alias("bucket"))


@query("w25_cohort_distance", """
WITH s AS (SELECT avg(bond) AS mb, stddev_samp(bond) AS sb, avg(mret) AS mm, stddev_samp(mret) AS sm FROM {fx_events})
SELECT family, round((avg(bond) - any_value(mb)) / coalesce(nullif(any_value(sb), 0), 1), 6) AS bond, round((avg(mret) - any_value(mm)) / coalesce(nullif(any_value(sm), 0), 1), 6) AS mret FROM {fx_events}, s GROUP BY 1""")
def cohort_distance(v: Views):
    return sc.cohort_distance(v.fx_events, "family", ["bond", "mret"])


@query("a35_consensus", """
SELECT report_dt, round(sum(mtna * bond) / sum(mtna), 6) AS bond, round(sum(mtna * coalesce(stock, 0)) / sum(mtna), 6) AS stock, round(sum(CASE WHEN d_bond IS NOT NULL THEN mtna * d_bond END) / sum(CASE WHEN d_bond IS NOT NULL THEN mtna END), 6) AS d_bond, count(*) AS experts
FROM {fx_events} JOIN (SELECT portfolio, caldt AS report_dt, mtna FROM {fx_port_month}) m USING (portfolio, report_dt) GROUP BY 1""")
def consensus(v: Views):
    m = v.fx_port_month.select("portfolio", F.col("caldt").alias("report_dt"), "mtna")
    votes = v.fx_events.join(m, ["portfolio", "report_dt"]).withColumn("stock", F.coalesce("stock", F.lit(0.0)))
    return sc.consensus(votes, "report_dt", "mtna", ["bond", "stock"], "d_bond")


@query("a36_performance_composite", """
SELECT portfolio, report_dt, round((coalesce(stock, 0) * 0.5 + coalesce(bond, 0) * 0.3 + coalesce(cash, 0) * 0.2) / ((CASE WHEN stock IS NULL THEN 0 ELSE 0.5 END) + (CASE WHEN bond IS NULL THEN 0 ELSE 0.3 END) + (CASE WHEN cash IS NULL THEN 0 ELSE 0.2 END)), 6) AS composite FROM {fx_allocation}""")
def performance_composite(v: Views):
    return v.fx_allocation.select("portfolio", "report_dt", sc.weighted_mean([(F.col("stock"), 0.5), (F.col("bond"), 0.3), (F.col("cash"), 0.2)]).alias("composite"))


@query("a37_manager_date_votes", "SELECT report_dt, manager, round(avg(bond), 6) AS bond, count(*) AS portfolios FROM {fx_events} GROUP BY 1, 2")
def manager_date_votes(v: Views):
    return v.fx_events.groupBy("report_dt", "manager").agg(F.avg("bond").alias("bond"), F.count("*").alias("portfolios"))
