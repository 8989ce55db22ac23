"""Queries of filters, eligibility and the audits that go with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from fundtrace.functions import labels as lb
from fundtrace.operators import filters as fl
from fundtrace.operators import retrieval as rt
from fundtrace.plans import evaluation as pe
from fundtrace.plans.fixtures import ACTIONS
from fundtrace.plans.registry import SQL, Views, query
from fundtrace.sources.scratch import written
from fundtrace.streaming.monthly import mature_labels


@query("p02_net_flow", "SELECT fund, caldt, round(new_sls + floor(new_sls * exp_ratio) - redemp, 2) AS net_flow FROM {fx_fund_month}")
def net_flow(v: Views):
    f = v.fx_fund_month.withColumns({"rein_sls": F.floor(F.col("new_sls") * F.col("exp_ratio")), "oth_sls": F.lit(None).cast("double")})
    return f.select("fund", "caldt", F.round(fl.net_flow(f), 2).alias("net_flow"))


@query("p06_brushed_reports", """
SELECT portfolio, report_dt FROM (SELECT *, year(report_dt) || ' Q' || quarter(report_dt) AS label, CASE WHEN report_dt < DATE '1996-01-01' THEN 'early' ELSE 'late' END AS period_key FROM {fx_events}) e
WHERE period_key = 'late' AND label IN ('1996 Q1', '1997 Q3', '1998 Q2', '1998 Q3') AND manager IN (SELECT n_name FROM {nation} WHERE n_regionkey < 3)""")
def brushed_reports(v: Views):
    e = v.fx_events.withColumn("period_key", F.when(F.col("report_dt") < "1996-01-01", "early").otherwise("late"))
    m = v.nation.where("n_regionkey < 3").select(F.col("n_name").alias("manager"))
    return fl.report_filter(e, "report_dt", ["portfolio"], m, period=("period_key", "late"), brushed=("1996 Q1", "1997 Q3", "1998 Q2", "1998 Q3"), mode="quarter").select("portfolio", "report_dt")


SEARCHED = ["portfolio", "fund_ticker", "fund_name", "ticker", "name", "objective", "sector", "industry"]


@query("p07_holding_search", """
SELECT portfolio, report_dt, security, security_rank FROM {fx_detail} WHERE period_key = 'late' AND year(report_dt) = 1997 AND security_rank BETWEEN 1 AND 40
AND contains(lower(""" + " || ' ' || ".join(f"coalesce({c}::VARCHAR, '')" for c in SEARCHED) + "), 'industry 2')")  # fmt: skip
def holding_search(v: Views):
    return fl.holding_filter(v.fx_detail, "report_dt", "portfolio", "security_rank", SEARCHED, 40, " Industry 2", period=("period_key", "late"), focus="1997").select("portfolio", "report_dt", "security", "security_rank")


def _theme(name: str) -> str:
    first, words = fl.THEMES[name]
    return f"starts_with(category, '{first}') AND regexp_matches(coalesce(ticker, '') || ' ' || coalesce(name, '') || ' ' || subcategory, '(?i)({words})')"


@query("p09_thematic_filter", "WITH g AS (SELECT s.security, s.records, s.ticker, s.name, l.category, l.subcategory FROM {fx_secs} s JOIN (" + SQL["l02_two_groups"] + ") l ON l.security = s.security) "
    + " UNION ALL ".join(f"SELECT '{t}' AS theme, security, records FROM g WHERE {_theme(t)}" for t in fl.THEMES))
def themes(v: Views):
    g = written(pe._grouped(v).select("security", "records", "ticker", "name", "category", "subcategory"), "grouped")  # the rules are worked out once, not in each filter
    one = lambda t: fl.thematic(g, t, "category", ["ticker", "name", "subcategory"], "records").select(F.lit(t).alias("theme"), "security", "records")
    return one("rate").union(one("equity"))


MODEL_ROLES = {"identity": ["portfolio", "report_dt", "manager"], "feature": ["stock", "beta", "tech", "d_stock", "d_beta", "d_tech", "turn_ratio"], "target": ["excess", "excess3"]}


@query("p10_model_eligibility", "SELECT portfolio, report_dt, manager, " + ", ".join(f"round({c}, 6) AS {c}" for c in [*MODEL_ROLES["feature"], *MODEL_ROLES["target"]])
    + " FROM {fx_actions} LEFT JOIN {fx_excess3} USING (portfolio, report_dt) WHERE coalesce(excess, excess3) IS NOT NULL AND coalesce(d_stock, d_beta, d_tech, stock, beta) IS NOT NULL")
def model_table(v: Views):
    rows = v.fx_actions.join(v.fx_excess3, ["portfolio", "report_dt"], "left")
    return fl.model_table(rows, MODEL_ROLES, ["excess", "excess3", "excess6"], ["d_stock", "d_beta", "d_tech", "stock", "beta"])


@query("p12_horizon_rows", """
SELECT portfolio, report_dt, round(excess, 6) AS excess, CASE WHEN excess >= 0.005 THEN 1 WHEN excess <= -0.005 THEN -1 ELSE 0 END::DOUBLE AS direction, CAST(date_trunc('month', report_dt) + INTERVAL 13 MONTH - INTERVAL 1 DAY AS DATE) AS label_end
FROM {fx_actions} WHERE excess IS NOT NULL AND CAST(date_trunc('month', report_dt) + INTERVAL 13 MONTH - INTERVAL 1 DAY AS DATE) <= DATE '1997-12-31'""")
def horizon_rows(v: Views):
    rows = mature_labels(v.fx_actions, "report_dt", 12, "1997-12-31").withColumn("direction", lb.direction(F.col("excess")))
    return fl.horizon_slice(rows, "report_dt", "excess", "direction", "label_end", "label_available").select("portfolio", "report_dt", "excess", "direction", "label_end")


PAIRS = {"stock_x_rate_change": ("stock", "rate_change"), "beta_x_volatility": ("beta", "market_vol"), "technology_x_trend": ("tech", "market_return"), "bond_x_rate_change": ("bond_money", "rate_change"), "deviation_x_volatility": ("deviation", "market_vol")}


@query("p17_interactions", "SELECT portfolio, report_dt, " + ", ".join(f"round({a} * {b}, 6) AS {n}" for n, (a, b) in PAIRS.items()) + " FROM {fx_actions} a LEFT JOIN {fx_regime} g ON a.report_dt = g.caldt")
def interactions(v: Views):
    rows = v.fx_actions.join(v.fx_regime.withColumnRenamed("caldt", "report_dt"), "report_dt", "left")
    return fl.interactions(rows, PAIRS).select("portfolio", "report_dt", *PAIRS)


@query("p16_scope_filter", "SELECT doc_id FROM {documents} WHERE regexp_matches(lower(coalesce(source, '') || ' ' || coalesce(text, '')), '" + "|".join(rt.SCOPES["macro_only"]) + "')")
def macro_documents(v: Views):
    return rt.in_scope(v.documents, "macro_only", "source", "text").select("doc_id")


@query("p16_micro_documents", "SELECT doc_id FROM {documents} WHERE regexp_matches(lower(coalesce(source, '') || ' ' || coalesce(text, '')), '" + "|".join(rt.SCOPES["micro_only"]) + "')")
def micro_documents(v: Views):
    return rt.in_scope(v.documents, "micro_only", "source", "text").select("doc_id")


@query("w22_leakage_checks", """
SELECT portfolio, report_dt, coalesce(available_dt < report_dt, false) AS available_ok, coalesce(style_end_dt < report_dt, false) AS style_ok, coalesce(score_end_dt < report_dt, false) OR NOT has_history AS manager_ok,
  coalesce(available_dt < report_dt, false) AND coalesce(style_end_dt < report_dt, false) AND (coalesce(score_end_dt < report_dt, false) OR NOT has_history) AS passed FROM {fx_case}""")
def leakage_checks(v: Views):
    a = fl.leakage_audit(v.fx_case, "report_dt", "available_dt", "style_end_dt", "score_end_dt", "has_history")
    return a.select("portfolio", "report_dt", F.col("availability_check_passed").alias("available_ok"), "style_ok", "manager_ok", F.col("leakage_check_passed").alias("passed"))


@query("l15_case_readiness", """
WITH w AS (SELECT portfolio, report_dt, list_filter([CASE WHEN event_id IS NULL THEN 'missing_event_id' END, CASE WHEN available_dt IS NULL THEN 'missing_feature_available_at' WHEN available_dt > report_dt THEN 'feature_available_after_event_anchor' END,
  CASE WHEN style_end_dt IS NULL THEN 'missing_style_window_end' WHEN style_end_dt >= report_dt THEN 'style_window_not_strictly_ex_ante' END, CASE WHEN passed IS NULL THEN 'dataset_availability_check_unverified' WHEN NOT passed THEN 'dataset_availability_check_failed' END,
  CASE WHEN NOT has_history THEN 'manager_history_unavailable_or_unverified' END, CASE WHEN style_obs = 'n/a' THEN 'style_observation_count_invalid' WHEN style_obs = '0' THEN 'style_baseline_has_no_observations' END], lambda x: x IS NOT NULL) AS w FROM {fx_case}),
h AS (SELECT *, len(list_intersect(w, ['missing_event_id', 'missing_report_date', 'feature_available_after_event_anchor', 'style_window_not_strictly_ex_ante', 'dataset_availability_check_failed'])) > 0 AS hard FROM w)
SELECT portfolio, report_dt, array_to_string(w, ';') AS warnings, CASE WHEN hard THEN 'failed' WHEN len(list_filter(w, lambda x: contains(x, 'unverified') OR contains(x, 'missing'))) > 0 THEN 'unverified' ELSE 'passed' END AS temporal_status,
  CASE WHEN hard THEN 'reject_until_temporal_or_identity_issue_is_fixed' WHEN len(w) > 0 THEN 'ready_for_critic_with_explicit_data_warnings' ELSE 'ready_for_reliability_aware_critic' END AS readiness FROM h""")
def case_readiness(v: Views):
    w = lb.case_warnings(*[F.col(c) for c in ("event_id", "report_dt", "available_dt", "style_end_dt", "passed", "has_history", "style_obs")])
    c = v.fx_case.withColumn("w", w)
    return c.select("portfolio", "report_dt", F.array_join("w", ";").alias("warnings"), lb.temporal_status(F.col("w")).alias("temporal_status"), lb.case_readiness(F.col("w")).alias("readiness"))


@query("l16_outcome_text", """
SELECT portfolio, report_dt, CASE WHEN excess IS NULL THEN 'unknown' WHEN excess > 0 THEN 'good' ELSE 'bad' END AS bucket,
  CASE WHEN excess IS NULL THEN 'Outcome unknown' WHEN excess > 0 THEN 'Good: future 12M positive excess' ELSE 'Bad: future 12M negative excess' END AS outcome FROM {fx_actions}""")
def outcome(v: Views):
    return v.fx_actions.select("portfolio", "report_dt", lb.outcome_bucket(F.col("excess")).alias("bucket"), lb.outcome_text(F.col("excess")).alias("outcome"))


@query("l18_calibration_warnings", """
WITH m AS (SELECT window_years, fold, avg((p - y) ** 2) AS brier, avg(p) AS mean_p, avg(y) AS rate FROM {fx_fold_scores} GROUP BY 1, 2)
SELECT a.window_years, a.fold, round(a.brier, 6) AS brier, round(b.brier, 6) AS before_brier, concat_ws(',', CASE WHEN a.brier > b.brier + 0.05 THEN 'test_brier_exceeds_validation_by_more_than_0.05' END,
  CASE WHEN abs(a.mean_p - a.rate) > 0.15 THEN 'calibrated_probability_mean_differs_from_actual_rate_by_more_than_0.15' END) AS warnings FROM m a LEFT JOIN m b ON a.window_years = b.window_years AND a.fold = b.fold + 1""")
def calibration_warnings(v: Views):
    m = v.fx_fold_scores.groupBy("window_years", "fold").agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))
    before = m.select("window_years", (F.col("fold") + 1).alias("fold"), F.col("brier").alias("before_brier"))
    w = fl.calibration_warnings(m.join(before, ["window_years", "fold"], "left"), "brier", "before_brier", "mean_p", "rate")
    return w.select("window_years", "fold", "brier", "before_brier", F.array_join("calibration_warnings", ",").alias("warnings"))


@query("m01_schema_issues", """
SELECT 'missing' AS issue, 'future_beta' AS feature UNION ALL SELECT 'forbidden', 'future_flow' UNION ALL
SELECT unnest(CASE WHEN k > 0 THEN ['all_null', 'non_numeric'] ELSE ['all_null'] END), f FROM (SELECT 'manager' AS f, count(manager) AS k, count(try_cast(manager AS DOUBLE)) AS n FROM {fx_events} UNION ALL SELECT 'bond', count(bond), count(bond) FROM {fx_events} UNION ALL SELECT 'nothing', 0, 0) WHERE n = 0""")
def schema_issues(v: Views):
    from fundtrace import contract

    e = v.fx_events.select("manager", "bond", F.lit(None).cast("double").alias("nothing"), F.col("flow").alias("future_flow"))
    return fl.schema_issues(e, ["manager", "bond", "nothing", "future_beta"], contract.forbidden(e.columns))


REGIME_RULES = {"high_rate": "rate_level >= rl", "rising_rate": "rate_change > 0", "high_volatility": "market_vol >= mv", "market_drawdown": "market_drawdown < md", "bull_trend": "market_return > 0", "bear_trend": "market_return < 0"}


@query("m22_regimes", """
WITH b AS (SELECT s.*, g.* EXCLUDE (caldt), CASE WHEN excess >= 0.005 THEN 1 WHEN excess <= -0.005 THEN -1 ELSE 0 END AS dir FROM {fx_fold_scores} s JOIN {fx_regime} g ON s.report_dt = g.caldt WHERE window_years = 0),
t AS (SELECT median(rate_level) AS rl, median(market_vol) AS mv, median(market_drawdown) AS md FROM b WHERE fold < 1997), k AS (SELECT unnest([""" + ", ".join(f"'{r}'" for r in REGIME_RULES) + """]) AS regime),
r AS (SELECT regime, (dir = 1)::INTEGER AS y, p, excess AS a, expected AS e FROM b, t, k WHERE fold >= 1997 AND dir <> 0 AND CASE regime """ + " ".join(f"WHEN '{r}' THEN {c}" for r, c in REGIME_RULES.items()) + """ END),
rk AS (SELECT *, rank() OVER (PARTITION BY regime ORDER BY a) + (count(*) OVER (PARTITION BY regime, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY regime ORDER BY e) + (count(*) OVER (PARTITION BY regime, e) - 1) / 2.0 AS re,
       sum(y) OVER w AS up_to, count(*) OVER w AS n_to FROM r WINDOW w AS (PARTITION BY regime ORDER BY p DESC)),
c AS (SELECT k.regime, count(y) AS n, coalesce(sum(y), 0)::BIGINT AS positives, avg((p - y) ** 2) AS brier, avg(abs(a - e)) AS mae, avg(CASE WHEN sign(a) = sign(e) THEN 1.0 WHEN y IS NOT NULL THEN 0 END) AS hit_rate, corr(ra, re) AS spearman,
       sum(y * up_to / n_to) / nullif(sum(y), 0) AS ap, (count(*) FILTER (y = 1 AND p >= 0.5) / nullif(count(*) FILTER (y = 1), 0) + count(*) FILTER (y = 0 AND p < 0.5) / nullif(count(*) FILTER (y = 0), 0)) / 2 AS ba FROM k LEFT JOIN rk USING (regime) GROUP BY 1),
u AS (SELECT regime, sum(CASE WHEN x.p > z.p THEN 1.0 WHEN x.p = z.p THEN 0.5 ELSE 0 END) / count(*) AS auc FROM r x JOIN r z USING (regime) WHERE x.y = 1 AND z.y = 0 GROUP BY 1),
o AS (SELECT *, n >= 50 AND positives > 0 AND positives < n AS ok FROM c LEFT JOIN u USING (regime))
SELECT regime, CASE WHEN ok THEN 'ok' ELSE 'insufficient_support' END AS status, n, positives, n - positives AS negatives, round(positives / nullif(n, 0), 6) AS positive_rate, """
    + ", ".join(f"CASE WHEN ok THEN round({c}, 6) END AS {n}" for n, c in (("auc", "auc"), ("average_precision", "ap"), ("brier", "brier"), ("balanced_accuracy", "ba"), ("mae", "mae"), ("spearman", "CASE WHEN isfinite(spearman) THEN spearman END"), ("hit_rate", "hit_rate"))) + " FROM o")
def regimes(v: Views):
    v.keep(*ACTIONS)
    b = v.fx_fold_scores.where("window_years = 0").join(v.fx_regime.withColumnRenamed("caldt", "report_dt"), "report_dt").withColumn("dir", lb.direction(F.col("excess")))
    b = written(b, "regime-rows")
    return fl.regime_metrics(b.where("fold < 1997"), b.where("fold >= 1997"), "dir", "p", "excess", "expected", 0.5)
