"""Queries of aggregations, selections, top lists and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fundtrace.operators import holdings as h
from fundtrace.operators import levels as lv
from fundtrace.operators.scores import percentiles_all
from fundtrace.plans.registry import Views, query


@query("a01_portfolio_month", "SELECT portfolio, caldt, round(avg(mret), 4) AS mret, round(sum(mtna), 2) AS mtna, round(sum(new_sls - redemp), 2) AS flow, min_by(manager, fund) AS manager FROM {fx_fund_month} GROUP BY 1, 2")
def portfolio_month(v: Views):
    return v.fx_fund_month.groupBy("portfolio", "caldt").agg(F.round(F.avg("mret"), 4).alias("mret"), F.round(F.sum("mtna"), 2).alias("mtna"), F.round(F.sum(F.col("new_sls") - F.col("redemp")), 2).alias("flow"), F.min_by("manager", "fund").alias("manager"))


BETAS = "SELECT ticker, round(covar_samp(ret, bret) / var_samp(bret), 9) AS beta FROM {fx_brand_month} JOIN {fx_benchmark} USING (month_idx) WHERE ticker <> 'Brand#4' GROUP BY 1"


def with_beta(v: Views):
    b = v.fx_brand_month.where("ticker != 'Brand#4'").join(v.fx_benchmark, "month_idx").groupBy("ticker").agg(F.round(F.covar_samp("ret", "bret") / F.var_samp("bret"), 9).alias("beta"))
    return v.fx_holdings.join(b, "ticker", "left")


@query("a02_report_rollup", "WITH b AS (" + BETAS + """)
SELECT portfolio, report_dt, count(*) AS n, count(beta) AS matched, round(sum(CASE WHEN beta IS NOT NULL THEN pct / 100 END), 6) AS matched_weight, round(sum(pct / 100 * beta), 6) AS weighted_beta,
       round(sum(CASE WHEN security_rank <= 10 THEN pct / 100 END), 6) AS top_weight, round(sum(value), 2) AS value FROM {fx_holdings} LEFT JOIN b USING (ticker) GROUP BY 1, 2""")
def report_rollup(v: Views):
    return h.report_rollup(with_beta(v)).drop("main_sector").withColumn("value", F.round("value", 2))


@query("a02_report_exposures", "WITH b AS (" + BETAS + """),
h AS (SELECT *, CASE WHEN sector = 'LARGE' THEN 'Information Technology' ELSE sector END AS sec, CASE sector WHEN 'STANDARD' THEN 'Bond / Credit / Money-related' WHEN 'PROMO' THEN 'Equity Fund / Stock-fund-like' ELSE '' END AS cat FROM {fx_holdings} LEFT JOIN b USING (ticker)),
s AS (SELECT portfolio, report_dt, sec AS main_sector, row_number() OVER (PARTITION BY portfolio, report_dt ORDER BY count(*) DESC, sec) AS k FROM h GROUP BY 1, 2, 3)
SELECT portfolio, report_dt, round(coalesce(sum(pct / 100 * beta), 0), 6) AS portfolio_beta, round(coalesce(sum(CASE WHEN sec LIKE '%Technology%' THEN pct / 100 END), 0), 6) AS technology, round(coalesce(sum(CASE WHEN security_rank <= 10 THEN pct / 100 END), 0), 6) AS top_holdings,
  round(coalesce(sum(CASE WHEN beta IS NOT NULL THEN pct / 100 END), 0), 6) AS company_equity, round(coalesce(sum(CASE WHEN cat LIKE 'Bond%' THEN pct / 100 END), 0), 6) AS bond_money, round(coalesce(sum(CASE WHEN cat LIKE 'Equity%' THEN pct / 100 END), 0), 6) AS indirect_equity,
  count(*) AS holdings, count(beta) AS beta_matched, count(*) FILTER (cat <> '') AS category_matched, any_value(main_sector) AS main_sector FROM h JOIN s USING (portfolio, report_dt) WHERE k = 1 GROUP BY 1, 2""")
def report_exposures(v: Views):
    sector, category = F.col("sector"), F.when(F.col("sector") == "STANDARD", h.BOND_MONEY).when(F.col("sector") == "PROMO", h.INDIRECT).otherwise("")
    rows = with_beta(v).withColumn("category", category).withColumn("sector", F.when(sector == "LARGE", "Information Technology").otherwise(sector))
    return h.report_exposures(rows)


@query("a03_beta_shares", "WITH b AS (" + BETAS + """)
SELECT portfolio, report_dt, security, round(sum(pct / 100 * beta) OVER w, 6) AS report_beta, round(pct / 100 * beta / nullif(sum(pct / 100 * beta) OVER w, 0), 5) AS beta_share FROM {fx_holdings} LEFT JOIN b USING (ticker) WINDOW w AS (PARTITION BY portfolio, report_dt)""")
def beta_shares(v: Views):
    return h.beta_shares(with_beta(v)).select("portfolio", "report_dt", "security", "report_beta", F.round("beta_share", 5).alias("beta_share"))


MEASURES = """count(mret) AS n, round(exp(sum(ln(1 + mret)) * 12 / count(mret)) - 1, 5) AS annual, round(stddev_samp(mret) * sqrt(12), 5) AS volatility, round(avg(mret) * 12 / nullif(stddev_samp(mret) * sqrt(12), 0), 4) AS sharpe,
  round(avg(CASE WHEN mret > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, round(avg(CASE WHEN mret - bret > 0 THEN 1.0 ELSE 0 END), 6) AS beat_rate, round(stddev_samp(mret - bret) * sqrt(12), 5) AS tracking_error,
  round(covar_samp(mret, bret) / nullif(var_samp(bret), 0), 4) AS beta, round(corr(mret, bret), 4) AS correlation, round(quantile_cont(mret, 0.05), 6) AS var_5, round(min(mret), 6) AS worst, round(max(mret), 6) AS best,
  round((avg(mret ** 3) - 3 * avg(mret) * avg(mret ** 2) + 2 * avg(mret) ** 3) / nullif(var_pop(mret) ** 1.5, 0), 3) AS skew"""


def _with_market(v: Views):
    return v.fx_fund_month.join(v.fx_benchmark.drop("caldt"), "month_idx")


@query("a04_fund_measures", "SELECT fund, " + MEASURES + " FROM {fx_fund_month} JOIN {fx_benchmark} USING (month_idx) GROUP BY 1")
def fund_measures(v: Views):
    m = lv.fund_measures(_with_market(v), "fund", "mret", "bret")
    five, four = ("annual", "volatility", "tracking_error"), ("sharpe", "beta", "correlation")
    return m.select("fund", "n", "win_rate", "beat_rate", "var_5", "worst", "best", F.round("skew", 3).alias("skew"), *[F.round(c, 5).alias(c) for c in five], *[F.round(c, 4).alias(c) for c in four])


FUND_ROWS = "f AS (SELECT fund, month_idx, mret, bret, mtna, new_sls - redemp AS net_flow, exp_ratio, (month_idx - 23904) / 12.0 AS tenure, turn_ratio FROM {fx_fund_month} LEFT JOIN {fx_benchmark} USING (month_idx))"
FUND_DIGITS = {4: "sharpe sortino information_ratio beta alpha up_capture down_capture correlation kurtosis skewness annual_return cumulative_return annual_excess".split(), 2: "avg_mtna avg_net_flow sum_net_flow".split()}


@query("a04_fund_table", f"WITH {FUND_ROWS}" + """,
c AS (SELECT *, sum(ln(1 + mret)) OVER (PARTITION BY fund ORDER BY month_idx) AS c, avg(mret) OVER (PARTITION BY fund) AS mu FROM f), p AS (SELECT *, c - greatest(0, max(c) OVER (PARTITION BY fund ORDER BY month_idx)) AS fall FROM c),
q AS (SELECT fund, quantile_cont(mret, 0.05) AS q FROM f GROUP BY 1), v AS (SELECT fund, avg(mret) AS cvar FROM f JOIN q USING (fund) WHERE mret <= q GROUP BY 1),
m AS (SELECT fund, count(*) AS obs, avg(mret) AS mean_return, (1 + avg(mret)) ** 12 - 1 AS annual_return, exp(sum(ln(1 + mret))) - 1 AS cumulative_return, stddev_samp(mret) * sqrt(12) AS annual_volatility,
  stddev_samp(CASE WHEN mret < 0 THEN mret END) * sqrt(12) AS down, exp(min(fall)) - 1 AS max_drawdown, avg((mret > 0)::INT) AS win_rate, avg((mret > bret)::INT) AS beat_rate, (1 + avg(mret - bret)) ** 12 - 1 AS annual_excess,
  stddev_samp(mret - bret) * sqrt(12) AS tracking_error, CASE WHEN count(*) > 1 THEN covar_pop(mret, bret) / nullif(var_pop(bret), 0) END AS beta, avg(bret) AS mb,
  avg(CASE WHEN bret > 0 THEN mret END) / nullif(avg(CASE WHEN bret > 0 THEN bret END), 0) AS up_capture, avg(CASE WHEN bret < 0 THEN mret END) / nullif(avg(CASE WHEN bret < 0 THEN bret END), 0) AS down_capture,
  CASE WHEN count(*) > 1 AND var_pop(mret) > 0 AND var_pop(bret) > 0 THEN covar_pop(mret, bret) / (stddev_pop(mret) * stddev_pop(bret)) END AS correlation,
  CASE WHEN count(*) >= 2 THEN quantile_cont(mret, 0.05) END AS var_5, CASE WHEN count(*) >= 3 AND var_pop(mret) > 0 THEN avg((mret - mu) ** 3) / var_pop(mret) ** 1.5 END AS skewness, CASE WHEN count(*) >= 4 AND var_pop(mret) > 0 THEN avg((mret - mu) ** 4) / var_pop(mret) ** 2 - 3 END AS kurtosis,
  avg(mtna) AS avg_mtna, avg(net_flow) AS avg_net_flow, sum(net_flow) AS sum_net_flow, avg(exp_ratio) AS avg_exp_ratio, avg(tenure) AS avg_tenure, avg(turn_ratio) AS avg_turnover FROM p GROUP BY 1),
k AS (SELECT *, (annual_return - 0.01) / nullif(annual_volatility, 0) AS sharpe, (annual_return - 0.01) / nullif(down, 0) AS sortino, annual_excess / nullif(tracking_error, 0) AS information_ratio, (1 + mean_return - beta * mb) ** 12 - 1 AS alpha, CASE WHEN obs >= 2 THEN cvar END AS cvar_5 FROM m LEFT JOIN v USING (fund))
SELECT fund, obs, """ + ", ".join(f"round({c}, {d}) AS {c}" for d, cs in (FUND_DIGITS | {6: "mean_return annual_volatility max_drawdown win_rate beat_rate tracking_error var_5 cvar_5 avg_exp_ratio avg_tenure avg_turnover".split()}).items() for c in cs) + " FROM k")
def fund_table(v: Views):
    rows = v.fx_fund_month.join(v.fx_benchmark.drop("caldt"), "month_idx", "left").withColumns({"net_flow": F.col("new_sls") - F.col("redemp"), "tenure": (F.col("month_idx") - 23904) / 12})
    t = lv.fund_table(rows, "fund", "month_idx", "mret", "bret", "mtna", "net_flow", "exp_ratio", "tenure", "turn_ratio")
    return t.withColumns({c: F.round(c, d) for d, cs in FUND_DIGITS.items() for c in cs})


@query("a04_tail_mean", "SELECT fund, round(avg(mret), 6) AS cvar FROM {fx_fund_month} JOIN (SELECT fund, quantile_cont(mret, 0.05) AS q FROM {fx_fund_month} GROUP BY 1) USING (fund) WHERE mret <= q GROUP BY 1")
def tail_mean(v: Views):
    return lv.tail_mean(v.fx_fund_month, "fund", "mret")


@query("a05_family_averages", """
SELECT fund, f.family, n_funds, round(f.exp_ratio - a.fee, 6) AS fee_gap FROM (SELECT fund, family, avg(exp_ratio) AS exp_ratio FROM {fx_fund_month} GROUP BY 1, 2) f JOIN (SELECT family, count(DISTINCT fund) AS n_funds, avg(exp_ratio) AS fee FROM {fx_fund_month} GROUP BY 1) a USING (family)""")
def family_averages(v: Views):
    f = v.fx_fund_month.groupBy("fund", "family").agg(F.avg("exp_ratio").alias("own"))
    a = v.fx_fund_month.groupBy("family").agg(F.countDistinct("fund").alias("n_funds"), F.avg("exp_ratio").alias("fee"))
    return f.join(a, "family").select("fund", "family", "n_funds", (F.col("own") - F.col("fee")).alias("fee_gap"))


def _indicator_score(c: str, up: bool) -> str:
    rank = f"(rank() OVER (ORDER BY round({c}, 9) NULLS LAST) + (count(*) OVER (PARTITION BY round({c}, 9)) - 1) / 2.0) / count({c}) OVER ()"
    return f"round(CASE WHEN {c} IS NULL THEN 0.5 ELSE {'' if up else '1 - '}{rank} END, 6) AS score_{c}"


INDICATOR_DIGITS = {4: ("sharpe",), 2: ("avg_mtna", "avg_flow"), 6: ("mean_return", "annual_return", "avg_excess", "beat_rate", "annual_volatility", "max_drawdown", "avg_fee", "avg_tenure", "avg_turnover")}


@query("a06_manager_indicators", """WITH f AS (SELECT *, new_sls - redemp AS net_flow, (month_idx - 23904) / 12.0 AS tenure FROM {fx_fund_month} LEFT JOIN (SELECT month_idx, bret FROM {fx_benchmark}) USING (month_idx)),
c AS (SELECT *, sum(ln(1 + mret)) OVER (PARTITION BY manager ORDER BY month_idx, fund) AS c FROM f), p AS (SELECT *, c - greatest(0, max(c) OVER (PARTITION BY manager ORDER BY month_idx, fund)) AS fall FROM c),
m AS (SELECT manager, count(*) AS obs, count(DISTINCT fund) AS funds, count(DISTINCT family) AS families, avg(mret) AS mean_return, (1 + avg(mret)) ** 12 - 1 AS annual_return, avg(mret - bret) AS avg_excess, avg((mret > bret)::INT) AS beat_rate, stddev_samp(mret) * sqrt(12) AS annual_volatility,
  ((1 + avg(mret)) ** 12 - 1 - 0.01) / nullif(stddev_samp(mret) * sqrt(12), 0) AS sharpe, exp(min(fall)) - 1 AS max_drawdown, avg(exp_ratio) AS avg_fee, avg(net_flow) AS avg_flow, avg(mtna) AS avg_mtna, avg(tenure) AS avg_tenure, avg(turn_ratio) AS avg_turnover FROM p GROUP BY 1)
SELECT manager, obs, funds, families, """ + ", ".join(f"round({c}, {d}) AS {c}" for d, cs in INDICATOR_DIGITS.items() for c in cs) + ", " + ", ".join(_indicator_score(c, up) for c, up in lv.INDICATORS.items()) + " FROM m")
def manager_indicators(v: Views):
    rows = v.fx_fund_month.join(v.fx_benchmark.drop("caldt"), "month_idx", "left").withColumns({"net_flow": F.col("new_sls") - F.col("redemp"), "tenure": (F.col("month_idx") - 23904) / 12})
    t = lv.manager_indicators(rows, "manager", "fund", "family", "month_idx", "mret", "bret", "mtna", "net_flow", "exp_ratio", "tenure", "turn_ratio")
    return t.withColumns({c: F.round(c, d) for d, cs in INDICATOR_DIGITS.items() for c in cs})


@query("a06_manager_base", "SELECT manager, count(DISTINCT portfolio) AS portfolios, round(avg(mret) * 12, 6) AS mean_return, round(stddev_samp(mret) * sqrt(12), 6) AS volatility, round(avg(turn_ratio), 6) AS turnover FROM {fx_port_month} GROUP BY 1")
def manager_base(v: Views):
    return v.fx_port_month.groupBy("manager").agg(F.countDistinct("portfolio").alias("portfolios"), (F.avg("mret") * 12).alias("mean_return"), (F.stddev_samp("mret") * 12**0.5).alias("volatility"), F.avg("turn_ratio").alias("turnover"))


@query("a08_security_universe", """
SELECT ticker, count(DISTINCT security) AS securities, min(first_dt) AS first_dt, max(last_dt) AS last_dt, sum(records)::BIGINT AS records, (SELECT string_agg(n, '|' ORDER BY n) FROM (SELECT DISTINCT name AS n FROM {fx_items} x WHERE x.ticker = i.ticker ORDER BY n LIMIT 5)) AS names FROM {fx_items} i GROUP BY ticker""")
def security_universe(v: Views):
    names = F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, 5), "|")
    return v.fx_items.groupBy("ticker").agg(F.countDistinct("security").alias("securities"), F.min("first_dt").alias("first_dt"), F.max("last_dt").alias("last_dt"), F.sum("records").alias("records"), names.alias("names"))


@query("a11_active_year_panel", """
WITH x AS (SELECT kind, records, year(first_dt)::BIGINT AS a, year(last_dt)::BIGINT AS b FROM {fx_items}), y AS (SELECT kind, unnest(generate_series(a, b)) AS year, records * 1.0 / (b - a + 1) AS part FROM x)
SELECT kind, year::INTEGER AS year, count(*) AS active, round(sum(part), 4) AS records FROM y GROUP BY 1, 2""")
def active_year_panel(v: Views):
    first, last = F.year("first_dt"), F.year("last_dt")
    y = v.fx_items.select("kind", F.explode(F.sequence(first, last)).alias("year"), (F.col("records") / (last - first + 1)).alias("part"))
    return y.groupBy("kind", "year").agg(F.count("*").alias("active"), F.round(F.sum("part"), 4).alias("records"))


@query("a12_sector_pivot", "SELECT portfolio, report_dt, " + ", ".join(f"round(sum(CASE WHEN sector = '{s}' THEN pct / 100 ELSE 0 END), 6) AS \"{s}\"" for s in h.SECTORS) + " FROM {fx_holdings} GROUP BY 1, 2")
def sector_pivot(v: Views):
    return h.sector_weights(v.fx_holdings, h.SECTORS)


@query("a13_year_share_pivot", """
SELECT year(report_dt)::INTEGER AS year, round(sum(CASE WHEN sector IN ('SMALL', 'MEDIUM') THEN value ELSE 0 END) / nullif(sum(value), 0), 6) AS small_share, round(sum(CASE WHEN sector NOT IN ('SMALL', 'MEDIUM') THEN value ELSE 0 END) / nullif(sum(value), 0), 6) AS large_share FROM {fx_holdings} GROUP BY 1""")
def year_share_pivot(v: Views):
    group = F.when(F.col("sector").isin("SMALL", "MEDIUM"), "small").otherwise("large")
    p = v.fx_holdings.withColumn("g", group).groupBy(F.year("report_dt").alias("year")).pivot("g", ["small", "large"]).agg(F.sum("value")).na.fill(0.0)
    total = F.nullif(F.col("small") + F.col("large"), F.lit(0.0))
    return p.select("year", (F.col("small") / total).alias("small_share"), (F.col("large") / total).alias("large_share"))


@query("a14_allocation_trend", """
SELECT year(report_dt)::INTEGER AS year, quarter(report_dt)::INTEGER AS quarter, count(*) AS n, round(avg(stock), 6) AS stock, round(avg(bond), 6) AS bond, round(avg(stock) - avg(bond), 6) AS gap FROM {fx_allocation} GROUP BY 1, 2""")
def allocation_trend(v: Views):
    return v.fx_allocation.groupBy(F.year("report_dt").alias("year"), F.quarter("report_dt").alias("quarter")).agg(F.count("*").alias("n"), F.avg("stock").alias("stock"), F.avg("bond").alias("bond"), (F.avg("stock") - F.avg("bond")).alias("gap"))


@query("a15_period_summary", """
WITH r AS (SELECT CASE WHEN year(report_dt) < 1997 THEN 'early' WHEN year(report_dt) < 2000 THEN 'middle' ELSE 'late' END AS period, * FROM {fx_holdings})
SELECT period, min(year(report_dt))::INTEGER AS first_year, max(year(report_dt))::INTEGER AS last_year, count(DISTINCT portfolio || '|' || report_dt) AS reports, count(DISTINCT portfolio) AS portfolios, count(*) AS holdings FROM r GROUP BY 1""")
def period_summary(v: Views):
    y = F.year("report_dt")
    r = v.fx_holdings.withColumn("period", F.when(y < 1997, "early").when(y < 2000, "middle").otherwise("late"))
    per = r.groupBy("period", "portfolio", "report_dt").agg(F.count("*").alias("k"))
    return per.groupBy("period").agg(F.min(y).alias("first_year"), F.max(y).alias("last_year"), F.count("*").alias("reports"), F.countDistinct("portfolio").alias("portfolios"), F.sum("k").alias("holdings"))


@query("a16_top_holdings", "SELECT security, count(*) AS n, round(sum(value), 2) AS value, round(avg(pct), 6) AS pct FROM {fx_holdings} GROUP BY 1 ORDER BY 3 DESC, 2 DESC, 1 LIMIT 15")
def top_holdings(v: Views):
    return v.fx_holdings.groupBy("security").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"), F.avg("pct").alias("pct")).orderBy(F.desc("value"), F.desc("n"), "security").limit(15)


@query("a17_manager_allocation", """
SELECT e.manager, count(DISTINCT e.portfolio) AS portfolios, count(*) AS reports, round(avg(coalesce(stock, 0)), 6) AS stock, round(avg(bond), 6) AS bond, round(avg(coalesce(stock, 0)) / nullif(avg(bond), 0), 6) AS ratio FROM {fx_events} e GROUP BY 1""")
def manager_allocation(v: Views):
    s = F.coalesce("stock", F.lit(0.0))
    return v.fx_events.groupBy("manager").agg(F.countDistinct("portfolio").alias("portfolios"), F.count("*").alias("reports"), F.avg(s).alias("stock"), F.avg("bond").alias("bond"), (F.avg(s) / F.nullif(F.avg("bond"), F.lit(0.0))).alias("ratio"))


@query("a18_style_drift", "SELECT manager, year(caldt)::INTEGER AS year, round(avg(turn_ratio), 6) AS turnover, round(avg(exp_ratio), 6) AS fee, round(stddev_samp(mret) * sqrt(12), 6) AS volatility FROM {fx_port_month} GROUP BY 1, 2")
def style_drift(v: Views):
    return v.fx_port_month.groupBy("manager", F.year("caldt").alias("year")).agg(F.avg("turn_ratio").alias("turnover"), F.avg("exp_ratio").alias("fee"), (F.stddev_samp("mret") * 12**0.5).alias("volatility"))


@query("a19_manager_counts", """
WITH a AS (SELECT manager, count(DISTINCT fund) AS a FROM {fx_fund_month} WHERE mret > 0.02 GROUP BY 1), b AS (SELECT manager, count(DISTINCT fund) AS b FROM {fx_fund_month} WHERE mret < -0.03 GROUP BY 1)
SELECT coalesce(a.manager, b.manager) AS manager, coalesce(a, 0) AS in_a, coalesce(b, 0) AS in_b FROM a FULL JOIN b ON a.manager = b.manager""")
def manager_counts(v: Views):
    a, b = (v.fx_fund_month.where(c).groupBy("manager").agg(F.countDistinct("fund").alias(n)) for c, n in (("mret > 0.02", "in_a"), ("mret < -0.03", "in_b")))
    return a.join(b, "manager", "full").na.fill(0, ["in_a", "in_b"])


@query("a20_collapsed_identities", "SELECT portfolio, report_dt, ticker AS identity, round(sum(pct), 5) AS pct, round(sum(value), 2) AS value, min(security_rank) AS security_rank FROM {fx_holdings} GROUP BY 1, 2, 3")
def collapsed_identities(v: Views):
    return h.collapse_identities(v.fx_holdings.withColumn("beta", F.lit(None).cast("double")), F.col("ticker")).select("portfolio", "report_dt", "identity", F.round("pct", 5).alias("pct"), F.round("value", 2).alias("value"), "security_rank")


@query("a21_action_fingerprint", """
SELECT manager, count(*) FILTER (d_bond > 0) AS ups, count(*) FILTER (d_bond < 0) AS downs, round(sum(d_bond), 6) AS net, round(sum(abs(d_bond)), 6) AS gross, (max(report_dt) - min(report_dt))::BIGINT AS span FROM {fx_events} GROUP BY 1""")
def action_fingerprint(v: Views):
    d = F.col("d_bond")
    return v.fx_events.groupBy("manager").agg(F.count_if(d > 0).alias("ups"), F.count_if(d < 0).alias("downs"), F.sum(d).alias("net"), F.sum(F.abs(d)).alias("gross"), F.datediff(F.max("report_dt"), F.min("report_dt")).cast("long").alias("span"))


@query("a25_timeline", "SELECT manager, report_dt, round(avg(stock), 6) AS stock, round(avg(bond), 6) AS bond, round(avg(cash), 6) AS cash, round(avg(mret), 6) AS mret FROM {fx_events} GROUP BY 1, 2")
def timeline(v: Views):
    return v.fx_events.groupBy("manager", "report_dt").agg(*[F.avg(c).alias(c) for c in ("stock", "bond", "cash", "mret")])


QC = ("stock", "bond", "cash", "d_bond")


@query("a26_qc_summary", " UNION ALL ".join(f"SELECT '{c}' AS measure, count({c}) AS n, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END), 6) AS null_rate, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.01), 6) AS p01, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.99), 6) AS p99 FROM {{fx_events}}" for c in QC))
def qc_summary(v: Views):
    long = v.fx_events.select("portfolio", *QC).unpivot(["portfolio"], list(QC), "measure", "x")
    p = lambda q: F.percentile("x", F.lit(q))
    return long.groupBy("measure").agg(F.count("x").alias("n"), F.avg(F.col("x").isNull().cast("double")).alias("null_rate"), F.avg("x").alias("mean"), p(0.01).alias("p01"), p(0.5).alias("p50"), p(0.99).alias("p99"))


@query("a30_value_quintiles", """
WITH q AS (SELECT list_sort(list_distinct(quantile_cont(turn_ratio, [0.2, 0.4, 0.6, 0.8]))) AS e FROM {fx_events})
SELECT (1 + len(list_filter(e, lambda x: x < turn_ratio)))::INTEGER AS bucket, count(*) AS n, round(avg(mret), 6) AS mret FROM {fx_events}, q GROUP BY 1""")
def value_quintiles(v: Views):
    edges = sorted({e for e in percentiles_all(v.fx_events, "turn_ratio", [0.2, 0.4, 0.6, 0.8]) if e is not None})
    at = (F.size(F.filter(F.array(*map(F.lit, edges)), lambda x: x < F.col("turn_ratio"))) + 1).alias("bucket")
    return v.fx_events.groupBy(at).agg(F.count("*").alias("n"), F.avg("mret").alias("mret"))


@query("a31_yearly_trend", "SELECT year(report_dt)::INTEGER AS year, count(*) AS n, round(avg(d_bond), 6) AS mean, round(avg(CASE WHEN d_bond > 0 THEN 1.0 WHEN d_bond IS NOT NULL THEN 0 END), 6) AS positive FROM {fx_events} GROUP BY 1")
def yearly_trend(v: Views):
    return v.fx_events.groupBy(F.year("report_dt").alias("year")).agg(F.count("*").alias("n"), F.avg("d_bond").alias("mean"), F.avg((F.col("d_bond") > 0).cast("double")).alias("positive"))


@query("a32_shared_histogram", """
WITH e AS (SELECT quantile_cont(mret, 0.005) AS lo, quantile_cont(mret, 0.995) AS hi FROM {fx_fund_month})
SELECT family, least(29, greatest(0, floor((mret - lo) / (hi - lo) * 30)))::INTEGER AS bin, count(*) AS count FROM {fx_fund_month}, e GROUP BY 1, 2""")
def shared_histogram(v: Views):
    return lv.shared_histogram(v.fx_fund_month, "family", "mret")


@query("a33_headline", "SELECT count(*) AS n, count(DISTINCT fund) AS funds, round(avg(mret), 6) AS mean, round(avg(CASE WHEN mret > 0 THEN 1.0 ELSE 0 END), 6) AS positive, min(caldt) AS first_dt, max(caldt) AS last_dt FROM {fx_fund_month}")
def headline(v: Views):
    return v.fx_fund_month.agg(F.count("*").alias("n"), F.countDistinct("fund").alias("funds"), F.avg("mret").alias("mean"), F.avg((F.col("mret") > 0).cast("double")).alias("positive"), F.min("caldt").alias("first_dt"), F.max("caldt").alias("last_dt"))


@query("a39_value_counts", "SELECT source, lang, count(*) AS n FROM {documents} GROUP BY 1, 2")
def value_counts(v: Views):
    return v.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("p04_box_filter", "SELECT fund, caldt FROM {fx_fund_month} WHERE exp_ratio BETWEEN 0.03 AND 0.05 AND turn_ratio BETWEEN 0.4 AND 0.6")
def box_filter(v: Views):
    return v.fx_fund_month.where(lv.box("exp_ratio", "turn_ratio", (0.05, 0.4, 0.03, 0.6))).select("fund", "caldt")


REGIONS = "fund {op} (SELECT fund FROM {fx_fund_month} GROUP BY 1 HAVING avg(exp_ratio) > 0.04) {join} family IN (SELECT family FROM {fx_fund_month} GROUP BY 1 HAVING avg(turn_ratio) > 0.509)"


def _regions(v: Views, every: bool):
    f = v.fx_fund_month.groupBy("fund").agg(F.avg("exp_ratio").alias("fee"))
    g = v.fx_fund_month.groupBy("family").agg(F.avg("turn_ratio").alias("turnover"))
    return lv.by_regions(v.fx_fund_month, [(f, "fund", F.col("fee") > 0.04), (g, "family", F.col("turnover") > 0.509)], every).select("fund", "caldt")


@query("p05_regions_and", "SELECT fund, caldt FROM {fx_fund_month} WHERE " + REGIONS.replace("{op}", "IN").replace("{join}", "AND"))
def regions_and(v: Views):
    return _regions(v, True)


@query("p05_regions_or", "SELECT fund, caldt FROM {fx_fund_month} WHERE " + REGIONS.replace("{op}", "IN").replace("{join}", "OR"))
def regions_or(v: Views):
    return _regions(v, False)


@query("p07_holding_filter", "SELECT portfolio, report_dt, security FROM {fx_holdings} WHERE security_rank BETWEEN 1 AND 5 AND contains(lower(concat_ws(' ', name, ticker, sector)), 'ring')")
def holding_filter(v: Views):
    return v.fx_holdings.where(F.col("security_rank").between(1, 5) & F.lower(F.concat_ws(" ", "name", "ticker", "sector")).contains("ring")).select("portfolio", "report_dt", "security")


@query("p08_year_overlap", "SELECT security FROM {fx_items} WHERE year(first_dt) <= 1999 AND year(last_dt) >= 1998")
def year_overlap(v: Views):
    return v.fx_items.where((F.year("first_dt") <= 1999) & (F.year("last_dt") >= 1998)).select("security")


@query("p13_selection_cascade", """
WITH r AS (SELECT DISTINCT portfolio, report_dt, 1 AS lvl FROM {fx_events} WHERE bond > 0.9), m AS (SELECT DISTINCT portfolio, report_dt, 2 AS lvl FROM {fx_events} WHERE manager = 'NATION_3'), f AS (SELECT DISTINCT portfolio, report_dt, 3 AS lvl FROM {fx_events} WHERE portfolio < 5),
     a AS (SELECT * FROM r UNION ALL SELECT * FROM m UNION ALL SELECT * FROM f)
SELECT portfolio, report_dt, lvl AS level FROM a WHERE lvl = (SELECT min(lvl) FROM a)""")
def selection_cascade(v: Views):
    parts = [v.fx_events.where(c).select("portfolio", "report_dt", F.lit(i).alias("level")) for i, c in enumerate(("bond > 0.9", "manager = 'NATION_3'", "portfolio < 5"), 1)]
    a = parts[0].union(parts[1]).union(parts[2])
    return a.join(F.broadcast(a.agg(F.min("level").alias("level"))), "level", "left_semi").select("portfolio", "report_dt", "level").distinct()


@query("p18_event_id", r"SELECT portfolio, report_dt, '3y__' || left(regexp_replace(lower(manager), '[^a-z0-9]+', '_', 'g'), 40) || '__' || portfolio || '__' || strftime(report_dt, '%Y%m%d') AS event_id FROM {fx_events}")
def event_id(v: Views):
    slug = F.substring(F.regexp_replace(F.lower("manager"), r"[^a-z0-9]+", "_"), 1, 40)
    return v.fx_events.select("portfolio", "report_dt", F.concat_ws("__", F.lit("3y"), slug, F.col("portfolio").cast("string"), F.date_format("report_dt", "yyyyMMdd")).alias("event_id"))


@query("p20_complete_allocation", """
SELECT portfolio, report_dt, round(coalesce(stock, 0.4), 6) AS stock_full, round(coalesce(cash, 0), 6) AS cash_full, CASE WHEN stock IS NULL AND cash IS NULL THEN 'stock_proxy;cash_zero' WHEN stock IS NULL THEN 'stock_proxy' WHEN cash IS NULL THEN 'cash_zero' ELSE 'reported' END AS method FROM {fx_allocation}""")
def complete_allocation(v: Views):
    return h.complete_allocation(v.fx_allocation.withColumn("proxy", F.lit(0.4)), "proxy").select("portfolio", "report_dt", "stock_full", "cash_full", "method")


@query("p21_display_allocation", """
SELECT portfolio, report_dt, round(CASE WHEN coalesce(stock, 0) + bond + coalesce(cash, 0) < 1 THEN 1 - coalesce(stock, 0) - coalesce(cash, 0) ELSE bond END, 6) AS bond_shown, round(bond / (coalesce(stock, 0) + bond + coalesce(cash, 0)), 6) AS bond_share FROM {fx_allocation}""")
def display_allocation(v: Views):
    return h.normalise_allocation(h.display_allocation(v.fx_allocation)).select("portfolio", "report_dt", "bond_shown", "bond_share")


@query("k01_top_per_group", "SELECT kind, security, records FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY records DESC, security) AS n FROM {fx_items}) WHERE n <= 50")
def top_per_group(v: Views):
    n = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("records"), "security"))
    return v.fx_items.withColumn("n", n).where("n <= 50").select("kind", "security", "records")


@query("k05_largest_gaps", "SELECT doc_id, round(p, 6) AS p FROM {fx_scores} ORDER BY abs(2 * p - 1) DESC, doc_id LIMIT 30")
def largest_gaps(v: Views):
    return v.fx_scores.orderBy(F.abs(2 * F.col("p") - 1).desc(), "doc_id").limit(30).select("doc_id", "p")


@query("k09_latest_row", "SELECT portfolio, max(report_dt) AS report_dt, round(max_by(bond, report_dt), 6) AS bond FROM {fx_allocation} GROUP BY 1")
def latest_row(v: Views):
    return v.fx_allocation.groupBy("portfolio").agg(F.max("report_dt").alias("report_dt"), F.max_by("bond", "report_dt").alias("bond"))


@query("u02_set_logic", "SELECT fund FROM {fx_fund_month} WHERE mret > 0.02 INTERSECT SELECT fund FROM {fx_fund_month} WHERE mret < -0.03")
def set_logic(v: Views):
    return v.fx_fund_month.where("mret > 0.02").select("fund").intersect(v.fx_fund_month.where("mret < -0.03").select("fund"))


@query("u03_distinct_entities", "SELECT DISTINCT family, manager FROM {fx_fund_month}")
def distinct_entities(v: Views):
    return v.fx_fund_month.select("family", "manager").distinct()


@query("u06_missing_keys", "SELECT DISTINCT p_brand FROM {part} EXCEPT SELECT ticker FROM {fx_brand_month} WHERE ret > 0.01")
def missing_keys(v: Views):
    return v.part.select("p_brand").distinct().join(v.fx_brand_month.where("ret > 0.01").select(F.col("ticker").alias("p_brand")).distinct(), "p_brand", "left_anti")
