"""Queries of the monthly windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fundtrace.operators import timeseries as ts
from fundtrace.plans.registry import Views, query


@query("w01_trailing_return", """
WITH t AS (SELECT fund, caldt, f.month_idx, count(mret) OVER w AS n, sum(ln(1 + mret)) OVER w AS s, count(bret) OVER w AS bn, sum(ln(1 + bret)) OVER w AS bs
           FROM {fx_fund_month} f LEFT JOIN {fx_benchmark} b USING (month_idx, caldt)
           WINDOW w AS (PARTITION BY fund ORDER BY f.month_idx RANGE BETWEEN 36 PRECEDING AND 1 PRECEDING))
SELECT fund, caldt, round(CASE WHEN n >= 25 THEN exp(s * 12 / n) - 1 END, 6) AS annual, round(CASE WHEN n >= 25 THEN exp(s) - 1 END, 6) AS period,
       round(CASE WHEN bn >= 25 THEN exp(bs * 12 / bn) - 1 END, 6) AS market,
       round(CASE WHEN n >= 25 THEN exp(s * 12 / n) - 1 END - CASE WHEN bn >= 25 THEN exp(bs * 12 / bn) - 1 END, 6) AS excess FROM t""")
def trailing_return(v: Views):
    df = v.fx_fund_month.join(F.broadcast(v.fx_benchmark), ["month_idx", "caldt"], "left")
    w = ts.trailing(["fund"], "month_idx", 36)
    out = df.select("fund", "caldt", ts.compounded("mret", w, 25, annual=True).alias("annual"), ts.compounded("mret", w, 25).alias("period"), ts.compounded("bret", w, 25, annual=True).alias("market"))
    return out.withColumn("excess", F.col("annual") - F.col("market"))


@query("w01_current_row_frame", """
SELECT fund, caldt, round(CASE WHEN count(mret) OVER w >= 9 THEN exp(sum(ln(1 + mret)) OVER w) - 1 END, 6) AS period FROM {fx_fund_month}
WINDOW w AS (PARTITION BY fund ORDER BY month_idx ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def current_row_frame(v: Views):
    w = ts.trailing(["fund"], "month_idx", 12, include_current=True, row_based=True)
    return v.fx_fund_month.select("fund", "caldt", ts.compounded("mret", w, 9).alias("period"))


@query("w02_market_trailing", """
SELECT caldt, round(CASE WHEN count(bret) OVER w >= 9 THEN exp(sum(ln(1 + bret)) OVER w) - 1 END, 6) AS market_12m FROM {fx_benchmark}
WINDOW w AS (ORDER BY month_idx RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING)""")
def market_trailing(v: Views):
    # one row a month for the whole market: a few thousand rows in a century, so one partition holds it
    return v.fx_benchmark.select("caldt", ts.compounded("bret", ts.trailing([], "month_idx", 12), 9).alias("market_12m"))


@query("w03_factor_averages", """
SELECT portfolio, caldt, round(CASE WHEN count(exp_ratio) OVER w >= 12 THEN avg(exp_ratio) OVER w END, 6) AS fee, round(CASE WHEN count(turn_ratio) OVER w >= 12 THEN avg(turn_ratio) OVER w END, 6) AS turnover,
       round(CASE WHEN count(flow) OVER w >= 12 THEN sum(flow) OVER w END, 2) AS flow FROM {fx_port_month}
WINDOW w AS (PARTITION BY portfolio ORDER BY month_idx RANGE BETWEEN 36 PRECEDING AND 1 PRECEDING)""")
def factor_averages(v: Views):
    w = ts.trailing(["portfolio"], "month_idx", 36)
    of = lambda f, c: ts.guarded(f(c).over(w), F.count(c).over(w), 12)
    return v.fx_port_month.select("portfolio", "caldt", of(F.avg, "exp_ratio").alias("fee"), of(F.avg, "turn_ratio").alias("turnover"), F.round(of(F.sum, "flow"), 2).alias("flow"))


@query("w04_rolling_beta", """
SELECT portfolio, m.caldt, round(CASE WHEN count(*) OVER w >= 18 THEN covar_samp(mret, bret) OVER w / nullif(var_samp(bret) OVER w, 0) END, 4) AS beta
FROM {fx_port_month} m JOIN {fx_benchmark} b USING (month_idx) WINDOW w AS (PARTITION BY portfolio ORDER BY month_idx RANGE BETWEEN 36 PRECEDING AND 1 PRECEDING)""")
def rolling_beta(v: Views):
    df = v.fx_port_month.join(F.broadcast(v.fx_benchmark.drop("caldt")), "month_idx")
    return df.select("portfolio", "caldt", F.round(ts.beta("mret", "bret", ts.trailing(["portfolio"], "month_idx", 36), 18), 4).alias("beta"))


DRAWDOWN = """
WITH s AS (SELECT a.portfolio, a.caldt, a.month_idx, b.month_idx AS m, exp(sum(ln(1 + b.mret)) OVER (PARTITION BY a.portfolio, a.month_idx ORDER BY b.month_idx)) AS wealth
           FROM {fx_port_month} a JOIN {fx_port_month} b ON a.portfolio = b.portfolio AND b.month_idx BETWEEN a.month_idx LOW AND a.month_idx HIGH),
     p AS (SELECT *, wealth / greatest(1, max(wealth) OVER (PARTITION BY portfolio, month_idx ORDER BY m)) - 1 AS fall FROM s),
     d AS (SELECT portfolio, caldt, count(*) AS n, least(0, min(fall)) AS low FROM p GROUP BY 1, 2)
SELECT portfolio, caldt, round(CASE WHEN n >= LEAST_N THEN low END, 6) AS drawdown FROM {fx_port_month} LEFT JOIN d USING (portfolio, caldt)"""


@query("w05_path_drawdown", DRAWDOWN.replace("a.month_idx LOW", "a.month_idx - 12").replace("a.month_idx HIGH", "a.month_idx - 1").replace("LEAST_N", "1"))
def path_drawdown(v: Views):
    return v.fx_port_month.select("portfolio", "caldt", ts.path_drawdown("mret", "month_idx", ts.trailing(["portfolio"], "month_idx", 12)).alias("drawdown"))


@query("w06_worst_month", """
SELECT portfolio, caldt, round(CASE WHEN count(mret) OVER w >= 9 THEN min(mret) OVER w END, 6) AS worst FROM {fx_port_month}
WINDOW w AS (PARTITION BY portfolio ORDER BY month_idx RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING)""")
def worst_month(v: Views):
    w = ts.trailing(["portfolio"], "month_idx", 12)
    return v.fx_port_month.select("portfolio", "caldt", ts.guarded(F.min("mret").over(w), F.count("mret").over(w), 9).alias("worst"))


@query("w07_lagged_regime", """
WITH r AS (SELECT b.caldt, b.month_idx, bret, rate, lag(rate, 1) OVER o AS level_, lag(rate, 4) OVER o AS before,
                  CASE WHEN count(bret) OVER w3 >= 3 THEN exp(sum(ln(1 + bret)) OVER w3) - 1 END AS m3, CASE WHEN count(bret) OVER w >= 9 THEN stddev_samp(bret) OVER w * sqrt(12) END AS vol
           FROM {fx_benchmark} b LEFT JOIN {fx_rate} USING (month_idx) WINDOW o AS (ORDER BY b.month_idx), w3 AS (ORDER BY b.month_idx RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), w AS (ORDER BY b.month_idx RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT caldt, round(level_, 6) AS rate_level, round(level_ - before, 6) AS rate_change, round(m3, 6) AS market_3m, round(vol, 6) AS market_vol FROM r""")
def lagged_regime(v: Views):
    df = v.fx_benchmark.join(v.fx_rate, "month_idx", "left")
    o, w = W.orderBy("month_idx"), ts.trailing([], "month_idx", 12)
    return df.select(
        "caldt", F.lag("rate", 1).over(o).alias("rate_level"), (F.lag("rate", 1).over(o) - F.lag("rate", 4).over(o)).alias("rate_change"),
        ts.compounded("bret", ts.trailing([], "month_idx", 3), 3).alias("market_3m"), ts.guarded(F.stddev_samp("bret").over(w) * (12**0.5), F.count("bret").over(w), 9).alias("market_vol"),
    )


FORWARD = ", ".join(f"round(CASE WHEN count(mret) OVER w{h} = {h} THEN exp(sum(ln(1 + mret)) OVER w{h}) - 1 END, 5) AS ret_{h}m, round(CASE WHEN count(mret) OVER w{h} = {h} THEN exp(sum(ln(1 + mret)) OVER w{h}) - exp(sum(ln(1 + bret)) OVER w{h}) END, 5) AS excess_{h}m" for h in (3, 6, 9, 12))


@query("w10_forward_outcomes", "SELECT portfolio, m.caldt, " + FORWARD + " FROM {fx_port_month} m LEFT JOIN {fx_benchmark} USING (month_idx) WINDOW " + ", ".join(f"w{h} AS (PARTITION BY portfolio ORDER BY month_idx RANGE BETWEEN 1 FOLLOWING AND {h} FOLLOWING)" for h in (3, 6, 9, 12)))
def forward_outcomes(v: Views):
    df = v.fx_port_month.join(F.broadcast(v.fx_benchmark.drop("caldt")), "month_idx", "left")
    cols = []
    for h in (3, 6, 9, 12):
        w = ts.forward(["portfolio"], "month_idx", h)
        own, market = ts.compounded("mret", w, h), ts.compounded(F.when(F.col("mret").isNotNull(), F.col("bret")), w, h)
        cols += [F.round(own, 5).alias(f"ret_{h}m"), F.round(own - market, 5).alias(f"excess_{h}m")]
    return df.select("portfolio", "caldt", *cols)


@query("w10_forward_drawdown", DRAWDOWN.replace("a.month_idx LOW", "a.month_idx + 1").replace("a.month_idx HIGH", "a.month_idx + 6").replace("LEAST_N", "6"))
def forward_drawdown(v: Views):
    return v.fx_port_month.select("portfolio", "caldt", ts.path_drawdown("mret", "month_idx", ts.forward(["portfolio"], "month_idx", 6), 6).alias("drawdown"))


@query("w11_forward_partial", """
SELECT portfolio, caldt, round(CASE WHEN count(mret) OVER w >= 9 THEN exp(sum(ln(1 + mret)) OVER w) - 1 END, 6) AS ret_12m FROM {fx_port_month}
WINDOW w AS (PARTITION BY portfolio ORDER BY month_idx RANGE BETWEEN 1 FOLLOWING AND 12 FOLLOWING)""")
def forward_partial(v: Views):
    return v.fx_port_month.select("portfolio", "caldt", ts.compounded("mret", ts.forward(["portfolio"], "month_idx", 12), 9).alias("ret_12m"))


@query("w12_report_deltas", """
WITH s AS (SELECT portfolio, report_dt, sector, sum(pct) / 100 AS w FROM {fx_holdings} GROUP BY 1, 2, 3),
     g AS (SELECT r.portfolio, r.report_dt, c.sector, coalesce(w, 0) AS w FROM (SELECT DISTINCT portfolio, report_dt FROM s) r CROSS JOIN (SELECT DISTINCT sector FROM s) c LEFT JOIN s USING (portfolio, report_dt, sector)),
     d AS (SELECT portfolio, report_dt, w - lag(w) OVER (PARTITION BY portfolio, sector ORDER BY report_dt) AS dw FROM g),
     t AS (SELECT portfolio, report_dt, sum(abs(dw)) / 2 AS rotation FROM d GROUP BY 1, 2)
SELECT portfolio, report_dt, round(stock - lag(stock) OVER o, 6) AS d_stock, round(bond - lag(bond) OVER o, 6) AS d_bond, round(cash - lag(cash) OVER o, 6) AS d_cash, round(rotation, 6) AS rotation
FROM {fx_allocation} LEFT JOIN t USING (portfolio, report_dt) WINDOW o AS (PARTITION BY portfolio ORDER BY report_dt)""")
def report_deltas(v: Views):
    from fundtrace.operators.holdings import SECTORS, rotation, sector_weights

    w = W.partitionBy("portfolio").orderBy("report_dt")
    deltas = v.fx_allocation.select("portfolio", "report_dt", *[(F.col(c) - F.lag(c).over(w)).alias(f"d_{c}") for c in ("stock", "bond", "cash")])
    return deltas.join(rotation(sector_weights(v.fx_holdings, SECTORS), SECTORS), ["portfolio", "report_dt"], "left")


@query("w18_monthly_close", """
WITH c AS (SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS month_idx, max_by(o_totalprice, struct_pack(a := o_orderdate, b := o_totalprice)) AS o_totalprice FROM {orders} GROUP BY 1, 2)
SELECT o_custkey, month_idx, round(o_totalprice, 6) AS o_totalprice, round(o_totalprice / nullif(lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY month_idx), 0) - 1, 6) AS ret FROM c""")
def monthly_close(v: Views):
    return ts.simple_return(ts.monthly_last(v.orders, ["o_custkey"], "o_orderdate", "o_totalprice"), ["o_custkey"], "month_idx", "o_totalprice")


@query("w19_yearly_beta", """
WITH b AS (SELECT ticker, r.month_idx AS m, ret, bret FROM {fx_brand_month} r JOIN {fx_benchmark} USING (month_idx)),
     l AS (SELECT ticker, CAST(floor((min(month_idx) - 1) / 12.0) AS BIGINT) AS a, CAST(floor((max(month_idx) - 1) / 12.0) AS BIGINT) AS z FROM {fx_brand_month} GROUP BY 1),
     s AS (SELECT ticker, unnest(generate_series(a, z)) AS year FROM l),
     t AS (SELECT s.ticker, year, k AS years, count(*) AS n, covar_samp(ret, bret) / nullif(var_samp(bret), 0) AS beta, corr(ret, bret) AS corr, exp(sum(ln(1 + ret))) - 1 AS total, exp(sum(ln(1 + bret))) - 1 AS market_total
           FROM s CROSS JOIN (VALUES (1), (3), (5)) y(k) JOIN b ON b.ticker = s.ticker AND m <= year * 12 + 12 AND m > year * 12 + 12 - k * 12 GROUP BY 1, 2, 3)
SELECT ticker, year, years, n, round(beta, 6) AS beta, round(corr, 6) AS corr, round(total, 6) AS total, round(market_total, 6) AS market_total, round(exp(ln(1 + total) * 12 / n) - 1, 6) AS annual FROM t WHERE n >= ceil(years * 12 * 0.7)""")
def yearly_beta(v: Views):
    return ts.yearly_beta(v.fx_brand_month, v.fx_benchmark.drop("caldt"), "ticker", "ret", "bret")


@query("j10_calendar_lag", """
SELECT portfolio, caldt, round(max(flow) OVER (PARTITION BY portfolio ORDER BY month_idx RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 2) AS flow_before FROM {fx_port_month}""")
def calendar_lag(v: Views):
    return v.fx_port_month.select("portfolio", "caldt", F.round(ts.calendar_lag("flow", ["portfolio"], "month_idx"), 2).alias("flow_before"))


@query("p03_active_rows", """
WITH b AS (SELECT f.*, bret FROM {fx_fund_month} f JOIN {fx_benchmark} USING (month_idx, caldt) WHERE family IN ('ASIA', 'EUROPE', 'AMERICA')),
     r AS (SELECT month_idx, CASE WHEN count(m) OVER w >= 25 THEN exp(sum(ln(1 + m)) OVER w * 12 / count(m) OVER w) - 1 END AS market
           FROM (SELECT month_idx, avg(bret) AS m FROM b GROUP BY 1) AS g WINDOW w AS (ORDER BY month_idx RANGE BETWEEN 36 PRECEDING AND 1 PRECEDING)),
     t AS (SELECT fund, caldt, month_idx, mret, bret, count(mret) OVER w AS n, CASE WHEN count(mret) OVER w >= 25 THEN exp(sum(ln(1 + mret)) OVER w * 12 / count(mret) OVER w) - 1 END AS y,
           CASE WHEN count(exp_ratio) OVER w >= 25 THEN avg(exp_ratio) OVER w END AS fee FROM b WINDOW w AS (PARTITION BY fund ORDER BY month_idx RANGE BETWEEN 36 PRECEDING AND 1 PRECEDING))
SELECT fund, caldt, round(mret, 6) AS mret, round(mret - bret, 6) AS current_excess, round(y, 6) AS trailing_return, round(market, 6) AS trailing_market, round(y - market, 6) AS trailing_excess,
       round(fee, 6) AS trailing_exp_ratio, n AS window_count FROM t JOIN r USING (month_idx) WHERE y IS NOT NULL AND market IS NOT NULL""")
def active_rows(v: Views):
    rows = v.fx_fund_month.join(F.broadcast(v.fx_benchmark), ["month_idx", "caldt"])
    out = ts.active_rows(rows, "fund", "family", "month_idx", "mret", "bret", ["exp_ratio"], ["ASIA", "EUROPE", "AMERICA"])
    return out.select("fund", "caldt", "mret", "current_excess", "trailing_return", "trailing_market", "trailing_excess", "trailing_exp_ratio", "window_count")
