"""Views that make fund data of the given tables; Spark and DuckDB read the same text, but for those in ``BUILT``.

``{name}`` stands for a table or an earlier view.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "fx_line": """
        SELECT *, last_day(CAST(l_shipdate AS DATE)) AS caldt, year(l_shipdate) * 12 + month(l_shipdate) AS month_idx,
               CAST(floor(l_suppkey / 2) AS BIGINT) AS portfolio,
               last_day(make_date(year(l_shipdate), CAST(ceil(month(l_shipdate) / 3.0) * 3 AS INT), 1)) AS report_dt
        FROM {lineitem}""",
    "fx_fund_month": """
        SELECT l_suppkey AS fund, portfolio, n_name AS manager, r_name AS family, caldt, month_idx,
               round(0.05 - sum(l_extendedprice * l_discount) / sum(l_extendedprice), 9) AS mret,
               round(sum(l_extendedprice), 4) AS mtna, round(avg(l_tax), 9) AS exp_ratio,
               round(avg(l_quantity) / 50, 9) AS turn_ratio,
               round(sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END), 4) AS new_sls,
               round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 4) AS redemp
        FROM {fx_line} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
             JOIN {region} ON n_regionkey = r_regionkey
        GROUP BY l_suppkey, portfolio, n_name, r_name, caldt, month_idx""",
    "fx_benchmark": """
        SELECT month_idx, caldt, round(0.05 - avg(l_discount), 9) AS bret FROM {fx_line} GROUP BY month_idx, caldt""",
    "fx_rate": """
        SELECT year(o_orderdate) * 12 + month(o_orderdate) AS month_idx, round(avg(o_totalprice) / 100000, 9) AS rate
        FROM {orders} GROUP BY 1""",
    "fx_port_month": """
        SELECT portfolio, caldt, month_idx, round(avg(mret), 12) AS mret, round(avg(exp_ratio), 12) AS exp_ratio,
               round(avg(turn_ratio), 12) AS turn_ratio, round(sum(new_sls - redemp), 4) AS flow, round(sum(mtna), 4) AS mtna,
               min_by(manager, fund) AS manager, min_by(family, fund) AS family
        FROM {fx_fund_month} GROUP BY portfolio, caldt, month_idx""",
    "fx_holdings": """
        SELECT portfolio, report_dt, l_partkey AS security, p_name AS name, p_brand AS ticker, p_type AS sector, value, pct,
               CAST(row_number() OVER (PARTITION BY portfolio, report_dt ORDER BY value DESC, l_partkey) AS INT) AS security_rank
        FROM (SELECT portfolio, report_dt, l_partkey, value,
                     round(100 * value / sum(value) OVER (PARTITION BY portfolio, report_dt), 9) AS pct
              FROM (SELECT portfolio, report_dt, l_partkey, round(sum(l_extendedprice), 4) AS value FROM {fx_line}
                    GROUP BY portfolio, report_dt, l_partkey) AS v) AS h JOIN {part} ON l_partkey = p_partkey""",
    "fx_allocation": """
        SELECT portfolio, report_dt, CASE WHEN (portfolio + q) % 7 = 0 THEN NULL ELSE round(n / t, 9) END AS stock,
               round(r / t, 9) AS bond, CASE WHEN (portfolio + q) % 11 = 0 THEN NULL ELSE round(a / t, 9) END AS cash
        FROM (SELECT portfolio, report_dt, year(report_dt) * 4 + quarter(report_dt) AS q, sum(l_extendedprice) AS t,
                     sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END) AS n,
                     sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS r,
                     sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0 END) AS a
              FROM {fx_line} GROUP BY portfolio, report_dt) AS s""",
    "fx_brand_month": """
        SELECT p_brand AS ticker, month_idx, round(0.05 - sum(l_extendedprice * l_discount) / sum(l_extendedprice), 9) AS ret
        FROM {fx_line} JOIN {part} ON l_partkey = p_partkey GROUP BY p_brand, month_idx""",
    "fx_validity": """
        SELECT fund, make_date(y, 1, 1) AS begdt, CASE WHEN y = max(y) OVER (PARTITION BY fund) THEN NULL ELSE make_date(y, 12, 31) END AS enddt, payload
        FROM (SELECT l_suppkey AS fund, year(l_shipdate) AS y, round(avg(l_tax), 9) AS payload FROM {lineitem} GROUP BY 1, 2) AS v""",
    "fx_items": """
        SELECT l_partkey AS security, p_brand AS ticker, p_name AS name, p_type AS kind, CAST(min(l_shipdate) AS DATE) AS first_dt,
               CAST(max(l_shipdate) AS DATE) AS last_dt, count(*) AS records, count(DISTINCT portfolio) AS portfolios
        FROM {fx_line} JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4""",
    "fx_secs": """
        SELECT security, records, portfolios, first_dt, last_dt, replace(replace(replace(replace(replace(replace(name, 'widget', 'Treasury note'), 'rod', 'Realty trust'), 'anvil', 'growth fund'),
               'ring', 'income portfolio'), 'gizmo', 'senior debt due'), 'plate', 'Holdings Inc') AS name,
               CASE CAST(security % 11 AS INT) WHEN 0 THEN 'AGG' WHEN 1 THEN 'SPY' WHEN 2 THEN ticker WHEN 3 THEN 'ABCDX' WHEN 4 THEN NULL WHEN 5 THEN 'brk.b' ELSE substr(kind, 1, 3) END AS ticker
        FROM {fx_items}""",
    "fx_events": """
        SELECT e.*, e.stock - lag(stock) OVER w AS d_stock, e.bond - lag(bond) OVER w AS d_bond, e.cash - lag(cash) OVER w AS d_cash
        FROM (SELECT a.portfolio, a.report_dt, m.manager, m.family, a.stock, a.bond, a.cash, m.mret, m.exp_ratio, m.turn_ratio, m.flow, m.month_idx
              FROM {fx_allocation} a JOIN {fx_port_month} m ON a.portfolio = m.portfolio AND a.report_dt = m.caldt) AS e
        WINDOW w AS (PARTITION BY portfolio ORDER BY report_dt)""",
    "fx_exposure": """
        SELECT portfolio, report_dt, round(sum(CASE WHEN p_type = 'LARGE' THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice), 9) AS tech,
               round(sum(CASE WHEN p_type = 'PROMO' THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice), 9) AS indirect,
               round(sum(l_extendedprice * p_size) / sum(l_extendedprice) / 25, 9) AS beta
        FROM {fx_line} JOIN {part} ON l_partkey = p_partkey GROUP BY portfolio, report_dt""",
    "fx_market": """
        SELECT b.month_idx, round(30 * sum(bret) OVER (ORDER BY b.month_idx ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING), 9) AS market,
               round(3 + 6 * (rate - 2.5), 9) AS yield10
        FROM {fx_benchmark} b LEFT JOIN {fx_rate} r ON b.month_idx = r.month_idx""",
    "fx_outcome": """
        SELECT a.portfolio, a.report_dt, round(exp(sum(ln(1 + m.mret))) - exp(sum(ln(1 + b.bret))), 9) AS excess, round(8 * min(m.mret), 9) AS drawdown
        FROM {fx_allocation} a JOIN {fx_port_month} m ON a.portfolio = m.portfolio AND m.month_idx > year(a.report_dt) * 12 + month(a.report_dt)
             AND m.month_idx <= year(a.report_dt) * 12 + month(a.report_dt) + 12 JOIN {fx_benchmark} b ON b.month_idx = m.month_idx
        GROUP BY a.portfolio, a.report_dt HAVING count(*) >= 9""",
    "fx_excess3": """
        SELECT a.portfolio, a.report_dt, round(exp(sum(ln(1 + m.mret))) - exp(sum(ln(1 + b.bret))), 9) AS excess3
        FROM {fx_allocation} a JOIN {fx_port_month} m ON a.portfolio = m.portfolio AND m.month_idx > year(a.report_dt) * 12 + month(a.report_dt)
             AND m.month_idx <= year(a.report_dt) * 12 + month(a.report_dt) + 3 JOIN {fx_benchmark} b ON b.month_idx = m.month_idx
        GROUP BY a.portfolio, a.report_dt HAVING count(*) = 3""",
    "fx_actions": """
        SELECT s.*, round(s.stock - lag(s.stock) OVER w, 9) AS d_stock, round(beta - lag(beta) OVER w, 9) AS d_beta, round(tech - lag(tech) OVER w, 9) AS d_tech,
               round(bond_money - lag(bond_money) OVER w, 9) AS d_bond_money, round(indirect - lag(indirect) OVER w, 9) AS d_indirect
        FROM (SELECT e.portfolio, e.report_dt, e.manager, e.family, e.stock, CASE WHEN bond IS NULL AND cash IS NULL THEN NULL ELSE coalesce(bond, 0) + coalesce(cash, 0) END AS bond_money,
                     tech, indirect, beta, excess, drawdown, market, yield10, mret, exp_ratio, turn_ratio, flow,
                     round(10 * abs(turn_ratio - avg(turn_ratio) OVER (PARTITION BY e.manager)), 9) AS deviation
              FROM {fx_events} e JOIN {fx_exposure} x ON e.portfolio = x.portfolio AND e.report_dt = x.report_dt
                   LEFT JOIN {fx_outcome} o ON e.portfolio = o.portfolio AND e.report_dt = o.report_dt LEFT JOIN {fx_market} k ON e.month_idx = k.month_idx) AS s
        WINDOW w AS (PARTITION BY s.portfolio ORDER BY s.report_dt)""",
    "fx_hits": """
        SELECT manager, year(report_dt) AS yr, count(*) AS n, sum(CASE WHEN excess > 0 THEN 1 ELSE 0 END) AS pos, round(sum(excess), 9) AS total
        FROM {fx_actions} WHERE excess IS NOT NULL GROUP BY manager, year(report_dt)""",
    "fx_fold_scores": " UNION ALL ".join(f"""
        SELECT a.portfolio, a.report_dt, year(a.report_dt) AS fold, {w} AS window_years, a.excess, CASE WHEN a.excess > 0 THEN 1 ELSE 0 END AS y,
               round(CAST(sum(h.pos) + 1 AS DOUBLE) / (sum(h.n) + 2), 9) AS p, round(sum(h.total) / sum(h.n), 9) AS expected, coalesce(a.market, 0) AS market
        FROM {{fx_actions}} a JOIN {{fx_hits}} h ON a.manager = h.manager AND h.yr <= year(a.report_dt) - 2 {f"AND h.yr >= year(a.report_dt) - {1 + w}" if w else ""}
        WHERE a.excess IS NOT NULL GROUP BY a.portfolio, a.report_dt, a.excess, a.market""" for w in (0, 1, 2)),
    "fx_scores": """
        SELECT l.doc_id, l.quality AS y, CAST((l.doc_id * 7919 + 13) % 1000 + 0.5 AS DOUBLE) / 1000 AS p, d.lang, d.source
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    "fx_regime": """
        SELECT b.caldt, round(lag(rate, 1) OVER o, 9) AS rate_level, round(lag(rate, 1) OVER o - lag(rate, 4) OVER o, 9) AS rate_change,
               round(CASE WHEN count(bret) OVER w >= 9 THEN stddev_samp(bret) OVER w * sqrt(12) END, 9) AS market_vol, round(avg(bret) OVER w * 12, 9) AS market_return,
               round(min(bret) OVER w * 3, 9) AS market_drawdown
        FROM {fx_benchmark} b LEFT JOIN {fx_rate} r ON b.month_idx = r.month_idx
        WINDOW o AS (ORDER BY b.month_idx), w AS (ORDER BY b.month_idx RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING)""",
    "fx_detail": """
        SELECT h.portfolio, h.report_dt, h.security, h.name, h.ticker, h.sector, h.security_rank, m.manager, concat('F', CAST(h.portfolio AS STRING), 'X') AS fund_ticker, concat(m.manager, ' Fund') AS fund_name,
               m.family AS objective, CASE WHEN h.security % 3 = 0 THEN NULL ELSE concat('Industry ', CAST(h.security % 7 AS STRING)) END AS industry,
               CASE WHEN h.report_dt < DATE '1996-01-01' THEN 'early' ELSE 'late' END AS period_key
        FROM {fx_holdings} h JOIN {fx_port_month} m ON h.portfolio = m.portfolio AND h.report_dt = m.caldt""",
    "fx_case": """
        SELECT CASE WHEN k % 17 = 0 THEN NULL ELSE concat(CAST(portfolio AS STRING), '_', CAST(report_dt AS STRING)) END AS event_id, portfolio, report_dt, manager,
               CASE WHEN k % 13 = 0 THEN NULL WHEN k % 11 = 0 THEN next_dt ELSE last_dt END AS available_dt, CASE WHEN k % 7 = 0 THEN report_dt ELSE last_dt END AS style_end_dt,
               CASE WHEN k % 5 = 0 THEN NULL ELSE last_dt END AS score_end_dt, CASE WHEN k % 19 = 0 THEN NULL ELSE k % 23 <> 0 END AS passed, k % 4 > 0 AS has_history,
               CASE WHEN k % 9 = 0 THEN 'n/a' WHEN k % 8 = 0 THEN '0' ELSE CAST(k AS STRING) END AS style_obs
        FROM (SELECT portfolio, report_dt, manager, portfolio * 3 + year(report_dt) * 4 + quarter(report_dt) AS k, lag(report_dt) OVER w AS last_dt, lead(report_dt) OVER w AS next_dt
              FROM {fx_events} WINDOW w AS (PARTITION BY portfolio ORDER BY report_dt)) AS e""",
    "fx_docs": """
        SELECT doc_id, text, source, lang,
               CASE WHEN doc_id % 17 = 0 THEN NULL ELSE date_add(DATE '1995-01-01', CAST(doc_id % 2500 AS INT)) END AS doc_date
        FROM {documents}""",
}


#: Views to write in turn by queries that read events or actions several times; each reads those before it more than once.
EVENTS = ("fx_port_month", "fx_allocation", "fx_events")
ACTIONS = ("fx_port_month", "fx_benchmark", "fx_allocation", "fx_actions")


#: Lines that a task of the holdings gets, about, and rows of ``part`` up to which it is broadcast.
TASK_LINES, BROADCAST_PARTS = 250_000, 1_500_000


def holdings(lines: DataFrame, part: DataFrame, by: tuple[str, ...] = ("portfolio", "report_dt")) -> DataFrame:
    """``fx_holdings`` as its text has it, with lines dealt by report into parts of bounded size, whatever number of shuffle partitions is set.

    A report then has its sums, weights and ranks in one task; so has a portfolio, if lines are dealt ``by`` it alone. A large
    ``part`` is joined by key in as many parts: to the lines before they are dealt, if its keys are unique, else to the weights, which are dealt again.
    """
    report = ["portfolio", "report_dt"]
    n = max(lines.sparkSession.sparkContext.defaultParallelism, math.ceil(lines.count() / TASK_LINES))
    w = W.partitionBy(*report)
    names = {"p_name": "name", "p_brand": "ticker", "p_type": "sector"}
    named = F.col("l_partkey") == F.col("p_partkey")
    value = F.round(F.sum("l_extendedprice"), 4).alias("value")
    large = part.count() > BROADCAST_PARTS
    first = large and part.groupBy("p_partkey").count().where("count > 1").isEmpty()
    if first:
        some = part.select("p_partkey", *names).repartition(n, "p_partkey").hint("merge")
        lines = lines.select(*report, "l_partkey", "l_extendedprice").repartition(n, "l_partkey").join(some, named, "left")
        value = [value, *(F.first(c).alias(c) for c in ("p_partkey", *names))]
    values = lines.repartition(n, *by).groupBy(*report, "l_partkey").agg(*(value if first else [value]))
    weights = values.withColumn("pct", F.round(100 * F.col("value") / F.sum("value").over(w), 9))
    if first:
        joined = weights.where("p_partkey is not null")
    elif not large:
        joined = weights.join(F.broadcast(part), named)
    else:
        joined = weights.repartition(n, "l_partkey").join(part.repartition(n, "p_partkey").hint("merge"), named).repartition(n, *by)
    rank = F.row_number().over(w.orderBy(F.desc("value"), "l_partkey"))
    security = [F.col(old).alias(new) for old, new in {"l_partkey": "security", **names}.items()]
    return joined.select(*report, *security, "value", "pct", rank.alias("security_rank"))


#: Views that Spark builds by a function of the tables and views that they name, as their text says.
BUILT = {"fx_holdings": holdings}


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str, kept: dict[str, DataFrame] | None = None) -> DataFrame:
    """A table or view as a DataFrame. Nothing is cached; views in ``kept`` are read as they stand there."""
    if kept and name in kept:
        return kept[name]
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    read = {n: view(spark, sf_dir, n, kept) for n in _names(VIEWS[name])}
    return BUILT[name](*read.values()) if name in BUILT else spark.sql(VIEWS[name], **read)


def duck_sql(sql: str) -> str:
    """DuckDB text of SQL over tables and views: each view that it needs becomes a common table expression."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for n in _names(text):
            if n in VIEWS and n not in needed:
                visit(VIEWS[n])
                needed.append(n)

    visit(sql)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    views = [f"{n} AS ({plain(VIEWS[n])})".replace("date_add(DATE '1995-01-01', CAST(doc_id % 2500 AS INT))", "DATE '1995-01-01' + CAST(doc_id % 2500 AS INT)") for n in needed]
    text = plain(sql).strip()
    if not views:
        return text
    if text[:4].upper() == "WITH":
        return f"WITH {', '.join(views)}, {text[4:]}"
    return f"WITH {', '.join(views)} {text}"
