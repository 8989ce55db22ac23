"""Fund, family and manager tables, selections and histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fundtrace.operators.scores import pct_rank_avg, percentiles_all


def fund_measures(rows: DataFrame, key: str, ret: str, market: str) -> DataFrame:
    """Return and risk measures of each key over all its months; ratios without a base are null."""
    r, m = F.col(ret), F.col(market)
    ex = r - m
    safe = lambda a, b: a / F.nullif(b, F.lit(0.0))
    n = F.count(r)
    annual = F.expm1(F.sum(F.log1p(r)) * 12 / n)
    vol = F.stddev_samp(r) * (12**0.5)
    down = F.sqrt(F.avg(F.when(r < 0, r * r).otherwise(0.0)) * 12)
    beta = safe(F.covar_samp(r, m), F.var_samp(m))
    tail = F.percentile(r, F.lit(0.05))
    return rows.groupBy(key).agg(
        n.alias("n"), annual.alias("annual"), vol.alias("volatility"), safe(F.avg(r) * 12, vol).alias("sharpe"), safe(F.avg(r) * 12, down).alias("sortino"),
        F.avg((r > 0).cast("double")).alias("win_rate"), F.avg((ex > 0).cast("double")).alias("beat_rate"), (F.stddev_samp(ex) * 12**0.5).alias("tracking_error"),
        safe(F.avg(ex) * 12, F.stddev_samp(ex) * 12**0.5).alias("information_ratio"), beta.alias("beta"), ((F.avg(r) - beta * F.avg(m)) * 12).alias("alpha"),
        safe(F.avg(F.when(m > 0, r)), F.avg(F.when(m > 0, m))).alias("up_capture"), safe(F.avg(F.when(m < 0, r)), F.avg(F.when(m < 0, m))).alias("down_capture"),
        F.corr(r, m).alias("correlation"), tail.alias("var_5"), F.skewness(r).alias("skew"), F.kurtosis(r).alias("kurtosis"), F.min(r).alias("worst"), F.max(r).alias("best"),
    )


#: Fixed value: yearly rate without risk in ratios of the fund table.
RISK_FREE = 0.01
#: Lowest return that has a logarithm here.
LEAST_RETURN = -0.999999


def _annual(mean: Column) -> Column:
    """Yearly return of a monthly mean; null at a total loss."""
    return F.when(mean > LEAST_RETURN, F.expm1(12 * F.log1p(mean)))


def path_drawdown(rows: DataFrame, key: str, month: str, ret: str, block: int = 12, within: list[str] | None = None) -> DataFrame:
    """Deepest fall of each key's wealth below its peak so far (at most 0), the start counted as a peak: key, max_drawdown.

    Months are summed up in blocks: total, highest and lowest point and deepest fall of the logarithm of wealth. Blocks are
    then put in order, each with the wealth and the peak before it, so no key's path is gathered into one row. Rows of
    one month are in order of the columns ``within``; returns at or below ``LEAST_RETURN`` and missing ones are left out.
    """
    within = within or []
    x = rows.where(F.col(ret) > LEAST_RETURN).select(key, *within, F.col(month).alias("_m"), F.floor(F.col(month) / block).alias("_b"), F.log1p(ret).alias("_x"))
    run = W.partitionBy(key, "_b").orderBy("_m", *within).rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("_c", F.sum("_x").over(run)).withColumn("_fall", F.col("_c") - F.greatest(F.lit(0.0), F.max("_c").over(run)))
    blocks = x.groupBy(key, "_b").agg(F.sum("_x").alias("_t"), F.max("_c").alias("_high"), F.min("_c").alias("_low"), F.min("_fall").alias("_fall"))
    before = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("_at", F.coalesce(F.sum("_t").over(before), F.lit(0.0)))
    blocks = blocks.withColumn("_peak", F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("_at") + F.col("_high")).over(before), F.lit(0.0))))
    fall = F.least(F.lit(0.0), F.col("_fall"), F.col("_at") + F.col("_low") - F.col("_peak"))
    return blocks.groupBy(key).agg(F.expm1(F.greatest(F.lit(-700.0), F.min(fall))).alias("max_drawdown"))


#: Measures of a manager that are scored, and whether more is better.
INDICATORS = {
    "annual_return": True, "avg_excess": True, "sharpe": True, "beat_rate": True, "max_drawdown": True,
    "annual_volatility": False, "avg_fee": False, "avg_flow": True, "avg_tenure": True, "avg_mtna": True,
}


def manager_indicators(rows: DataFrame, manager: str, fund: str, family: str, month: str, ret: str, market: str, mtna: str, flow: str, exp_ratio: str, tenure: str, turnover: str) -> DataFrame:
    """Measures of each manager over all rows of its funds, and for ten of them a score from 0 to 1 among all managers.

    A score is the average rank by the number of known values, turned round where less is better, and a half where the
    measure is missing. A manager's returns are one path by month, then fund.
    """
    named = rows.where(F.col(ret).isNotNull()).withColumn(manager, F.coalesce(F.nullif(F.trim(manager), F.lit("")), F.lit("Unknown Manager")))
    r, m = F.col(ret), F.col(market)
    vol = F.stddev_samp(r) * 12**0.5
    base = named.groupBy(manager).agg(
        F.count("*").alias("obs"), F.count_distinct(fund).alias("funds"), F.count_distinct(family).alias("families"), F.avg(r).alias("mean_return"), _annual(F.avg(r)).alias("annual_return"),
        F.avg(r - m).alias("avg_excess"), F.avg((r > m).cast("double")).alias("beat_rate"), vol.alias("annual_volatility"), ((_annual(F.avg(r)) - RISK_FREE) / F.nullif(vol, F.lit(0.0))).alias("sharpe"),
        F.avg(exp_ratio).alias("avg_fee"), F.avg(flow).alias("avg_flow"), F.avg(mtna).alias("avg_mtna"), F.avg(tenure).alias("avg_tenure"), F.avg(turnover).alias("avg_turnover"),
    )
    base = base.join(path_drawdown(named, manager, month, ret, within=[fund]), manager, "left")
    base = base.withColumns({f"_{c}": F.round(c, 9) for c in INDICATORS})
    ranks = {c: pct_rank_avg(f"_{c}", []) for c in INDICATORS}  # a row for each manager
    scores = {f"score_{c}": F.coalesce(ranks[c] if up else 1 - ranks[c], F.lit(0.5)) for c, up in INDICATORS.items()}
    return base.withColumns(scores).drop(*[f"_{c}" for c in INDICATORS])


def fund_table(rows: DataFrame, key: str, month: str, ret: str, market: str, mtna: str, flow: str, exp_ratio: str, tenure: str, turnover: str) -> DataFrame:
    """The 28 measures of each key over all its months; what has no base or too few months is null. Keys without a return are left out."""
    r, m = F.col(ret), F.col(market)
    both = r.isNotNull() & m.isNotNull()
    a, b = F.when(both, r), F.when(both, m)
    ex = a - b
    safe = lambda x, y: x / F.nullif(y, F.lit(0.0))
    year = 12**0.5
    vol, down, track = F.stddev_samp(r) * year, F.stddev_samp(F.when(r < 0, r)) * year, F.stddev_samp(ex) * year
    beta = F.when(F.count(ex) > 1, safe(F.covar_pop(a, b), F.var_pop(b)))
    beaten = _annual(F.avg(ex))
    log = F.sum(F.when(r > LEAST_RETURN, F.log1p(r)))
    capture = lambda when: safe(F.avg(F.when(when, a)), F.avg(F.when(when, b)))
    correlation = F.when(F.count(ex) > 1, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))
    spread = F.var_pop(r) > 0
    out = rows.where(r.isNotNull()).groupBy(key).agg(
        F.count(r).alias("obs"), F.avg(r).alias("mean_return"), _annual(F.avg(r)).alias("annual_return"), F.when(log <= 700, F.expm1(F.greatest(log, F.lit(-700.0)))).alias("cumulative_return"),
        vol.alias("annual_volatility"), safe(_annual(F.avg(r)) - RISK_FREE, vol).alias("sharpe"), safe(_annual(F.avg(r)) - RISK_FREE, down).alias("sortino"),
        F.avg((r > 0).cast("double")).alias("win_rate"), F.avg((ex > 0).cast("double")).alias("beat_rate"), beaten.alias("annual_excess"), track.alias("tracking_error"),
        safe(beaten, track).alias("information_ratio"), beta.alias("beta"), _annual(F.avg(a) - beta * F.avg(b)).alias("alpha"),
        capture(b > 0).alias("up_capture"), capture(b < 0).alias("down_capture"), correlation.alias("correlation"),
        F.when(F.count(r) >= 2, F.percentile(r, F.lit(0.05))).alias("var_5"),
        F.when((F.count(r) >= 3) & spread, F.skewness(r)).alias("skewness"), F.when((F.count(r) >= 4) & spread, F.kurtosis(r)).alias("kurtosis"),
        F.avg(mtna).alias("avg_mtna"), F.avg(flow).alias("avg_net_flow"), F.sum(flow).alias("sum_net_flow"), F.avg(exp_ratio).alias("avg_exp_ratio"), F.avg(tenure).alias("avg_tenure"), F.avg(turnover).alias("avg_turnover"),
    )
    return out.join(path_drawdown(rows, key, month, ret), key, "left").join(tail_mean(rows, key, ret).withColumnRenamed("cvar", "_cvar"), key, "left").withColumn("cvar_5", F.when(F.col("var_5").isNotNull(), F.col("_cvar"))).drop("_cvar")


def tail_mean(rows: DataFrame, key: str, ret: str, q: float = 0.05) -> DataFrame:
    """Mean of returns at or below each key's q quantile."""
    cut = rows.groupBy(key).agg(F.percentile(ret, F.lit(q)).alias("_cut"))
    return rows.join(cut, key).where(F.col(ret) <= F.col("_cut")).groupBy(key).agg(F.avg(ret).alias("cvar"))


def box(x: str, y: str, corners: tuple[float, float, float, float]) -> Column:
    """Both values within two corners in any order, edges included."""
    x0, y0, x1, y1 = corners
    return F.col(x).between(min(x0, x1), max(x0, x1)) & F.col(y).between(min(y0, y1), max(y0, y1))


def by_regions(rows: DataFrame, regions: list[tuple[DataFrame, str, Column]], every: bool) -> DataFrame:
    """Rows whose key lies in all (``every``) or any of the regions (level table, key, condition)."""
    if every:
        return reduce(lambda df, r: df.join(r[0].where(r[2]).select(r[1]).distinct(), r[1], "left_semi"), regions, rows)
    tagged = rows.withColumn("_hit", F.lit(False))
    for i, (level, key, condition) in enumerate(regions):
        keys = level.where(condition).select(key).distinct().withColumn(f"_in{i}", F.lit(True))
        tagged = tagged.join(keys, key, "left").withColumn("_hit", F.col("_hit") | F.coalesce(f"_in{i}", F.lit(False))).drop(f"_in{i}")
    return tagged.where("_hit").drop("_hit")


def shared_histogram(df: DataFrame, group: str, value: str, bins: int = 30, cut: float = 0.005) -> DataFrame:
    """Counts per group in bins between the same two percentiles of all groups; what lies outside is in the end bins."""
    low, high = percentiles_all(df, value, [cut, 1 - cut])
    known = df.where(F.col(value).isNotNull())
    if low is None or low == high:
        return known.groupBy(group, F.lit(0).alias("bin")).count()
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(value) - low) / (high - low) * bins)))
    return known.groupBy(group, at.cast("int").alias("bin")).count()
