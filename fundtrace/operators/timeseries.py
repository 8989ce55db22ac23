"""Windows over monthly series. Months are integers (year * 12 + month), frames are calendar frames unless said otherwise.

A trailing frame leaves out the current month unless ``include_current``; a value is null with fewer than ``min_obs``
observations in its frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def trailing(keys: list[str], month: str, months: int, include_current: bool = False, row_based: bool = False):
    """Window of the ``months`` months up to the last or the current one."""
    w = W.partitionBy(*keys).orderBy(month)
    last = 0 if include_current else -1
    first = last - months + 1
    return w.rowsBetween(first, last) if row_based else w.rangeBetween(first, last)


def forward(keys: list[str], month: str, months: int, row_based: bool = False):
    """Window of the ``months`` months after the current one."""
    w = W.partitionBy(*keys).orderBy(month)
    return w.rowsBetween(1, months) if row_based else w.rangeBetween(1, months)


def guarded(value: Column, count: Column, least: int) -> Column:
    return F.when(count >= least, value)


def compounded(ret: str | Column, w, min_obs: int, annual: bool = False) -> Column:
    """Compounded return over a window; returns at or below -1 count as missing. ``annual``: to a year by observations."""
    ret = F.col(ret) if isinstance(ret, str) else ret
    logs = F.when(ret > -0.999999, F.log1p(ret))
    n = F.count(logs).over(w)
    total = F.sum(logs).over(w)
    return guarded(F.expm1(total * 12 / n if annual else total), n, min_obs)


def beta(x: str, market: str, w, min_obs: int) -> Column:
    """Sample covariance by variance of complete pairs; null without variance."""
    both = F.col(x).isNotNull() & F.col(market).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(market))
    var = F.var_samp(b).over(w)
    return guarded(F.covar_samp(a, b).over(w) / F.when(var > 1e-18, var), F.count(a).over(w), min_obs)


def drawdown_of(returns: Column) -> Column:
    """Largest fall of wealth from a peak, where the start is a peak, of an array of returns in order; 0 or below."""
    return F.aggregate(
        returns,
        F.struct(F.lit(1.0).alias("wealth"), F.lit(1.0).alias("peak"), F.lit(0.0).alias("low")),
        lambda s, r: F.struct(
            (s["wealth"] * (1 + r)).alias("wealth"),
            F.greatest(s["peak"], s["wealth"] * (1 + r)).alias("peak"),
            F.least(s["low"], s["wealth"] * (1 + r) / F.greatest(s["peak"], s["wealth"] * (1 + r)) - 1).alias("low"),
        ),
        lambda s: s["low"],
    )


def path_drawdown(ret: str, month: str, w, min_obs: int = 1) -> Column:
    """Exact drawdown over a window; null in an empty one."""
    seen = F.collect_list(F.when(F.col(ret).isNotNull(), F.struct(month, ret))).over(w)
    ordered = F.transform(F.array_sort(seen), lambda s: s[ret])
    return guarded(drawdown_of(ordered), F.count(ret).over(w), min_obs)


def calendar_lag(value: str, keys: list[str], month: str, months: int = 1) -> Column:
    """Value of exactly ``months`` months earlier; null if that month is absent."""
    return F.max(value).over(W.partitionBy(*keys).orderBy(month).rangeBetween(-months, -months))


def monthly_last(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """One value for each key and month: that of the latest time, the larger one on a tie."""
    month = (F.year(ts) * 12 + F.month(ts)).alias("month_idx")
    return df.groupBy(*keys, month).agg(F.max_by(value, F.struct(ts, value)).alias(value))


def simple_return(df: DataFrame, keys: list[str], month: str, value: str, name: str = "ret") -> DataFrame:
    """Return from the row before, without filling gaps."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(month))
    return df.withColumn(name, F.col(value) / F.nullif(before, F.lit(0.0)) - 1)


def yearly_beta(returns: DataFrame, market: DataFrame, key: str, ret: str, market_ret: str, years: tuple[int, ...] = (1, 3, 5), need: float = 0.7) -> DataFrame:
    """Beta, correlation and compounded returns over the 1, 3 and 5 years to each December: key, year, years, n, ..."""
    both = returns.join(market, "month_idx").withColumn("m", F.col("month_idx"))
    ends = returns.select(key, F.explode(F.sequence(F.floor((F.col("month_idx") - 1) / 12), F.floor((F.col("month_idx") - 1) / 12) + max(years) - 1)).alias("year")).distinct()
    last = returns.groupBy(key).agg(F.max(F.floor((F.col("month_idx") - 1) / 12)).alias("last"))
    spine = ends.join(last, key).where("year <= last").drop("last").crossJoin(returns.sparkSession.createDataFrame([(y,) for y in years], "years int"))
    spine = spine.withColumn("end", F.col("year") * 12 + 12)
    in_frame = (spine[key] == both[key]) & (both["m"] <= spine["end"]) & (both["m"] > spine["end"] - spine["years"] * 12)
    out = spine.join(both.drop("month_idx"), in_frame).drop(both[key]).groupBy(key, "year", "years").agg(
        F.count("*").alias("n"),
        (F.covar_samp(ret, market_ret) / F.nullif(F.var_samp(market_ret), F.lit(0.0))).alias("beta"),
        F.corr(ret, market_ret).alias("corr"),
        F.expm1(F.sum(F.log1p(ret))).alias("total"),
        F.expm1(F.sum(F.log1p(market_ret))).alias("market_total"),
    )
    return out.where(F.col("n") >= F.ceil(F.col("years") * 12 * need)).withColumn("annual", F.expm1(F.log1p("total") * 12 / F.col("n")))


def active_rows(rows: DataFrame, fund: str, company: str, month: str, ret: str, market: str, factors: list[str], chosen: list[str] | None = None, months: int = 36, least: int = 25) -> DataFrame:
    """Rows of the chosen companies (all if none is) with their current and trailing columns, where both trailing returns are known.

    The market's trailing return is worked out anew from the months that the chosen rows have. Trailing frames are those
    of :func:`trailing`; factors are averages over ``least`` known values or more.
    """
    base = rows.where(F.col(company).isin(chosen)) if chosen else rows
    # a row for each month, so one task holds them
    roll = base.groupBy(month).agg(F.avg(market).alias("_market")).select(month, compounded("_market", trailing([], month, months), least, annual=True).alias("trailing_market"))
    w = trailing([fund], month, months)
    mean = {f"trailing_{c}": guarded(F.avg(c).over(w), F.count(c).over(w), least) for c in factors}
    out = base.withColumns({"current_excess": F.col(ret) - F.col(market), "trailing_return": compounded(ret, w, least, annual=True), "window_count": F.count(ret).over(w), **mean})
    out = out.join(F.broadcast(roll), month).where("trailing_return IS NOT NULL AND trailing_market IS NOT NULL")
    return out.withColumn("trailing_excess", F.col("trailing_return") - F.col("trailing_market"))
