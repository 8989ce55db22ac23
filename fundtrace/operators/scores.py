"""Ranks, point-in-time manager scores, deviations and expert weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pct_rank_avg(value: str, by: list[str], descending: bool = False) -> Column:
    """Average rank by count of non-null values; nulls stay null."""
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    ties = F.count(value).over(W.partitionBy(*by, value))
    return F.when(F.col(value).isNotNull(), (F.rank().over(W.partitionBy(*by).orderBy(order)) + (ties - 1) / 2) / F.count(value).over(W.partitionBy(*by)))


def share_at_or_below(value: str, by: list[str], null_score: float | None = 0.5) -> Column:
    """Share of non-null values at or below; ``null_score`` for nulls."""
    w = W.partitionBy(*by, F.col(value).isNull()).orderBy(value)
    return F.when(F.col(value).isNotNull(), F.cume_dist().over(w)).otherwise(F.lit(null_score))


def number_rows(df: DataFrame, order: list, name: str = "nth") -> DataFrame:
    """Number all rows from 0 in a total order: sorted partitions and one offset for each, no single-task window."""
    s = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).persist()
    first = s.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_lo"))
    offset = first.select("_part", "_lo", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    return s.join(F.broadcast(offset), "_part").withColumn(name, F.col("_before") + F.col("_at") - F.col("_lo")).drop("_part", "_at", "_lo", "_before")


BUCKETS = 64


def settled(df: DataFrame) -> DataFrame:
    """``df`` worked out once: checkpointed where the session names a folder, else kept in memory and on disk."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def _bounds(df: DataFrame, values: list[str]) -> list[list]:
    """Bounds of buckets for each column, near its quantiles, in one pass."""
    row = df.agg(*[F.percentile_approx(v, [i / BUCKETS for i in range(1, BUCKETS)], 1000).alias(f"b{i}") for i, v in enumerate(values)]).first()
    return [sorted({b for b in x or [] if b is not None and b == b}) for x in row]


def _ordered_counts(df: DataFrame, value: str, bounds: list | None = None) -> DataFrame:
    """Distinct values of all rows with _c (rows), _upto (rows at or below) and _all.

    Values are dealt by fixed bounds into buckets in order, so sums run within a bucket and one offset for each is added.
    The bounds are near quantiles; the result does not depend on them.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    bounds = _bounds(df, [value])[0] if bounds is None else bounds
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("_v"))) if bounds else F.lit(0)
    s = counts.withColumn("_b", bucket)
    parts = s.groupBy("_b").agg(F.sum("_c").alias("_n"))
    offset = parts.select("_b", (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy()).alias("_all"))  # a row for each bucket
    upto = F.col("_before") + F.sum("_c").over(W.partitionBy("_b").orderBy("_v"))
    return s.join(F.broadcast(offset), "_b").select("_v", "_c", upto.alias("_upto"), "_all")


def share_at_or_below_all(df: DataFrame, value: str, name: str, null_score: float = 0.5) -> DataFrame:
    """Add the share of all rows' non-null values at or below; for tables too large for one window."""
    shares = _ordered_counts(df, value).select("_v", (F.col("_upto") / F.col("_all")).alias(name))
    return df.join(shares, F.col(value) == F.col("_v"), "left").drop("_v").withColumn(name, F.coalesce(name, F.lit(null_score)))


def average_ranks_all(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """For each column (key) add the average rank of all rows' non-null values by their number, under its name; 0 for nulls,
    and for all if fewer than two are known. ``df`` is read once for each column: settle it before if it is costly."""
    rank = (F.col("_upto") - (F.col("_c") - 1) / 2) / F.col("_all")
    out = df
    for (value, name), bounds in zip(names.items(), _bounds(df, list(names)), strict=True):
        ranks = _ordered_counts(df, value, bounds).select("_v", F.when(F.col("_all") > 1, rank).alias(name))
        out = out.join(ranks, F.col(value) == F.col("_v"), "left").drop("_v").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return out


def percentiles_all(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact, linearly interpolated percentiles of all rows' non-null values; few values reach the driver."""
    counts = _ordered_counts(df, value)
    n = df.where(F.col(value).isNotNull()).count()
    if not n:
        return [None] * len(shares)
    at = [s * (n - 1) for s in shares]
    wanted = sorted({int(x) for x in at} | {min(n - 1, int(x) + 1) for x in at})
    hit = F.filter(F.array(*map(F.lit, wanted)), lambda k: (k < F.col("_upto")) & (k >= F.col("_upto") - F.col("_c")))
    got = {k: r["_v"] for r in counts.select("_v", hit.alias("k")).where(F.size("k") > 0).collect() for k in r["k"]}
    return [float(got[int(x)]) + (float(got[min(n - 1, int(x) + 1)]) - float(got[int(x)])) * (x - int(x)) for x in at]


def percentiles_by(df: DataFrame, by: list[str], value: str, shares: list[float], name: str = "q") -> DataFrame:
    """Exact, linearly interpolated percentiles of the known values of each group: by and an array of them in order of ``shares``.

    Values are counted first, then dealt within their group into buckets in order whose bounds are near its quantiles. The
    buckets that hold a wanted rank are looked through; the bounds don't change the result. No group's values meet in
    one task. Groups without a known value, or with a null key, are left out.
    """
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    counts = known.groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    bounds = known.groupBy(*by).agg(F.percentile_approx("_v", [i / BUCKETS for i in range(1, BUCKETS)], 1000).alias("_bounds"))
    s = counts.join(bounds, by).withColumn("_b", F.size(F.filter("_bounds", lambda b: b < F.col("_v")))).drop("_bounds")
    w = W.partitionBy(*by)  # a row for each bucket of a group
    buckets = s.groupBy(*by, "_b").agg(F.sum("_c").alias("_n")).withColumn("_all", F.sum("_n").over(w)).withColumn("_before", F.sum("_n").over(w.orderBy("_b")) - F.col("_n"))
    at = lambda q: F.lit(float(q)) * (F.col("_all") - 1)
    low = lambda q: F.floor(at(q)).cast("long")
    high = lambda q: F.least(low(q) + 1, F.col("_all") - 1)
    wanted = F.array_distinct(F.array(*[f(q) for q in shares for f in (low, high)]))
    hits = buckets.withColumn("_k", F.filter(wanted, lambda k: (k >= F.col("_before")) & (k < F.col("_before") + F.col("_n")))).where(F.size("_k") > 0)
    upto = F.col("_before") + F.sum("_c").over(W.partitionBy(*by, "_b").orderBy("_v"))
    inside = s.join(hits, [*by, "_b"]).withColumn("_upto", upto)
    inside = inside.withColumn("_k", F.explode(F.filter("_k", lambda k: (k < F.col("_upto")) & (k >= F.col("_upto") - F.col("_c")))))
    got = inside.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_got"), F.max("_all").alias("_all"))
    one = lambda q: F.col("_got")[low(q)] + (F.col("_got")[high(q)] - F.col("_got")[low(q)]) * (at(q) - low(q))
    return got.select(*by, F.array(*[one(q) for q in shares]).alias(name))


def expanding_scores(events: DataFrame, entity: str, date: str, value: str, least: int = 3) -> DataFrame:
    """Point-in-time score of each entity at each event date: history before it, Sharpe-like ratio, reliability, rank.

    Null with fewer than ``least`` earlier dates. Ranks are across the entities of a date.
    """
    from fundtrace.operators.joins import spine_state

    s = spine_state(events, entity, date, value)
    enough = F.col("n") >= least
    s = s.withColumn("ratio", F.when(enough & (F.col("std") > 0), F.col("mean") / F.col("std")))
    s = s.withColumn("reliability", F.when(enough, F.log1p("n") / F.log1p(F.max("n").over(W.partitionBy(date)))))
    return s.withColumn("score", pct_rank_avg("ratio", [date]))


#: Yearly rate without risk, least earlier dates, and the ranks that each score is the mean of (True: higher is better).
RISK_FREE, LEAST_HISTORY = 0.01, 3
PTI_SCORES = {
    "defensive": {"max_drawdown": True, "annual_volatility": False, "avg_fee": False},
    "flow": {"avg_flow": True, "avg_mtna": True},
    "growth_tilt": {"annual_return": True, "avg_excess": True, "sharpe": True},
}
_MEANS = ("annual_return", "avg_excess", "avg_fee", "avg_flow", "avg_mtna")


def point_in_time_scores(events: DataFrame, entity: str, date: str, columns: dict[str, str], risk_free: float = RISK_FREE, least: int = LEAST_HISTORY) -> DataFrame:
    """Scores of every entity at every event date from its dates strictly before it.

    ``columns``: where annual_return, avg_excess, max_drawdown, avg_fee, avg_flow and avg_mtna are found. Returns entity, date,
    history_count, history_months, window_start, window_end, history_available, reliability and the means of the cross-sectional
    ranks ``defensive``, ``flow`` and ``growth_tilt``. Ranks are over all entities with a history; scores are null with fewer
    than ``least`` earlier dates. Missing ranks are left out of a mean.
    """
    from fundtrace.operators.joins import at_dates

    daily = events.where(F.col(entity).isNotNull() & F.col(date).isNotNull()).groupBy(entity, date).agg(*[F.avg(c).alias(n) for n, c in columns.items()])
    w = W.partitionBy(entity).orderBy(date)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    month = F.year(date) * 12 + F.month(date)
    marked = daily.withColumn("_new", F.when(F.coalesce(F.lag(month).over(w), F.lit(-1)) != month, 1).otherwise(0))
    prefix = marked.select(
        entity, F.col(date).alias("_from"), F.lead(date).over(w).alias("_to"), F.count("*").over(upto).alias("history_count"), F.sum("_new").over(upto).alias("history_months"),
        F.min(date).over(upto).alias("window_start"), F.max(date).over(upto).alias("window_end"),
        *[F.avg(c).over(upto).alias(c) for c in _MEANS], F.stddev_samp("annual_return").over(upto).alias("annual_volatility"), F.min("max_drawdown").over(upto).alias("max_drawdown"),
    )
    s = at_dates(prefix, events.select(date).distinct().where(F.col(date).isNotNull()), "_from", "_to", date)
    s = s.withColumn("sharpe", F.when(F.col("annual_volatility") > 0, (F.col("annual_return") - risk_free) / F.col("annual_volatility")))
    known = F.col("history_count") >= least
    ranked = {f for fs in PTI_SCORES.values() for f in fs}
    s = s.withColumns({f: F.round(f, 12) for f in ranked})  # ties of sums in another order
    s = s.withColumns({f"_{f}": pct_rank_avg(f, [date]) for f in ranked}).withColumn("_most", F.max("history_count").over(W.partitionBy(date)))
    score = lambda fs: weighted_mean([(F.col(f"_{f}") if up else 1 - F.col(f"_{f}"), 1.0) for f, up in fs.items()])
    out = s.withColumn("reliability", F.log1p("history_count") / F.log1p("_most")).withColumns({n: score(fs) for n, fs in PTI_SCORES.items()})
    return out.select(entity, date, "history_count", "history_months", "window_start", "window_end", known.alias("history_available"), *[F.when(known, F.col(c)).alias(c) for c in ("reliability", *PTI_SCORES)])


def trailing_deviation(events: DataFrame, entity: str, date: str, values: list[str], months: int = 36, least: int = 2) -> DataFrame:
    """Mean absolute z-score of an entity's values against its own dates in [date - months, date).

    Values of one date are averaged first. The history is collected in a window and the row itself left out, so a constant
    history has a standard deviation of exactly 0 and gives no score.
    """
    daily = events.groupBy(entity, date).agg(*[F.avg(v).alias(v) for v in values])
    w = f"PARTITION BY {entity} ORDER BY {date} RANGE BETWEEN INTERVAL '{months}' MONTH PRECEDING AND CURRENT ROW"
    rows = daily.withColumn("_h", F.expr(f"collect_list(struct({date}, {', '.join(values)})) OVER ({w})"))
    rows = rows.withColumn("_h", F.filter("_h", lambda x: x[date] < F.col(date)))
    out = rows.withColumn("n", F.size("_h"))
    scores = []
    for v in values:
        x = F.filter(F.transform("_h", _field(v)), lambda e: e.isNotNull())
        out = out.withColumn(f"_x_{v}", x)
        n = F.size(f"_x_{v}")
        mean = F.aggregate(f"_x_{v}", F.lit(0.0), lambda a, e: a + e) / F.nullif(n, F.lit(0))
        out = out.withColumn(f"mean_{v}", mean)
        square = F.aggregate(F.zip_with(f"_x_{v}", F.array_repeat(F.col(f"mean_{v}"), n), lambda e, m: (e - m) * (e - m)), F.lit(0.0), lambda a, e: a + e)
        out = out.withColumn(f"std_{v}", F.when(n < 2, None).when(F.array_min(f"_x_{v}") == F.array_max(f"_x_{v}"), 0.0).when(n >= 2, F.sqrt(square / (n - 1))))
        scores.append(F.when((F.col("n") >= least) & (F.col(f"std_{v}") > 0), F.abs(F.col(v) - F.col(f"mean_{v}")) / F.col(f"std_{v}")))
    known = F.array_compact(F.array(*scores))
    deviation = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, e: a + e) / F.size(known))
    return out.select(entity, date, "n", *[f"std_{v}" for v in values], deviation.alias("deviation"))


def _field(name: str):
    return lambda s: s[name]


def whole_history_deviation(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Legacy, for audits only: distance from the entity's mean over all its rows, later ones too, in global deviations."""
    mean = F.avg(value).over(W.partitionBy(entity))
    std = df.agg(F.stddev_samp(value).alias("_std"))
    return df.withColumn("_mean", mean).join(F.broadcast(std), F.lit(True)).withColumn("legacy_deviation", F.abs(F.col(value) - F.col("_mean")) / F.nullif("_std", F.lit(0.0))).drop("_mean", "_std")


def weighted_mean(pairs: list[tuple[Column, float]]) -> Column:
    """Mean of the known values by weight; null if none is known."""
    up = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) * w for c, w in pairs])
    down = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), w).otherwise(0.0) for c, w in pairs])
    return up / F.when(down > 0, down)


def expert_weights(votes: DataFrame, date: str, style: str, score: str, floor: float = 0.05) -> DataFrame:
    """Relative rank within date and style (alone: the score itself), at least ``floor``, and its share of the date."""
    alone = F.count("*").over(W.partitionBy(date, style)) == 1
    rank = F.greatest(F.lit(floor), F.coalesce(F.when(alone, F.col(score)).otherwise(pct_rank_avg(score, [date, style])), F.lit(floor)))
    out = votes.withColumn("relative", rank)
    return out.withColumn("weight", F.col("relative") / F.sum("relative").over(W.partitionBy(date)))


def consensus(votes: DataFrame, date: str, weight: str, shares: list[str], outcome: str) -> DataFrame:
    """Weighted shares per date and outcome over known outcomes only."""
    w = F.col(weight)
    known = F.when(F.col(outcome).isNotNull(), w)
    return votes.groupBy(date).agg(*[(F.sum(w * F.col(s)) / F.sum(w)).alias(s) for s in shares], (F.sum(known * F.col(outcome)) / F.sum(known)).alias(outcome), F.count("*").alias("experts"))


def cohort_distance(df: DataFrame, group: str, values: list[str]) -> DataFrame:
    """Mean of each value per group, standardised by the whole cohort (deviation 0 counts as 1)."""
    stats = df.agg(*[F.avg(v).alias(f"_m_{v}") for v in values], *[F.stddev_samp(v).alias(f"_s_{v}") for v in values])
    means = df.groupBy(group).agg(*[F.avg(v).alias(v) for v in values])
    z = [((F.col(v) - F.col(f"_m_{v}")) / F.coalesce(F.nullif(F.col(f"_s_{v}"), F.lit(0.0)), F.lit(1.0))).alias(v) for v in values]
    return means.join(F.broadcast(stats), F.lit(True)).select(group, *z)


#: Weights of the seven parts of the signal.
SIGNAL = {"trailing_return": 0.34, "trailing_excess": 0.24, "drawdown": -0.16, "flow": 0.12, "turnover": 0.10, "portfolio_change": 0.16, "expense": -0.08}


def weighted_signal(rows: DataFrame, future: str, weights: dict[str, float] = SIGNAL) -> DataFrame:
    """Add ``signal``, the weighted sum of z-scores over all rows (0 where a value is missing or all are equal), and whether
    the future return is positive, and positive and in the top quarter. ``drawdown`` counts by its size.

    The bar of the quarter interpolates between two numbered rows, so no task holds all values.
    """
    x = {c: F.abs(c) if c == "drawdown" else F.col(c) for c in weights}
    known = rows.where(F.col(future).isNotNull())
    stats = known.agg(*[f(x[c]).alias(f"_{n}_{c}") for c in weights for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    ranked = number_rows(known.select(future), [F.col(future)], "_nth")
    at = known.agg((0.75 * (F.count("*") - 1)).alias("_at"))
    near = ranked.join(F.broadcast(at), F.col("_nth").between(F.floor("_at"), F.ceil("_at")))
    share = F.col("_at") - F.floor("_at")
    bar = near.agg(F.sum(F.when(F.floor("_at") == F.ceil("_at"), F.col(future)).when(F.col("_nth") == F.floor("_at"), F.col(future) * (1 - share)).otherwise(F.col(future) * share)).alias("_bar"))
    z = lambda c: F.coalesce((x[c] - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")), F.lit(0.0))
    df = known.join(F.broadcast(stats), F.lit(True)).join(F.broadcast(bar), F.lit(True)).withColumn("signal", sum((w * z(c) for c, w in weights.items()), F.lit(0.0)))
    high = (F.col(future) > 0) & (F.col(future) >= F.col("_bar"))
    return df.select(*rows.columns, "signal", (F.col(future) > 0).alias("future_positive"), high.alias("future_high_positive"))
