"""Manager styles, unusual decisions, candidates and outcome matrices over an event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fundtrace.functions import labels as lb
from fundtrace.operators.scores import average_ranks_all, settled, share_at_or_below

#: Actions that are none or hardly one.
QUIET = ("stable_or_no_clear_action", "minor_allocation_rotation")


def mean_known(*parts: Column) -> Column:
    """Mean of the values that are not null."""
    known = F.array_compact(F.array(*parts))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def manager_styles(rows: DataFrame, manager: str, ret: str, excess: str, fall: str, fee: str, flow: str, size: str, risk_free: float = 0.0) -> DataFrame:
    """One row for each manager: observations, defensive, flow, growth and reliability scores, and the style label.

    Scores are means of shares at or below among managers (1 - share for volatility and fees; 0.5 where a measure is missing).
    The windows are over the manager table, a row for each.
    """
    known = rows.where(F.col(ret).isNotNull()).groupBy(manager).agg(
        F.count("*").alias("observations"), F.avg(ret).alias("ret"), F.stddev_samp(ret).alias("vol"), F.avg(excess).alias("excess"),
        F.min(fall).alias("fall"), F.avg(fee).alias("fee"), F.avg(flow).alias("flow"), F.avg(size).alias("size"),
    )
    known = known.withColumn("sharpe", F.when(F.col("vol") > 0, (F.col("ret") - risk_free) / F.col("vol")))
    known = known.select(manager, "observations", *[F.round(c, 9).alias(c) for c in ("ret", "vol", "excess", "fall", "fee", "flow", "size", "sharpe")])
    s = {c: share_at_or_below(c, []) for c in ("ret", "vol", "excess", "fall", "fee", "flow", "size", "sharpe")}
    ranked = known.select(manager, "observations", *[(1 - v if c in ("vol", "fee") else v).alias(c) for c, v in s.items()])
    scored = ranked.select(
        manager, "observations", mean_known(F.col("fall"), F.col("vol"), F.col("fee")).alias("defensive"), mean_known(F.col("flow"), F.col("size")).alias("flow"),
        mean_known(F.col("ret"), F.col("excess"), F.col("sharpe")).alias("growth"),
        F.least(F.lit(1.0), F.log1p("observations") / F.log1p(F.greatest(F.max("observations").over(W.partitionBy()), F.lit(1)))).alias("reliability"),
    )
    return scored.withColumn("style", lb.style_label(F.col("defensive"), F.col("flow"), F.col("growth")))


def unusual_scores(events: DataFrame, deviation: str, strength: str, deltas: dict[str, str], action: str, clean: Column) -> DataFrame:
    """Add unusual (0 to 1, from what is known at the report) and reason.

    Weights: deviation rank 0.30, strength rank 0.20, ranks of the absolute deltas 0.30 together, clear action 0.15, clean row
    0.05. Ranks are average ranks over all rows; a missing value ranks 0. ``deltas``: column -> words for a large change.
    """
    out = events.withColumn("_strength", F.abs(strength))
    names = {c: f"_abs_{i}" for i, c in enumerate(deltas)}
    out = out.withColumns({n: F.abs(c) for c, n in names.items()})
    weights = {deviation: 0.30, "_strength": 0.20} | {n: 0.30 / len(names) for n in names.values()}
    out = average_ranks_all(settled(out), {c: f"_rank_{i}" for i, c in enumerate(weights)})
    clear = ~F.coalesce(F.col(action), F.lit("")).isin("", *QUIET)
    total = sum((F.col(f"_rank_{i}") * w for i, w in enumerate(weights.values())), 0.15 * clear.cast("double") + 0.05 * F.coalesce(clean, F.lit(False)).cast("double"))
    said = [F.when(F.col(deviation) >= 0.75, F.lit("high style deviation")), F.when(F.col("_strength") >= 0.10, F.lit("large action strength"))]
    said += [F.when(F.col(names[c]) >= 0.05, F.lit(words)) for c, words in deltas.items()]
    said.append(F.when(clear, F.concat(F.lit("clear action: "), F.col(action))))
    found = F.array_compact(F.array(*said))
    reason = F.when(F.size(found) > 0, F.array_join(found, "; ")).otherwise("moderate or stable action")
    return out.select(*events.columns, F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)).alias("unusual"), reason.alias("reason"))


def manager_candidates(events: DataFrame, manager: str, fund: str, action: str, excess: str, unusual: str, clean: Column) -> DataFrame:
    """Counts, rates and the recommendation of each manager; blank managers are left out."""
    has, clear = F.col(excess).isNotNull(), ~F.coalesce(F.col(action), F.lit("")).isin("", *QUIET)
    c = events.where(F.trim(F.coalesce(manager, F.lit(""))) != "").groupBy(manager).agg(
        F.count("*").alias("row_count"), F.count_if(clean).alias("clean_rows"), F.count_if(has).alias("outcomes"), F.countDistinct(fund).alias("funds"),
        F.countDistinct(action).alias("actions"), F.count_if(clear).alias("clear_actions"), F.avg(F.when(has, (F.col(excess) > 0).cast("double"))).alias("positive_rate"),
        F.avg(excess).alias("mean_excess"), F.avg(unusual).alias("mean_unusual"), F.max(unusual).alias("max_unusual"),
    )
    most = F.max("outcomes").over(W.partitionBy())  # a row for each manager
    coverage = F.log1p("outcomes") / F.log1p(F.greatest(most, F.lit(1)))
    parts = ((coverage, 0.30), (F.col("mean_unusual"), 0.25), (F.col("max_unusual"), 0.20), (F.col("clear_actions") / F.col("row_count"), 0.15), (F.least(F.col("actions") / 6.0, F.lit(1.0)), 0.10))
    return c.withColumn("recommendation", sum((F.coalesce(p, F.lit(0.0)) * w for p, w in parts), F.lit(0.0)))


def group_outcomes(events: DataFrame, by: list[str], excess: str, least: int) -> DataFrame:
    """n, positive_rate and mean_excess of each group with at least ``least`` known outcomes."""
    known = events.where(F.col(excess).isNotNull())
    return known.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(excess) > 0).cast("double")).alias("positive_rate"), F.avg(excess).alias("mean_excess")).where(F.col("n") >= least)


def matrix(cells: DataFrame, row: str, column: str, value: str, names: list[str]) -> DataFrame:
    """Cells as one column for each of ``names``."""
    return cells.groupBy(row).pivot(column, names).agg(F.max(value))
