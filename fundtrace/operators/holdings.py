"""Holdings to reports, snapshots and actions. Percent weights are of the report's net assets and always divided by 100."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REPORT = ["portfolio", "report_dt"]
#: Sectors of the security table.
SECTORS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def report_rollup(holdings: DataFrame, top: int = 10) -> DataFrame:
    """One row for each report over all its holdings: weights by use, matches, value and the most frequent sector."""
    w = F.col("pct") / 100
    return holdings.groupBy(*REPORT).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("beta").isNotNull()).alias("matched"),
        F.sum(F.when(F.col("beta").isNotNull(), w)).alias("matched_weight"),
        F.sum(w * F.col("beta")).alias("weighted_beta"),
        F.sum(F.when(F.col("security_rank") <= top, w)).alias("top_weight"),
        F.sum("value").alias("value"),
        F.mode("sector", deterministic=True).alias("main_sector"),
    )


#: Categories of holdings that are no company, and what a technology sector's name holds.
BOND_MONEY, INDIRECT, TECHNOLOGY = "Bond / Credit / Money-related", "Equity Fund / Stock-fund-like", "technology"


def report_exposures(holdings: DataFrame, top: int = 10) -> DataFrame:
    """Exposures of each report over all its holdings, each once: beta, technology, largest holdings, companies, bonds and money, indirect equity.

    ``holdings`` has pct, security_rank, beta (null if unknown), sector and category (null or empty for companies). A weight without
    such holdings is 0; portfolio_beta is over matched holdings and 0 without any; main_sector is the most frequent, the smallest on a tie.
    """
    w = F.col("pct") / 100
    weight = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0.0))
    matched = F.col("beta").isNotNull()
    return holdings.groupBy(*REPORT).agg(
        F.coalesce(F.sum(w * F.col("beta")), F.lit(0.0)).alias("portfolio_beta"),
        weight(F.lower("sector").contains(TECHNOLOGY)).alias("technology"),
        weight(F.col("security_rank").between(1, top)).alias("top_holdings"),
        weight(matched).alias("company_equity"),
        weight(F.col("category") == BOND_MONEY).alias("bond_money"),
        weight(F.col("category") == INDIRECT).alias("indirect_equity"),
        F.count("*").alias("holdings"), F.count_if(matched).alias("beta_matched"), F.count_if(F.length("category") > 0).alias("category_matched"),
        F.mode("sector", deterministic=True).alias("main_sector"),
    )


def beta_shares(holdings: DataFrame) -> DataFrame:
    """Each holding's part of the report's weighted beta."""
    part = F.col("pct") / 100 * F.col("beta")
    total = F.sum(part).over(W.partitionBy(*REPORT))
    return holdings.withColumn("report_beta", total).withColumn("beta_share", part / F.nullif(total, F.lit(0.0)))


def sector_weights(holdings: DataFrame, sectors: list[str]) -> DataFrame:
    """Pivot to one weight for each sector of the fixed list; none is 0."""
    return holdings.groupBy(*REPORT).pivot("sector", sectors).agg(F.sum(F.col("pct") / 100)).na.fill(0.0, sectors)


def rotation(weights: DataFrame, sectors: list[str]) -> DataFrame:
    """Half the sum of absolute changes from the portfolio's report before; null for the first."""
    w = W.partitionBy("portfolio").orderBy("report_dt")
    moved = reduce(lambda a, b: a + b, [F.abs(F.col(s) - F.lag(s).over(w)) for s in sectors])
    return weights.select(*REPORT, (moved / 2).alias("rotation"))


def collapse_identities(holdings: DataFrame, identity: Column) -> DataFrame:
    """Positions of a report with the same identity as one: weights and values add, beta averages, best rank."""
    return holdings.groupBy(*REPORT, identity.alias("identity")).agg(
        F.sum("pct").alias("pct"), F.sum("value").alias("value"), F.avg("beta").alias("beta"), F.min("security_rank").alias("security_rank"), F.min("sector").alias("sector")
    )


def previous_report(reports: DataFrame) -> DataFrame:
    """Each report with the portfolio's report strictly before it."""
    return reports.select(*REPORT).distinct().withColumn("before_dt", F.lag("report_dt").over(W.partitionBy("portfolio").orderBy("report_dt")))


def snapshot_diff(positions: DataFrame, noise: float = 0.002, split_exit: bool = False) -> DataFrame:
    """Positions of each report against the report before: action and weight change.

    ``positions``: portfolio, report_dt, identity, pct, one row for each identity of a report; rows without an identity match none. Changes
    below ``noise`` are left out. A vanished position is a decrease, or an exit with ``split_exit``. The first report of a portfolio has no
    actions. Reports of a portfolio are numbered and each position looks at its own row before and after, so positions are read once.
    """
    reports, own = W.partitionBy("portfolio").orderBy("_n"), W.partitionBy("portfolio", "identity").orderBy("_n")
    dated = positions.where("portfolio is not null and report_dt is not null").select("portfolio", "report_dt", "identity", (F.col("pct") / 100).alias("now"))
    numbered = dated.withColumn("_n", F.dense_rank().over(W.partitionBy("portfolio").orderBy("report_dt")))
    numbered = numbered.withColumn("next_dt", F.min("report_dt").over(reports.rangeBetween(1, 1)))
    known = F.col("identity").isNotNull()
    old = F.when(known & (F.lag("_n").over(own) == F.col("_n") - 1), F.lag("now").over(own))
    stays = F.coalesce(known & (F.lead("_n").over(own) == F.col("_n") + 1), F.lit(False))
    seen = numbered.withColumns({"old": old, "stays": stays})
    here = F.when(F.col("_n") > 1, F.struct("report_dt", "now", "old"))
    gone = F.when(F.col("next_dt").isNotNull() & ~F.col("stays"), F.struct(F.col("next_dt").alias("report_dt"), F.lit(None).cast("double").alias("now"), F.col("now").alias("old")))
    both = seen.select("portfolio", "identity", F.explode(F.array_compact(F.array(here, gone))).alias("_r")).select("portfolio", "_r.report_dt", "identity", "_r.now", "_r.old")
    change = F.coalesce("now", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))
    action = (
        F.when(F.col("old").isNull(), "new_position")
        .when(F.col("now").isNull(), "exit" if split_exit else "decrease")
        .when(change > 0, "increase")
        .otherwise("decrease")
    )
    return both.select("portfolio", "report_dt", "identity", action.alias("action"), change.alias("change")).where(F.abs("change") >= noise)


def complete_allocation(df: DataFrame, proxy: str) -> DataFrame:
    """Fill missing stock from ``proxy``, missing cash with 0, missing bond with the rest; ``method`` tells what was filled."""
    stock = F.coalesce("stock", F.col(proxy))
    cash = F.coalesce("cash", F.lit(0.0))
    bond = F.coalesce("bond", F.greatest(F.lit(0.0), 1 - stock - cash))
    trail = F.array_compact(F.array(F.when(F.col("stock").isNull(), F.lit("stock_proxy")), F.when(F.col("cash").isNull(), F.lit("cash_zero")), F.when(F.col("bond").isNull(), F.lit("bond_rest"))))
    return df.withColumns({"stock_full": stock, "cash_full": cash, "bond_full": bond, "method": F.when(F.size(trail) == 0, "reported").otherwise(F.array_join(trail, ";"))})


def display_allocation(df: DataFrame) -> DataFrame:
    """Clip at 0 and put what is missing to 1 into bonds."""
    s, b, c = (F.greatest(F.lit(0.0), F.coalesce(x, F.lit(0.0))) for x in ("stock", "bond", "cash"))
    return df.withColumns({"stock_shown": s, "bond_shown": F.when(s + b + c < 1, 1 - s - c).otherwise(b), "cash_shown": c})


def normalise_allocation(df: DataFrame) -> DataFrame:
    """Shares of the row's total; null if it is not above 0."""
    s, b, c = (F.greatest(F.lit(0.0), F.coalesce(x, F.lit(0.0))) for x in ("stock", "bond", "cash"))
    total = F.when(s + b + c > 0, s + b + c)
    return df.withColumns({"stock_share": s / total, "bond_share": b / total, "cash_share": c / total})
