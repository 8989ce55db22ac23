"""Splits, metrics, thresholds, drift: evaluation as tables."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fundtrace.operators.scores import pct_rank_avg, percentiles_all, percentiles_by


def walk_forward(rows: DataFrame, date: str, label_end: str, folds: int = 3, share: float = 0.4, embargo_months: int = 1) -> DataFrame:
    """Rows with fold and role: the last ``share`` of dates in ``folds`` blocks as tests; training rows end their label
    before the test's start less the embargo."""
    dates = rows.select(date).distinct()
    n = F.count("*").over(W.partitionBy())
    place = dates.withColumn("_i", F.row_number().over(W.partitionBy().orderBy(date)) - 1).withColumn("_n", n)  # one row a date
    first = F.floor(F.col("_n") * (1 - share))
    block = F.when(F.col("_i") >= first, F.floor((F.col("_i") - first) * folds / (F.col("_n") - first)) + 1)
    tests = place.withColumn("fold", block.cast("int")).where("fold is not null").groupBy("fold").agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    role = F.when(F.col(date).between(F.col("_lo"), F.col("_hi")), "test").when(F.col(label_end) < F.add_months("_lo", -embargo_months), "train")
    return rows.join(F.broadcast(tests), F.lit(True)).withColumn("role", role).where("role is not null").drop("_hi").withColumnRenamed("_lo", "test_start")


def training_windows(folds: DataFrame, date: str, years: list[int | None]) -> DataFrame:
    """Training rows under each window: all (0 years) or the last years before the test."""
    windows = F.explode(F.array(*[F.lit(y or 0) for y in years]))
    each = folds.withColumn("window_years", windows)
    return each.where((F.col("role") == "test") | (F.col("window_years") == 0) | (F.col(date) >= F.add_months("test_start", F.col("window_years") * -12)))


def inner_split(rows: DataFrame, date: str, cuts: tuple[float, float] = (0.45, 0.8)) -> DataFrame:
    """base, calibration or validation by the place of the date among all dates."""
    place = rows.select(date).distinct().withColumn("_p", (F.row_number().over(W.partitionBy().orderBy(date)) - 1) / F.count("*").over(W.partitionBy()))
    role = F.when(F.col("_p") < cuts[0], "base").when(F.col("_p") < cuts[1], "calibration").otherwise("validation")
    return rows.join(place.select(date, role.alias("split")), date)


def threshold_sweep(scores: DataFrame, y: str, p: str, by: list[str], low: int = 5, high: int = 95) -> DataFrame:
    """Confusion counts, precision, recall and balanced accuracy at each threshold from low to high hundredths.

    Scores are counted once per hundredth they reach; cumulative counts give every threshold.
    """
    reach = F.least(F.lit(high), F.greatest(F.lit(low - 1), F.floor(F.round(F.col(p) * 100, 9)))).cast("int")
    counts = scores.groupBy(*by, reach.alias("t")).agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_n"))
    grid = scores.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(low - 1), F.lit(high))).alias("t"))
    full = grid.join(counts, [*by, "t"], "left").na.fill(0, ["_p", "_n"])
    above, all_ = W.partitionBy(*by).orderBy(F.desc("t")), W.partitionBy(*by)
    c = full.select(*by, "t", F.sum("_p").over(above).alias("tp"), F.sum("_n").over(above).alias("fp"), F.sum("_p").over(all_).alias("pos"), F.sum("_n").over(all_).alias("neg")).where(F.col("t") >= low)
    rate = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    out = c.withColumns({"precision": F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), "recall": rate("tp", "pos"), "false_rate": rate("fp", "neg")})
    return out.withColumn("balanced", (F.col("recall") + 1 - F.col("false_rate")) / 2).drop("false_rate")


def best_threshold(sweep: DataFrame, by: list[str]) -> DataFrame:
    """Highest balanced accuracy; ties to the threshold nearest to a half, then the lower."""
    key = F.struct(F.negative(F.round("balanced", 9)), F.abs(F.col("t") - 50), "t")
    return sweep.groupBy(*by).agg(F.min_by("t", key).alias("t"), F.max("balanced").alias("balanced"))


def roc_auc(scores: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """Area by rank sums with average ranks; null without both classes. Equal scores are gathered before any window."""
    g = scores.groupBy(*by, p).agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_n"))
    below = F.sum("_n").over(W.partitionBy(*by).orderBy(p)) - F.col("_n")
    return g.withColumn("_w", F.col("_p") * (below + F.col("_n") / 2)).groupBy(*by).agg((F.sum("_w") / F.nullif(F.sum("_p") * F.sum("_n"), F.lit(0))).alias("auc"))


def average_precision(scores: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """Sum of precision times the step of recall, ties together."""
    g = scores.groupBy(*by, p).agg(F.count_if(F.col(y) == 1).alias("_p"), F.count("*").alias("_n"))
    w = W.partitionBy(*by).orderBy(F.desc(p))
    g = g.withColumn("_prec", F.sum("_p").over(w) / F.sum("_n").over(w))
    return g.groupBy(*by).agg((F.sum(F.col("_prec") * F.col("_p")) / F.nullif(F.sum("_p"), F.lit(0))).alias("average_precision"))


def direction_metrics(scores: DataFrame, y: str, p: str, by: list[str], threshold: float) -> DataFrame:
    """Counts, rates, Brier score and log loss at a threshold."""
    q = F.least(F.lit(1 - 1e-15), F.greatest(F.lit(1e-15), F.col(p)))
    yes, hit = F.col(y) == 1, F.col(p) >= threshold
    c = scores.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(yes & hit).alias("tp"), F.count_if(~yes & hit).alias("fp"), F.count_if(yes & ~hit).alias("fn"), F.count_if(~yes & ~hit).alias("tn"),
        F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"), F.avg(-F.when(yes, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"),
    )
    d = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    c = c.withColumns({"precision": d("tp", "fp"), "recall": d("tp", "fn"), "specificity": d("tn", "fp")})
    return c.withColumn("f1", 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)))


def class_metrics(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    counts = rows.groupBy(actual, predicted).agg(F.count("*").alias("n"))
    a = counts.groupBy(F.col(actual).alias("class")).agg(F.sum("n").alias("support"))
    b = counts.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("said"))
    hit = counts.where(F.col(actual) == F.col(predicted)).select(F.col(actual).alias("class"), F.col("n").alias("tp"))
    m = a.join(b, "class", "full").join(hit, "class", "left").na.fill(0, ["support", "said", "tp"])
    return m.withColumns({"precision": F.col("tp") / F.nullif("said", F.lit(0)), "recall": F.col("tp") / F.nullif("support", F.lit(0)), "f1": 2 * F.col("tp") / (F.col("said") + F.col("support"))})


#: The five classes in order, the extreme ones, least macro F1 and number of predicted classes, least support of a class.
FIVE, EXTREME, LEAST_MACRO, LEAST_SAID, SUPPORT = ("large_loss", "small_loss", "neutral", "small_win", "large_win"), ("large_loss", "large_win"), 0.3, 3, 50


def confusion(rows: DataFrame, actual: str, predicted: str, by: list[str]) -> DataFrame:
    """How often each of the five classes was said for each, 0 included: by, actual, predicted, n."""
    counts = rows.groupBy(*by, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    names = F.array(*map(F.lit, FIVE))
    grid = rows.select(*by).distinct().select(*by, F.explode(names).alias("actual")).select(*by, "actual", F.explode(names).alias("predicted"))
    return grid.join(counts, [*by, "actual", "predicted"], "left").na.fill(0, ["n"])


def five_class_report(rows: DataFrame, actual: str, predicted: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Figures of each class (by, class, support, said, precision, recall, f1, status) and of all: by, macro_f1, weighted_f1, warnings, status.

    Ratios without a base are 0. Warnings: low_macro_f1, zero_recall_for_extreme_classes, prediction_class_collapse; without any the
    status is production_ready, else experimental. A class with fewer than 50 rows has insufficient_support.
    """
    cells = confusion(rows, actual, predicted, by)
    sides = [cells.select(*by, F.col(c).alias("class"), *[(F.when(F.lit(c == k), F.col("n")).otherwise(0)).alias(v) for k, v in (("actual", "support"), ("predicted", "said"))], F.when((F.lit(c) == "actual") & (F.col("actual") == F.col("predicted")), F.col("n")).otherwise(0).alias("tp")) for c in ("actual", "predicted")]
    per = sides[0].union(sides[1]).groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("support", "said", "tp")])
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    per = per.withColumns({"precision": ratio(F.col("tp"), F.col("said")), "recall": ratio(F.col("tp"), F.col("support")), "f1": ratio(2 * F.col("tp"), F.col("said") + F.col("support"))})
    per = per.withColumn("status", F.when(F.col("support") >= SUPPORT, "ok").otherwise("insufficient_support"))
    macro = F.avg("f1")
    all_ = per.groupBy(*by).agg(
        macro.alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"), F.sum("support").alias("n"),
        F.array_compact(F.array(
            F.when(macro < LEAST_MACRO, F.lit("low_macro_f1")), F.when(F.min(F.when(F.col("class").isin(*EXTREME), F.col("recall"))) <= 0, F.lit("zero_recall_for_extreme_classes")),
            F.when(F.count_if(F.col("said") > 0) < LEAST_SAID, F.lit("prediction_class_collapse")),
        )).alias("warnings"),
    )
    return per.drop("tp"), all_.withColumn("status", F.when(F.size("warnings") == 0, "production_ready").otherwise("experimental"))


def regression_metrics(rows: DataFrame, actual: str, predicted: str, by: list[str]) -> DataFrame:
    """MAE, RMSE, rank correlation (average ranks; null if one side is constant) and share of right signs."""
    both = rows.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    ranked = both.withColumn("_a", pct_rank_avg(actual, by)).withColumn("_b", pct_rank_avg(predicted, by))
    e = F.col(predicted) - F.col(actual)
    spearman = F.when(F.count("*") > 1, F.try_divide(F.covar_pop("_a", "_b"), F.stddev_pop("_a") * F.stddev_pop("_b")))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), spearman.alias("spearman"), F.avg((F.signum(actual) == F.signum(predicted)).cast("double")).alias("hit_rate"))


def bootstrap(values: DataFrame, key: str, value: str, by: list[str], replicates: int = 200) -> DataFrame:
    """Mean with a 95 % interval of resampled means: by, mean, low, high.

    How often a row is drawn for a replicate is a Poisson number with mean 1, made from a hash of its key, which must be
    unique; so every run agrees, no row is numbered, and what is shuffled is a sum for each group, replicate and task.
    """
    u = F.pmod(F.xxhash64("_r", key), F.lit(1 << 53)) / float(1 << 53)
    steps = accumulate(math.exp(-1) / math.factorial(i) for i in range(18))
    times = sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))
    rows = values.where(F.col(value).isNotNull()).select(*by, key, value, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_r")).withColumn("_t", times)
    sums = rows.groupBy(*by, "_r").agg(F.sum(F.col("_t") * F.col(value)).alias("_s"), F.sum("_t").alias("_n"))
    means = sums.withColumn("_m", F.try_divide("_s", "_n"))
    bounds = means.groupBy(*by).agg(F.percentile("_m", F.lit(0.025)).alias("low"), F.percentile("_m", F.lit(0.975)).alias("high"))
    return values.groupBy(*by).agg(F.avg(value).alias("mean")).join(bounds, by)


def drift(reference: DataFrame, current: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """PSI by reference deciles, share outside p01-p99, median shift by IQR, missing shift, severity, for each column."""
    long = lambda d, n: d.select(F.lit(n).alias("_of"), *columns).unpivot(["_of"], columns, "feature", "x")
    ref, cur = long(reference, "reference"), long(current, "current")
    qs = [i / bins for i in range(1, bins)]
    at = percentiles_by(ref, ["feature"], "x", [0.01, 0.25, 0.5, 0.75, 0.99, *qs], "_q")
    stats = ref.groupBy("feature").agg(F.avg(F.col("x").isNull().cast("double")).alias("_miss")).join(at, "feature", "left")
    both = ref.union(cur).join(F.broadcast(stats), "feature")  # a row for each column
    edges = F.slice("_q", 6, bins - 1)
    binned = both.where("x is not null").withColumn("_b", F.size(F.filter(edges, lambda e: e < F.col("x"))))
    counts = binned.groupBy("feature", "_b").agg(F.count_if(F.col("_of") == "reference").alias("r"), F.count_if(F.col("_of") == "current").alias("c"))
    total = W.partitionBy("feature")
    share = lambda c: F.greatest(F.col(c) / F.sum(c).over(total), F.lit(1e-6))
    psi = counts.withColumn("_p", (share("c") - share("r")) * F.log(share("c") / share("r"))).groupBy("feature").agg(F.sum("_p").alias("psi"))
    median = percentiles_by(cur, ["feature"], "x", [0.5], "_m")
    now = cur.join(F.broadcast(stats.join(median, "feature", "left")), "feature").groupBy("feature").agg(
        F.avg(F.when(F.col("x").isNotNull(), ((F.col("x") < F.col("_q")[0]) | (F.col("x") > F.col("_q")[4])).cast("double"))).alias("outside"),
        ((F.max(F.col("_m")[0]) - F.max(F.col("_q")[2])) / F.nullif(F.max(F.col("_q")[3] - F.col("_q")[1]), F.lit(0.0))).alias("median_shift"),
        (F.avg(F.col("x").isNull().cast("double")) - F.max("_miss")).alias("missing_shift"),
    )
    return psi.join(now, "feature").withColumn("severity", F.when(F.col("psi") >= 0.25, "high").when(F.col("psi") >= 0.1, "medium").otherwise("low"))


def expected_excess(p: Column, up: Column, down: Column) -> Column:
    """p * up + (1 - p) * down; null if any part is missing or not finite."""
    x = p * up + (1 - p) * down
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def calibration_curve(scores: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Mean score and share of ones in bins between quantiles of the score."""
    edges = sorted({e for e in percentiles_all(scores, p, [i / bins for i in range(1, bins)]) if e is not None})
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(p))) if edges else F.lit(0)
    return scores.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_score"), F.avg(y).alias("share"))
