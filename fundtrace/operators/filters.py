"""Filters of reports, holdings and items, what makes a row fit for models, and the audits that go with it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundtrace.functions.ingest import identifier
from fundtrace.functions.labels import outcome_bucket, outcome_text
from fundtrace.operators.evaluation import average_precision, direction_metrics, regression_metrics, roc_auc
from fundtrace.operators.joins import first_by
from fundtrace.operators.scores import percentiles_by
from fundtrace.sources.scratch import written

#: First word of the category and the words that mark items of a theme.
THEMES = {
    "rate": ("Bond", "FANNIE|FNMA|FREDDIE|FHLMC|GINNIE|GNMA|TBA|TREAS|TREASURY|USD CASH|MONEY MARKET|CASH|REPO|AGG|BND|LQD|HYG|TLT|IEF|SHY|TIP"),
    "equity": ("Equity", "IVV|EFA|IEFA|SPY|VOO|VTI|QQQ|FIDELITY|EQUITY|STOCK|ETF|ISHARES|VANGUARD|MSCI|S&P|RUSSELL"),
}
#: Parts of the net flow that add to it, and the one that is taken off.
INFLOWS, OUTFLOW = ("new_sls", "rein_sls", "oth_sls"), "redemp"
#: Regimes by a feature and its rule; medians are those of the training rows.
REGIMES = {
    "high_rate": ("rate_level", "at_least_median"), "rising_rate": ("rate_change", "positive"), "high_volatility": ("market_vol", "at_least_median"),
    "market_drawdown": ("market_drawdown", "below_median"), "bull_trend": ("market_return", "positive"), "bear_trend": ("market_return", "negative"),
}
#: Fixed value: least rows of a regime.
SUPPORT = 50


def zero_if_missing(c: Column) -> Column:
    """An addend whose absence counts as nothing; NaN and infinities are absent."""
    x = c.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.coalesce(x, F.lit(0.0)))


def net_flow(df: DataFrame, given: str = "net_flow") -> Column:
    """Inflows less redemptions, missing ones as 0, if the table has all four columns; else its given column; else null."""
    if {*INFLOWS, OUTFLOW} <= set(df.columns):
        return reduce(lambda a, b: a + b, [zero_if_missing(F.col(c)) for c in INFLOWS]) - zero_if_missing(F.col(OUTFLOW))
    return F.col(given).cast("double") if given in df.columns else F.lit(None).cast("double")


def period_label(date: str, mode: str = "year") -> Column:
    """The year of a date, or with ``mode`` quarter its year and quarter, as in 1998 Q3."""
    year = F.year(date).cast("string")
    return F.concat(year, F.lit(" Q"), F.quarter(date).cast("string")) if mode == "quarter" else year


def in_periods(rows: DataFrame, date: str, period: tuple[str, str] | None = None, focus: str | None = None, brushed: tuple[str, ...] = (), mode: str = "year") -> DataFrame:
    """Rows of a period (column and value), with the focus label and one of the brushed labels; what is not given lets all pass."""
    label = period_label(date, mode)
    if period:
        rows = rows.where(F.col(period[0]) == period[1])
    if focus:
        rows = rows.where(label == focus)
    return rows.where(label.isin(*brushed)) if brushed else rows


def report_filter(reports: DataFrame, date: str, tie: list[str], managers: DataFrame | None = None, manager: str = "manager", **periods) -> DataFrame:
    """Reports of the wanted periods and, if given, of the managers in a table of them, by date and then ``tie``."""
    kept = in_periods(reports, date, **periods)
    if managers is not None:
        kept = kept.join(managers.select(manager), manager, "left_semi")
    return kept.orderBy(date, *tie)


def holding_filter(holdings: DataFrame, date: str, portfolio: str, rank: str, searched: list[str], rank_max: float | None = None, words: str = "", managers: DataFrame | None = None, manager: str = "manager", **periods) -> DataFrame:
    """Holdings of the wanted periods with a rank from 1 to ``rank_max`` whose searched columns, joined by blanks, hold ``words``.

    Case plays no part and a null column is an empty one. Newest first, then by portfolio as text, then by rank with missing ones as 999.
    """
    kept = in_periods(holdings, date, **periods)
    if managers is not None:
        kept = kept.join(managers.select(manager), manager, "left_semi")
    if rank_max is not None:
        kept = kept.where((F.col(rank) > 0) & (F.col(rank) <= rank_max))
    if words.strip():
        text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in searched]))
        kept = kept.where(text.contains(words.strip().lower()))
    return kept.orderBy(F.desc(date), F.col(portfolio).cast("string"), F.coalesce(F.nullif(F.col(rank), F.lit(0)), F.lit(999)))


def thematic(items: DataFrame, theme: str, category: str, searched: list[str], records: str) -> DataFrame:
    """Items of a theme: of its category and with one of its words in the searched columns; those with most records first."""
    first, words = THEMES[theme]
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in searched])
    return items.where(F.col(category).startswith(first) & text.rlike(f"(?i)({words})")).orderBy(F.desc_nulls_last(records), *searched)


def interactions(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Products of columns under new names; null if a side is null, no number or not in the table."""
    side = lambda c: F.col(c).try_cast("double") if c in df.columns else F.lit(None).cast("double")
    return df.withColumns({name: side(a) * side(b) for name, (a, b) in pairs.items()})


def model_table(df: DataFrame, roles: dict[str, list[str]], outcomes: list[str], core: list[str]) -> DataFrame:
    """Rows with a known outcome and a known core action, in the columns of identity, feature and target that the table has.

    Core columns that the table lacks are passed over; without any of them all rows with an outcome stay.
    """
    known = lambda names: reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in names])
    rows = df.where(known([c for c in outcomes if c in df.columns]))
    if held := [c for c in core if c in df.columns]:
        rows = rows.where(known(held))
    return rows.select(*dict.fromkeys(c for role in ("identity", "feature", "target") for c in roles[role] if c in df.columns))


def horizon_slice(df: DataFrame, date: str, target: str, direction: str, label_end: str, available: str | None = None) -> DataFrame:
    """Rows that a horizon's model may use: label available (as text true or 1; without the column, target known), and date, target and label end known."""
    if absent := [c for c in (date, target, direction, label_end) if c not in df.columns]:
        raise ValueError(f"missing required columns: {', '.join(absent)}")
    out = df.withColumns({date: F.to_date(date), label_end: F.to_date(label_end), target: F.col(target).try_cast("double"), direction: F.col(direction).try_cast("double")})
    ok = F.lower(F.col(available).cast("string")).isin("true", "1") if available and available in df.columns else F.lit(True)
    known = F.col(target).isNotNull() & ~F.isnan(target) & F.col(date).isNotNull() & F.col(label_end).isNotNull()
    return out.where(ok & known)


def schema_issues(df: DataFrame, required: list[str], forbidden: list[str]) -> DataFrame:
    """What speaks against the columns as features: issue (missing, all_null, non_numeric, forbidden) and feature. One pass over the table."""
    spark, held = df.sparkSession, [c for c in required if c in df.columns]
    named = [("missing", c) for c in required if c not in df.columns] + [("forbidden", c) for c in forbidden]
    fixed = spark.createDataFrame(named, "issue string, feature string")  # a row for each column
    if not held:
        return fixed
    one = df.agg(*[F.struct(F.count(c).alias("known"), F.count(F.col(c).cast("string").try_cast("double")).alias("numeric")).alias(c) for c in held])
    each = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`.known"), F.col(f"`{c}`.numeric")) for c in held])).alias("f")).select("f.*")
    issues = F.array_compact(F.array(F.when(F.col("numeric") == 0, F.lit("all_null")), F.when((F.col("known") > 0) & (F.col("numeric") == 0), F.lit("non_numeric"))))
    return fixed.unionByName(each.select(F.explode(issues).alias("issue"), "feature"))


def leakage_audit(df: DataFrame, event: str, available: str, style_end: str, score_end: str, has_history: str) -> DataFrame:
    """Adds availability_check_passed, style_ok, manager_ok and leakage_check_passed.

    Features must be available before the event and both windows end before it; the score's window may be missing if there
    is no history. A missing date passes no check.
    """
    before = lambda c: F.coalesce(F.col(c) < F.col(event), F.lit(False))
    out = df.withColumns({"availability_check_passed": before(available), "style_ok": before(style_end), "manager_ok": before(score_end) | ~F.coalesce(F.col(has_history), F.lit(False))})
    return out.withColumn("leakage_check_passed", F.col("availability_check_passed") & F.col("style_ok") & F.col("manager_ok"))


def actions_with_predictions(actions: DataFrame, predictions: DataFrame, portfolio: str, date: str, future: str, probability: str, delta: str, tie: list[str]) -> DataFrame:
    """Actions with what was predicted for their portfolio and date: all columns of the predictions, outcome text and bucket, surest first.

    Portfolio ids are compared as text without a fraction. Of several predictions of one report the one with the highest
    probability counts, then the greater outcome. An action without a prediction stays, with an unknown outcome.
    """
    key = lambda d: d.withColumns({"_p": identifier(F.col(portfolio).cast("string")), "_d": F.to_date(date)})
    one = first_by(key(predictions).drop(portfolio, date), ["_p", "_d"], [F.desc_nulls_last(probability), F.desc_nulls_last(future)])
    got = key(actions).join(one, ["_p", "_d"], "left").drop("_p", "_d")
    got = got.withColumns({"outcome_text": outcome_text(F.col(future)), "result_bucket": outcome_bucket(F.col(future)), "signed_delta_abs": F.abs(zero_if_missing(F.col(delta)))})
    return got.orderBy(F.desc(F.coalesce(probability, F.lit(-1.0))), F.desc("signed_delta_abs"), *tie)


def calibration_warnings(rows: DataFrame, test_brier: str, validation_brier: str, mean_p: str, rate: str) -> DataFrame:
    """Adds calibration_warnings (an array): a Brier score more than 0.05 above that of validation, a mean probability more than 0.15 off the rate."""
    return rows.withColumn("calibration_warnings", F.array_compact(F.array(
        F.when(F.col(test_brier) > F.col(validation_brier) + 0.05, F.lit("test_brier_exceeds_validation_by_more_than_0.05")),
        F.when(F.abs(F.col(mean_p) - F.col(rate)) > 0.15, F.lit("calibrated_probability_mean_differs_from_actual_rate_by_more_than_0.15")),
    )))


def regime_metrics(train: DataFrame, test: DataFrame, direction: str, p: str, target: str, expected: str, threshold: float, regimes: dict[str, tuple[str, str]] = REGIMES) -> DataFrame:
    """Direction and regression figures of the test rows in each regime; a row can be in several.

    ``direction`` is 1, 0 or -1, and neutral rows count nowhere. Bars are medians of the training rows. Regimes whose feature is
    not in the table are left out. Regimes with fewer than 50 rows or one class have counts only and the status
    insufficient_support.
    """
    used = {name: rule for name, rule in regimes.items() if rule[0] in train.columns and rule[0] in test.columns}
    features = sorted({c for c, _ in used.values()})
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])).alias("f")).select("f.*")
    bars = {r["feature"]: r["q"][0] for r in percentiles_by(long, ["feature"], "x", [0.5]).collect()}  # a row for each feature

    def holds(feature: str, rule: str) -> Column:
        x, bar = F.col(feature).cast("double"), F.lit(bars.get(feature)).cast("double")
        return {"at_least_median": x >= bar, "below_median": x < bar, "positive": x > 0, "negative": x < 0}[rule]

    inside = F.array_compact(F.array(*[F.when(holds(*rule), F.lit(name)) for name, rule in used.items()]))
    rows = test.select(F.explode(inside).alias("regime"), F.col(direction).alias("_dir"), F.col(p).alias("_p_"), F.col(target).alias("_t"), F.col(expected).alias("_e"))
    rows = rows.where(F.col("_dir").isin(-1, 1)).select("regime", (F.col("_dir") == 1).cast("int").alias("y"), F.col("_p_").alias("p"), F.col("_t").alias("actual"), F.col("_e").alias("expected"))
    rows = written(rows, "regimes")  # read by four jobs
    names = test.sparkSession.createDataFrame([(n,) for n in used], "regime string")
    by = ["regime"]
    d = direction_metrics(rows, "y", "p", by, threshold)
    r = regression_metrics(rows, "actual", "expected", by).select("regime", "mae", "spearman", "hit_rate")
    all_ = names.join(d, by, "left").join(roc_auc(rows, "y", "p", by), by, "left").join(average_precision(rows, "y", "p", by), by, "left").join(r, by, "left")
    n, pos = F.coalesce("n", F.lit(0)), F.coalesce(F.col("tp") + F.col("fn"), F.lit(0))
    ok = (n >= SUPPORT) & (pos > 0) & (pos < n)
    figures = {"auc": F.col("auc"), "average_precision": F.col("average_precision"), "brier": F.col("brier"), "balanced_accuracy": (F.col("recall") + F.col("specificity")) / 2, "mae": F.col("mae"), "spearman": F.col("spearman"), "hit_rate": F.col("hit_rate")}
    return all_.select("regime", F.when(ok, "ok").otherwise("insufficient_support").alias("status"), n.alias("n"), pos.alias("positives"), (n - pos).alias("negatives"), (pos / F.nullif(n, F.lit(0))).alias("positive_rate"), *[F.when(ok, c).alias(k) for k, c in figures.items()])
