"""Typed ingest: raw text to typed columns with reasons for what was rejected. Missing is always null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_WORDS = ("", "NULL", "NAN", "NONE", "N/A", ".")


def text(c: Column) -> Column:
    """Trimmed; null words are null."""
    t = F.trim(c)
    return F.when(~F.upper(t).isin(*NULL_WORDS), t)


def identifier(c: Column) -> Column:
    """Text without the fraction of a whole number."""
    return F.regexp_replace(text(c), r"^(-?\d+)\.0+$", "$1")


def number(c: Column, percent: str = "divide") -> Column:
    """Number from text with commas, percent signs and parentheses for negatives. ``percent``: divide or strip."""
    t = text(c)
    bare = F.regexp_replace(t, r"[,%\s$]", "")
    value = F.regexp_replace(bare, r"^\((.*)\)$", "-$1").try_cast("double")
    value = F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
    return F.when(t.contains("%"), value / 100).otherwise(value) if percent == "divide" else value


def percent_scale(x: Column, bar: float = 1.5) -> Column:
    """Percent figures to shares where they are too large to be shares; ``bar`` 0 always divides."""
    return F.when(F.abs(x) > bar, x / 100).otherwise(x)


def plausible(x: Column, low: float = -0.25, high: float = 1.5) -> Column:
    return F.when(x.between(low, high), x)


def date(c: Column) -> Column:
    """Date from yyyy-MM-dd, yyyy/M/d, yyyyMMdd or yyyyMM (its first day)."""
    t = text(c)
    return F.coalesce(*[F.try_to_date(t, f) for f in ("yyyy-MM-dd", "yyyy/M/d", "yyyyMMdd")], F.try_to_date(F.when(F.length(t) == 6, F.concat(t, F.lit("01"))), "yyyyMMdd"))


def month_idx(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d)


def ticker(c: Column) -> Column:
    return F.upper(F.regexp_replace(text(c), r"\s+", ""))


def ticker_aliases(c: Column) -> Column:
    """The ticker with dots and with dashes, each once."""
    return F.array_distinct(F.array(c, F.replace(c, F.lit("."), F.lit("-")), F.replace(c, F.lit("-"), F.lit("."))))


def loose_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def safe_log1p(x: Column) -> Column:
    return F.when(x > -0.999999, F.log1p(x))


def safe_expm1(x: Column) -> Column:
    return F.when(F.abs(x) <= 700, F.expm1(x))


def typed(df: DataFrame, rules: dict[str, tuple[str, object]]) -> DataFrame:
    """Apply rules {column: (source column, function)} and add reject_reason: columns whose text was there but not usable."""
    made = {name: rule(F.col(source)) for name, (source, rule) in rules.items()}
    reasons = F.array_compact(F.array(*[F.when(text(F.col(source)).isNotNull() & made[name].isNull(), F.lit(name)) for name, (source, _) in rules.items()]))
    return df.select(*[c.alias(n) for n, c in made.items()], reasons.alias("reject_reason"))


def rejects(df: DataFrame) -> DataFrame:
    """How often each column was rejected."""
    return df.select(F.explode("reject_reason").alias("column")).groupBy("column").agg(F.count("*").alias("n"))


def calendar_parts(date: str, first: str) -> list[Column]:
    """Year, month and both as one number of a date and of a first date; age in fractional and in whole years."""
    d, f = F.col(date), F.col(first)
    part = lambda c: F.month(c) * 100 + F.dayofmonth(c)
    numbers = {"year": F.year, "month": F.month, "time": lambda c: F.year(c) * 100 + F.month(c)}
    out = [g(c).cast("int").alias(prefix + n) for prefix, c in (("", d), ("first_", f)) for n, g in numbers.items()]
    return [*out, (F.datediff(d, f) / 365.25).alias("age_exact"), (F.year(d) - F.year(f) - (part(d) < part(f)).cast("int")).alias("age")]


def horizon_aliases(df: DataFrame, years: int, measures: list[str], keep: list[str]) -> DataFrame:
    """Columns ``<measure>_<years>y`` under the measure's plain name, null where the table has none, with the window's length."""
    plain = [(F.col(f"{m}_{years}y") if f"{m}_{years}y" in df.columns else F.lit(None).cast("double")).alias(m) for m in measures]
    return df.select(*keep, F.lit(years).alias("training_window_years"), F.lit(12 * years).alias("training_window_months"), *plain)
