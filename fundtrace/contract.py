"""Column roles of the event table, and the guard that keeps forbidden columns out of feature lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = {
    "identity": ["portfolio", "report_dt", "manager", "family"],
    "feature": ["stock", "bond", "cash", "d_stock", "d_bond", "d_cash", "exp_ratio", "turn_ratio", "flow"],
    "target": ["ret_3m", "ret_6m", "ret_9m", "ret_12m"],
    "forbidden": ["legacy_deviation", "outcome", "direction"],
}
FORBIDDEN_PREFIXES = ("future_", "label_", "ret_", "excess_", "actual_")


def forbidden(columns: list[str]) -> list[str]:
    return [c for c in columns if c in ROLES["forbidden"] or c.startswith(FORBIDDEN_PREFIXES)]


def check_features(columns: list[str]) -> list[str]:
    """The list itself; an error if a forbidden column is in it."""
    if bad := forbidden(columns):
        raise ValueError(f"forbidden feature columns: {', '.join(bad)}")
    return columns


def conform(df: DataFrame, columns: dict[str, str], text_default: str = "Unknown") -> DataFrame:
    """Columns of the contract in its order; absent ones null, null text as the default."""
    out = []
    for name, kind in columns.items():
        c = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        out.append((F.coalesce(c, F.lit(text_default)) if kind == "string" else c).alias(name))
    return df.select(*out)


def split_roles(df: DataFrame, event_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features, identity and outcomes, each with the event id."""
    pick = lambda role: df.select(event_id, *[c for c in ROLES[role] if c in df.columns and c != event_id])
    return pick("feature"), pick("identity"), pick("target")


def dictionary(df: DataFrame) -> DataFrame:
    """A row for each column: name, role (``other`` if the contract has none), whether a feature list may not have it, known values."""
    role = {c: r for r, cs in ROLES.items() for c in cs}
    bad = set(forbidden(df.columns))
    one = df.agg(*[F.count(c).alias(c) for c in df.columns])
    rows = [F.struct(F.lit(c).alias("name"), F.lit(role.get(c, "other")).alias("role"), F.lit(c in bad).alias("forbidden"), F.col(c).alias("known")) for c in df.columns]
    return one.select(F.explode(F.array(*rows)).alias("c")).select("c.*")
