"""Registry of queries: a Spark function and, where SQL can say it, DuckDB text over tables and views."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.plans.fixtures import duck_sql, view
from fundtrace.sources.scratch import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Views:
    """Tables and views of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.kept: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name, self.kept)

    def keep(self, *names: str) -> Views:
        """Write views that this query reads several times, in turn; what it names from then on reads them, also through other views."""
        for n in names:
            if n not in self.kept:
                self.kept[n] = written(getattr(self, n), n)
        return self

    def sql(self, text: str) -> DataFrame:
        """A query over tables and views, named as ``{name}``."""
        return self.spark.sql(text, **{n: getattr(self, n) for n in re.findall(r"\{(\w+)\}", text)})


def query(name: str, sql: str | None = None):
    """Register a function of Views as a query; doubles of its result are rounded to 6 digits, as the SQL must do."""

    def register(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(Views(spark, sf_dir)))
        if sql:
            SQL[name] = duck_sql(sql)
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])
