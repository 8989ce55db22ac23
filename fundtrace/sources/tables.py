"""Sources and sinks."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundtrace.functions.ingest import identifier


def period_union(parts: dict[str, DataFrame], keep: list[str]) -> DataFrame:
    """Union of period tables with the wanted columns, absent ones null, tagged by ``source_key``."""
    tagged = [d.select(*[c for c in keep if c in d.columns], F.lit(k).alias("source_key")) for k, d in parts.items()]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return both.select(*[c if c in both.columns else F.lit(None).cast("string").alias(c) for c in keep], "source_key")


def read_text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All-text read with an explicit schema; typed ingest comes after."""
    return spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).option("header", True).csv(path)


def month_series(df: DataFrame, month: Column, candidates: list[str], name: str) -> DataFrame:
    """Mean per month of the first candidate column that is there and not null."""
    found = [F.col(c) for c in candidates if c in df.columns]
    return df.groupBy(month.alias("month_idx")).agg(F.avg(F.coalesce(*found)).alias(name))


def rate_series(df: DataFrame, month_text: str, date: str, rate: str) -> tuple[DataFrame, DataFrame]:
    """Last rate of each month (rows whose month is yyyy-MM only), and the mean of each year."""
    rows = df.where(F.col(month_text).rlike(r"^\d{4}-\d{2}$"))
    monthly = rows.groupBy(month_text).agg(F.max_by(rate, F.struct(date, rate)).alias("rate"))
    return monthly, monthly.groupBy(F.substring(month_text, 1, 4).cast("int").alias("year")).agg(F.avg("rate").alias("rate"))


def first_known(df: DataFrame, key: str, value: str, order: list[Column], blank: str = "Unknown") -> DataFrame:
    """One value per key: the first non-blank by order, else ``blank``."""
    known = F.when(F.trim(value) != "", F.col(value))
    return df.groupBy(key).agg(F.coalesce(F.min_by(known, F.when(known.isNotNull(), F.struct(*order))), F.lit(blank)).alias(value))


def with_aliases(df: DataFrame, key: str, aliases: Column, by: list[str]) -> DataFrame:
    """Rows under each alias of their key; the row whose own key it is wins, then the smaller key."""
    from fundtrace.operators.joins import first_by

    each = df.withColumn("alias", F.explode(aliases))
    return first_by(each, ["alias", *by], [(F.col("alias") != F.col(key)).cast("int"), F.col(key)])


def knowledge_documents(spark: SparkSession, text_path: str | None = None, json_path: str | None = None, csv_path: str | None = None) -> DataFrame:
    """Documents of text files (whole), JSON (text, content or body) and CSV as title, doc_date, text."""
    parts = []
    if text_path:
        parts.append(spark.read.text(text_path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("title"), F.lit(None).cast("string").alias("doc_date"), F.col("value").alias("text")))
    for path, read in ((json_path, lambda p: spark.read.json(p, multiLine=True)), (csv_path, lambda p: spark.read.csv(p, header=True))):
        if path:
            d = read(path)
            if "documents" in d.columns:
                d = d.select(F.explode("documents").alias("d")).select("d.*")
            body = F.coalesce(*[F.col(c) for c in ("text", "content", "body") if c in d.columns])
            parts.append(d.select(*[F.col(c).alias(n) if c in d.columns else F.lit(None).cast("string").alias(n) for c, n in (("title", "title"), ("date", "doc_date"))], body.alias("text")))
    return reduce(lambda a, b: a.union(b), parts)


def event_table(spark: SparkSession, files: list[str], ids: list[str], date: str, window: str = "training_window_years", years: int = 3) -> DataFrame:
    """Events of the first of the Parquet ``files`` (newest first) that is there: ids as text without a decimal part, the
    date as yyyy-mm-dd, rows without a date left out, and of several training windows the one of ``years`` (missing counts as it).
    """
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = [(f, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)) for f in files]
    found = next((f for f, p in paths if p.getFileSystem(conf).exists(p)), None)
    if found is None:
        raise FileNotFoundError(", ".join(files))
    df = spark.read.parquet(found)
    if window in df.columns:
        df = df.where(F.coalesce(F.col(window).cast("int"), F.lit(years)) == years)
    df = df.withColumns({c: identifier(F.col(c).cast("string")) for c in ids if c in df.columns})
    return df.withColumn(date, F.date_format(F.to_date(date), "yyyy-MM-dd")).where(F.col(date).isNotNull())


def write_dataset(df: DataFrame, path: str, year_of: str) -> None:
    """Parquet by year of a date column; one shuffle by year keeps the files few."""
    df.withColumn("year", F.year(year_of)).repartition("year").write.mode("overwrite").partitionBy("year").parquet(path)


@dataclass(frozen=True)
class Audit:
    """Figures taken while a table is written: counts of the named values of columns, and describe blocks of numeric columns."""

    labels: dict[str, list] = field(default_factory=dict)
    described: tuple[str, ...] = ()

    def figures(self) -> list[tuple[str, str, Column]]:
        """Metric, value and aggregate."""
        out = [("rows", "", F.count(F.lit(1)).cast("double"))]
        for c, values in self.labels.items():
            known = [F.coalesce(F.col(c).cast("string") == str(x), F.lit(False)) for x in values]
            out += [(f"count of {c}", str(x), F.count_if(k).cast("double")) for x, k in zip(values, known, strict=True)]
            out += [(f"count of {c}", "(missing)", F.count_if(F.col(c).isNull()).cast("double")), (f"count of {c}", "(other)", F.count_if(F.col(c).isNotNull() & ~reduce(lambda a, b: a | b, known, F.lit(False))).cast("double"))]
        for c in self.described:
            x = F.col(c).cast("double")
            out += [(c, n, a) for n, a in (("count", F.count(x).cast("double")), ("mean", F.avg(x)), ("std", F.stddev_samp(x)), ("min", F.min(x)), ("max", F.max(x)))]
        return out


def publish(tables: dict[str, DataFrame], path: str, run: str, audits: dict[str, Audit] | None = None) -> DataFrame:
    """Write the tables of one run and then the manifest that publishes them together: table, metric, value, figure.

    Each table goes to ``path/run/table`` and its audit is observed during that write, without another pass. The manifest
    comes last and is committed as a whole: a run that fails before it leaves nothing for :func:`published` to see.
    """
    spark, rows = next(iter(tables.values())).sparkSession, []
    for name, df in tables.items():
        figures = (audits or {}).get(name, Audit()).figures()
        seen = Observation()
        df.observe(seen, *[a.alias(f"f{i}") for i, (_, _, a) in enumerate(figures)]).write.parquet(f"{path}/{run}/{name}")
        rows += [(run, name, metric, value, seen.get[f"f{i}"]) for i, (metric, value, _) in enumerate(figures)]
    manifest = spark.createDataFrame(rows, "run string, table string, metric string, value string, figure double")
    manifest.coalesce(1).write.parquet(f"{path}/_manifests/{run}")
    return spark.read.parquet(f"{path}/_manifests/{run}")


def published(spark: SparkSession, path: str) -> tuple[str | None, dict[str, DataFrame]]:
    """The last published run by name and its tables; none if there is none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifests")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifests/*/_SUCCESS")) or []
    runs = sorted(f.getPath().getParent().getName() for f in found)
    if not runs:
        return None, {}
    names = [r["table"] for r in spark.read.parquet(f"{path}/_manifests/{runs[-1]}").select("table").distinct().collect()]  # a row for each table
    return runs[-1], {n: spark.read.parquet(f"{path}/{runs[-1]}/{n}") for n in names}


def audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Value counts of the columns as metric, value, n, with the number of rows."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.coalesce(F.col(c).cast("string"), F.lit("(missing)")).alias("value")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("metric", "value").agg(F.count("*").alias("n"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free hash of a table: rows, and sum and xor of row hashes; two tables alike have the same."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))
