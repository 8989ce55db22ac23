"""Streaming form of the portfolio-month aggregation over arriving month files, and labels that mature later."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from fundtrace.functions.labels import label_window


def stream_of_files(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def portfolio_windows(rows: DataFrame, ts: str, key: str, value: str, late: str = "62 days", width: str = "30 days") -> DataFrame:
    """Count and sum per key and event-time window; state of windows older than the watermark goes."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def mature_labels(events: DataFrame, date: str, horizon: int, observed_until: str) -> DataFrame:
    """Whether each event's label window has ended by a day; called again as that day moves on."""
    end = label_window(F.col(date), horizon)[1]
    return events.withColumn("label_end", end).withColumn("label_available", F.col("label_end") <= F.to_date(F.lit(observed_until)))


def upsert_months(rows: DataFrame, target: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Write each micro-batch as its own folder; a batch that is run again replaces its folder, so results stay exact."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
