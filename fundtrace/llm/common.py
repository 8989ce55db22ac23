"""Shared helpers: scratch tables in the cluster's checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one on a local master, else an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows that go to a Python worker at once, at most: texts may be long, and a worker holds a batch several times over.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within this block, Python workers get ``rows`` rows at once, or as few as the session allows if that is less."""
    before = spark.conf.get(_BATCH, "10000")
    spark.conf.set(_BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def materialise(df: DataFrame, name: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back, which cuts its lineage. ``rows``: of a Python batch.

    The folder is deleted by :func:`release`, at the latest when the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with batches_of(spark, rows):
        df.write.parquet(path)
    at, files = _hadoop(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    for tables in _open:
        tables.append(out)
    return out


_open: list[list[DataFrame]] = []


@contextmanager
def scratch_released() -> Iterator[list[DataFrame]]:
    """Release, at the end of the block, what is materialised in it; take a table out of the list to keep it."""
    tables: list[DataFrame] = []
    _open.append(tables)
    try:
        yield tables
    finally:
        _open.remove(tables)
        release(*tables)


def release(*tables: DataFrame | None) -> None:
    """Delete tables that :func:`materialise` wrote and that nothing reads any more."""
    for t in tables:
        if t is not None and (path := getattr(t, "scratch_path", None)):
            at, files = _hadoop(t.sparkSession, path)
            files.delete(at, True)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of one input folder."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it has fewer partitions than there are cores, as a single small file has; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def row_key(id_col: str, text: Column, hashed: bool = False) -> Column:
    """Text that is the same for rows alike in id and text and for no others; null ids are alike. ``hashed``: text is its xxhash64."""
    i = F.col(id_col)
    return F.concat(F.when(i.isNull(), "-").otherwise(F.concat(F.lit("+"), i.cast("string"))), F.lit(":"), F.hex(text if hashed else F.xxhash64(text)))


def crc_of(column: str):
    """crc32 of a column as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def fit_logistic(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope (above 0) and shift of the logistic curve of y (0 or 1) on z, each with weight n; weakly pulled to 1, 0."""
    m, a = np.column_stack([z, np.ones_like(z)]), np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(m @ a, -50, 50)))
        gradient = m.T @ (n * (y - p)) - np.array([a[0] - 1.0, a[1]])
        step = np.linalg.solve((m * (n * p * (1 - p))[:, None]).T @ m + np.eye(2), gradient)
        a = a + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a[0], 1e-3)), float(a[1])
