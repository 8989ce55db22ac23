"""Operator 2: quality classifier, a regularised quadratic discriminant on document statistics.

Each text becomes a fixed vector of transformed statistics (length, letters, symbols, repetition). From labelled rows
Spark sums each class's count, vector and outer product; the class covariances are shrunk towards their pooled
diagonal. Their Cholesky factors are computed once and sent to the tasks, which score by the difference of the
Mahalanobis log-densities. A logistic curve on that difference, fitted to counts in fixed bins, makes it a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm.common import crc_of, documents, fit_logistic, materialise

FEATURES = (
    "words", "word_length", "upper", "digits", "symbols", "symbols_of_words", "distinct", "top_word", "repeated_pairs",
    "repeated_lines", "line_words", "ends", "entropy", "longest_word",
)
MARKED = re.compile(r"[^\w\s]{2,}(?=\s|\Z)|(?:^|\s)[^\w\s]+(?=\s|\Z)")
#: Weight of the pooled diagonal in each class covariance, and what is added to its diagonal.
SHRINKAGE, RIDGE = 0.15, 1e-2
#: Half-width of the bins of asinh(log-density difference) for the logistic curve.
BINS, REACH = 400, 20.0


def _rate(x: float, of: float) -> float:
    return math.log((x + 0.5) / (of + 25.0))


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, one for each name in ``FEATURES``; finite for any text."""
    text = text or ""
    words = text.split()
    n, size = len(words), len(text)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = Counter(zip(words, words[1:]))
    letters = Counter(text)
    upper = sum(c for x, c in letters.items() if x.isupper())
    digits = sum(c for x, c in letters.items() if x.isdigit())
    symbols = sum(c for x, c in letters.items() if not x.isalnum() and not x.isspace())
    entropy = -sum(c / size * math.log(c / size) for c in letters.values()) if size else 0.0
    return [
        math.log1p(n),
        math.log1p(sum(map(len, words)) / n) if n else 0.0,
        _rate(upper, size),
        _rate(digits, size),
        _rate(symbols, size),
        _rate(len(MARKED.findall(text)), n),
        (len(counts) + 5) / (n + 5) * math.log1p(math.log1p(n)),
        _rate(max(counts.values(), default=0), n),
        _rate(n - 1 - len(pairs) if n else 0, n),
        _rate(len(lines) - len(set(lines)), len(lines)),
        math.log1p(n / len(lines)) if lines else 0.0,
        _rate(sum(x.rstrip()[-1] in ".!?:;\"'" for x in lines), len(lines)),
        entropy,
        math.log1p(max(map(len, counts), default=0)),
    ]


def featurise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and statistics (array of double) of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "x": [statistics(t) for t in b["t"]]})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(run, f"id {kind}, x array<double>")


@dataclass
class Discriminant:
    """Means and Cholesky factors of two classes, and the logistic curve. Without both classes the score is constant."""

    means: np.ndarray | None
    factors: np.ndarray | None
    offset: float
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self) -> None:
        """Inverses of the factors, worked out once, so that a batch is whitened by one product."""
        self.inverses = None if self.factors is None else np.linalg.inv(self.factors)
        self.log_sizes = None if self.factors is None else [np.log(np.diag(f)).sum() for f in self.factors]

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, priors included."""
        if self.means is None:
            return np.full(len(x), self.offset)
        logs = []
        for mean, inverse, log_size in zip(self.means, self.inverses, self.log_sizes, strict=True):
            z = (x - mean) @ inverse.T
            logs.append(-0.5 * (z * z).sum(axis=1) - log_size)
        return logs[1] - logs[0] + self.offset

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * np.arcsinh(self.difference(x)) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(labelled: DataFrame) -> Discriminant:
    """Fit to rows with x (statistics) and y (0 or 1), all of them."""
    d = len(FEATURES)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for y, part in b.groupby("y"):
                x = np.stack(part["x"].to_list())
                flat = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
                yield pd.DataFrame({"y": int(y), "at": np.arange(len(flat)), "v": flat})

    rows = labelled.mapInPandas(sums, "y int, at int, v double").groupBy("y", "at").agg(F.sum("v").alias("v")).collect()  # 2 * (1 + d + d * d)
    got = {y: np.zeros(1 + d + d * d) for y in (0, 1)}
    for r in rows:
        got[r["y"]][r["at"]] = r["v"]
    n = np.array([got[y][0] for y in (0, 1)])
    offset = float(np.log((n[1] + 1) / (n[0] + 1)))
    if n.min() < 2:
        return Discriminant(None, None, float(np.sinh(offset)))
    means = np.stack([got[y][1 : d + 1] / n[y] for y in (0, 1)])
    own = np.stack([got[y][d + 1 :].reshape(d, d) / n[y] - np.outer(means[y], means[y]) for y in (0, 1)])
    pooled = np.diag((own * (n / n.sum())[:, None, None]).sum(axis=0).diagonal())
    shrunk = (1 - SHRINKAGE) * own + SHRINKAGE * pooled + RIDGE * np.eye(d)
    model = Discriminant(means, np.linalg.cholesky(shrunk), offset)
    return _calibrate(model, labelled)


def _calibrate(model: Discriminant, labelled: DataFrame) -> Discriminant:
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = np.arcsinh(shared.value.difference(np.stack(b["x"].to_list()))) if len(b) else np.empty(0)
            at = np.clip((z + REACH) / (2 * REACH) * BINS, 0, BINS - 1).astype(int)
            yield pd.DataFrame({"at": at, "y": b["y"].to_numpy()}).groupby(["at", "y"]).size().rename("n").reset_index()

    rows = labelled.mapInPandas(binned, "at int, y int, n long").groupBy("at", "y").agg(F.sum("n").alias("n")).collect()  # at most 2 * BINS
    z = np.array([(r["at"] + 0.5) / BINS * 2 * REACH - REACH for r in rows])
    y, n = np.array([r["y"] for r in rows], float), np.array([r["n"] for r in rows], float)
    return Discriminant(model.means, model.factors, model.offset, *fit_logistic(z, y, n))


def classify(df: DataFrame, labels: DataFrame, label_col: str, train: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every row: ``id_col``, held_out and score (0 to 1).

    ``labels`` has ``id_col`` and ``label_col`` (0 or 1; null or other values are no labels); only rows for which the
    SQL expression ``train`` (over a column named id) holds teach the model. A label that is repeated counts each time.
    Text that is null is taken as empty; rows that repeat stay. Without labels of both classes every score is the share
    of class 1, each class starting from one row.
    """
    base = materialise(featurise(df, id_col, text_col), "statistics")
    y = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").where(F.expr(train))
    model = fit(base.join(y, "id").select("x", "y"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "score": shared.value.score(np.stack(b["x"].to_list()))})

    kind = df.schema[id_col].dataType.simpleString()
    out = base.mapInPandas(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), (~F.coalesce(F.expr(train), F.lit(False))).alias("held_out"), "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = classify(documents(spark, sf_dir), labels, "quality", "crc32(cast(cast(id as string) as binary)) % 5 != 0")
    return out.select("doc_id", (crc_of("doc_id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
