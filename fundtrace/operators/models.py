"""Model jobs on pyspark.ml and the data work around them. Splits are columns; metrics are rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fundtrace.operators.evaluation import direction_metrics, roc_auc
from fundtrace.operators.scores import number_rows, percentiles_by
from fundtrace.sources.scratch import written


def infer_features(df: DataFrame, columns: list[str], least: int = 20) -> DataFrame:
    """Numeric counts of each column and whether it can be a feature, in one pass."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).withColumn("_", F.lit(1)).unpivot(["_"], columns, "feature", "x")
    out = long.groupBy("feature").agg(F.count("x").alias("known"), F.count_if(F.col("x").try_cast("double").isNotNull()).alias("numeric"))
    return out.withColumn("usable", F.col("numeric") >= least)


def preprocessing(columns: list[str]) -> list:
    """Median imputation and standardising, to be fitted on training rows only."""
    filled = [f"{c}_filled" for c in columns]
    return [Imputer(strategy="median", inputCols=columns, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw", handleInvalid="skip"), StandardScaler(withMean=True, inputCol="raw", outputCol="features")]


def fitted(estimator, rows: DataFrame):
    """The fitted model without its training summary.

    Summaries of classifiers keep the session, which goes with the model to the executors; it can't be sent any more once
    something in it has been observed (:func:`sources.tables.publish` observes its audits).
    """
    model = estimator.fit(rows)
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(rows.sparkSession._jvm.scala.Option.empty())
    return model


#: Parameter sets of the boosted trees: depth, step, least rows of a leaf, share of rows, share of columns.
BOOSTED = [(2, 0.02, 20, 0.8, 0.75), (2, 0.03, 10, 0.9, 0.9), (2, 0.05, 30, 0.7, 0.6), (3, 0.02, 30, 0.9, 0.75), (3, 0.03, 20, 0.8, 0.9), (3, 0.05, 10, 0.7, 0.6)]


def direction_candidates(seed: int = 7, trees: int = 10) -> dict[str, object]:
    """Candidate classifiers on features, y and weight: a plain one, a forest, and boosted trees by six parameter sets.

    ``trees`` is the number of boosting rounds and half that of the forest's trees; penalties on leaf weights have no
    counterpart in these classes and are left out.
    """
    common = {"featuresCol": "features", "labelCol": "y", "weightCol": "weight"}
    out: dict[str, object] = {
        "logistic": LogisticRegression(regParam=0.01, **common),
        "forest": RandomForestClassifier(numTrees=2 * trees, maxDepth=9, minInstancesPerNode=12, seed=seed, **common),
    }
    for i, (depth, step, leaf, share, columns) in enumerate(BOOSTED):
        out[f"boosted_{i + 1}"] = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, minInstancesPerNode=leaf, subsamplingRate=share, featureSubsetStrategy=str(columns), seed=seed + i, **common)
    return out


def fit_direction(rows: DataFrame, columns: list[str], split: str = "split", names: tuple[str, ...] | None = None) -> DataFrame:
    """Scores of all rows by each candidate (or those named), weighted and not: candidate, event_id, split, y, p.

    The weight of the positive rows is negative / positive of the training rows, from 1 to 10; 10 if none is positive.
    """
    base = rows.where(F.col(split) == "base")
    prepared = Pipeline(stages=preprocessing(columns)).fit(base).transform(rows).cache()
    n, positive = base.agg(F.count("*"), F.coalesce(F.sum(F.col("y").cast("long")), F.lit(0))).first()
    raw = (n - positive) / positive if positive else 10.0
    scale = min(10.0, max(1.0, raw))
    out = None
    for weighted in (False, True):
        data = prepared.withColumn("weight", F.when(F.col("y") == 1, scale).otherwise(1.0) if weighted else F.lit(1.0))
        for name, candidate in direction_candidates().items():
            if names and name not in names:
                continue
            model = fitted(candidate, data.where(F.col(split) == "base"))
            scored = model.transform(data).select(F.lit(f"{name}{'_weighted' * weighted}").alias("candidate"), "event_id", split, "y", vector_to_array("probability")[1].alias("p"))
            out = scored if out is None else out.union(scored)
    return out


def calibrate(scores: DataFrame, split: str = "split") -> DataFrame:
    """Scores of one candidate without and with sigmoid and isotonic calibration, fitted on calibration rows."""
    fit_on = scores.where(F.col(split) == "calibration")
    vec = scores.withColumn("v", array_to_vector(F.array("p")))
    sigmoid = fitted(LogisticRegression(featuresCol="v", labelCol="y"), fit_on.withColumn("v", array_to_vector(F.array("p"))))
    isotonic = IsotonicRegression(featuresCol="p", labelCol="y", predictionCol="q").fit(fit_on)
    kept = ["event_id", split, "y"]
    none = scores.select(F.lit("none").alias("method"), *kept, "p")
    a = sigmoid.transform(vec).select(F.lit("sigmoid").alias("method"), *kept, vector_to_array("probability")[1].alias("p"))
    b = isotonic.transform(scores).select(F.lit("isotonic").alias("method"), *kept, F.least(F.lit(1.0), F.greatest(F.lit(0.0), "q")).alias("p"))
    return none.union(a).union(b)


def choose(scores: DataFrame, by: str, split: str = "validation") -> DataFrame:
    """Validation metrics of each candidate or method, best first: area, then Brier score."""
    held = scores.where(F.col("split") == split)
    m = direction_metrics(held, "y", "p", [by], 0.5).join(roc_auc(held, "y", "p", [by]), by, "left")
    return m.withColumn("place", F.row_number().over(W.orderBy(F.desc_nulls_last("auc"), "brier", by)))  # a row for each candidate


def fit_magnitude(rows: DataFrame, columns: list[str], target: str, split: str = "split", tail: float = 0.02) -> DataFrame:
    """Predicted sizes of one side by three linear families, with and without winsorised targets: candidate, event_id, split, actual, predicted."""
    base = rows.where(F.col(split) == "base")
    prepared = Pipeline(stages=preprocessing(columns)).fit(base).transform(rows).cache()
    low, high = prepared.where(F.col(split) == "base").agg(F.percentile(target, F.lit(tail)), F.percentile(target, F.lit(1 - tail))).first()
    families = {"ridge": {"regParam": 0.1}, "elastic": {"regParam": 0.01, "elasticNetParam": 0.5}, "huber": {"loss": "huber", "regParam": 0.01}}
    out = None
    for cut in (False, True):
        data = prepared.withColumn("size", F.least(F.greatest(F.col(target), F.lit(low)), F.lit(high)) if cut else F.col(target))
        for name, params in families.items():
            model = fitted(LinearRegression(featuresCol="features", labelCol="size", predictionCol="predicted", **params), data.where(F.col(split) == "base"))
            scored = model.transform(data).select(F.lit(f"{name}{'_winsorised' * cut}").alias("candidate"), "event_id", split, F.col(target).alias("actual"), F.greatest(F.lit(0.0), "predicted").alias("predicted"))
            out = scored if out is None else out.union(scored)
    return out


def shuffled(df: DataFrame, key: str, column: str, seed: int) -> DataFrame:
    """The column's values dealt anew: the n-th by key gets the value of the n-th by hash."""
    a = number_rows(df.drop(column), [F.col(key)], "_nth")
    b = number_rows(df.select(key, column), [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)], "_nth").select("_nth", column)
    return a.join(b, "_nth").select(df.columns)


def linear_contributions(rows: DataFrame, weights: dict[str, float], means: dict[str, float], intercept: float, key: str) -> DataFrame:
    """Contribution of each feature to a linear score: key, feature, value, contribution; they add up to score - base."""
    parts = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), ((F.col(f) - means[f]) * w).alias("contribution")) for f, w in weights.items()]
    return rows.select(key, F.explode(F.array(*parts)).alias("c")).select(key, "c.*").withColumn("base", F.lit(intercept + sum(weights[f] * means[f] for f in weights)))


def deviation_contributions(rows: DataFrame, importance: dict[str, float], key: str, score: str) -> DataFrame:
    """(x - median) * importance of each feature, and as base what is left of the score."""
    features = list(importance)
    long = rows.select(*[F.col(f).cast("double").alias(f) for f in features]).withColumn("_", F.lit(1)).unpivot(["_"], features, "feature", "x")
    middle = {r["feature"]: r["q"][0] for r in percentiles_by(long, ["feature"], "x", [0.5]).collect()}  # a row for each feature
    df = rows
    parts = {f: F.coalesce((F.col(f) - F.lit(middle.get(f)).cast("double")) * w, F.lit(0.0)) for f, w in importance.items()}
    base = F.col(score) - sum(parts.values(), F.lit(0.0))
    return df.select(key, base.alias("base"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), c.alias("contribution")) for f, c in parts.items()])).alias("c")).select(key, "base", "c.*")


def top_features(contributions: DataFrame, key: str, k: int) -> DataFrame:
    """The k features of largest absolute contribution for each key."""
    w = W.partitionBy(key).orderBy(F.abs("contribution").desc(), "feature")
    return contributions.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def clusters(vectors: DataFrame, key: str, vector: str, seed: int = 1) -> DataFrame:
    """KMeans with clamp(round(sqrt(n / 2)), 2, 5) clusters and two display axes: key, cluster, x, y."""
    n = vectors.count()
    k = max(2, min(5, round((n / 2) ** 0.5)))
    df = vectors.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features")).cache()
    placed = KMeans(k=k, seed=seed).fit(df).transform(df)
    axes = PCA(k=2, inputCol="features", outputCol="axes").fit(df).transform(placed)
    return axes.select(key, F.col("prediction").alias("cluster"), vector_to_array("axes")[0].alias("x"), vector_to_array("axes")[1].alias("y"))


#: Pivots of the similarity join, and rows of a block.
PIVOTS, BLOCK = 32, 512


def near_pairs(vectors: DataFrame, key: str, vector: str, bar: float) -> DataFrame:
    """All pairs of rows whose vectors have a cosine of at least ``bar``: i, j (j before i by key).

    Exact, by the triangle inequality of angles: each vector lives in the cell of its nearest pivot, and visits each cell to
    whose pivot its angle is at most that to its own plus twice the angle of the bar; no pair above the bar escapes. Cells
    are dealt in blocks of residents and visitors, which meet as matrix products. Pivots are a few rows by hash of key; they
    decide how much is left out, not what is found. Keys are unique; vectors are not null, of one length and not zero.
    """
    limit = math.acos(bar)
    first = vectors.select(vector, F.xxhash64(key, F.lit(28)).alias("_h")).orderBy("_h", vector).limit(PIVOTS).collect()  # a few rows
    kind = vectors.schema[key].dataType.simpleString()
    if not first:
        return vectors.sparkSession.createDataFrame([], f"i {kind}, j {kind}")
    pivots = np.array([r[0] for r in first], dtype=np.float64)
    pivots /= np.linalg.norm(pivots, axis=1)[:, None]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack([np.asarray(v, dtype=np.float64) for v in b["v"]]) if len(b) else np.zeros((0, pivots.shape[1]))
            x = x / np.linalg.norm(x, axis=1)[:, None]
            angle = np.arccos(np.clip(x @ pivots.T, -1, 1))
            home = angle.argmin(axis=1) if len(x) else np.zeros(0, int)
            visits = angle <= angle.min(axis=1)[:, None] + 2 * limit + 1e-9 if len(x) else angle > 9
            yield pd.DataFrame({"k": b["k"], "v": list(x), "home": home.astype(np.int32), "cells": [np.flatnonzero(v).astype(np.int32) for v in visits]})

    placed = written(vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInPandas(place, f"k {kind}, v array<double>, home int, cells array<int>"), "placed")
    sizes = placed.select("home", F.explode("cells").alias("cell")).groupBy("cell").agg(F.count_if(F.col("home") == F.col("cell")).alias("homes"), F.count("*").alias("visits"))
    sizes = sizes.select("cell", *[F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int").alias(c) for c in ("homes", "visits")])  # a row for each pivot
    part = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    residents = placed.select("k", "v", F.col("home").alias("cell")).join(F.broadcast(sizes), "cell").select("cell", part("homes").alias("a"), others("visits").alias("b"), F.lit(True).alias("lives"), "k", "v")
    visitors = placed.select("k", "v", F.explode("cells").alias("cell")).join(F.broadcast(sizes), "cell").select("cell", others("homes").alias("a"), part("visits").alias("b"), F.lit(False).alias("lives"), "k", "v")

    def meet(t: pd.DataFrame) -> pd.DataFrame:
        lives = t["lives"].to_numpy(bool)
        here, there = t[lives], t[~lives]
        if here.empty or there.empty:
            return pd.DataFrame({"i": there["k"].iloc[:0], "j": here["k"].iloc[:0]})
        dots = np.stack(there["v"].to_list()) @ np.stack(here["v"].to_list()).T
        i, j = np.nonzero(dots >= bar - 1e-12)
        out = pd.DataFrame({"i": there["k"].to_numpy()[i], "j": here["k"].to_numpy()[j]})
        return out[out["j"] < out["i"]]

    return residents.union(visitors).groupBy("cell", "a", "b").applyInPandas(meet, f"i {kind}, j {kind}")


def greedy_groups(vectors: DataFrame, key: str, vector: str, bar: float = 0.92) -> DataFrame:
    """Leader rule: in order of key, a row that no earlier leader reaches by cosine is a leader; others join the first that
    reaches them. Returns key, leader.

    Rows of one vector share their leader, so each vector is settled once, by its first row. Pairs above the bar are found by
    :func:`near_pairs`; leaders are settled in rounds over that table, each written out: a vector is settled once its earlier
    neighbours are. Rows whose vector is null, zero or has a null or non-finite component lead themselves.
    """
    v = vectors.select(key, F.transform(vector, lambda x: x.cast("double")).alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.withColumn("_ok", F.coalesce(sound, F.lit(False)))
    first = v.where("_ok").groupBy("v").agg(F.min(key).alias("i"))
    classes = written(first, "vectors")
    near = written(near_pairs(classes, "i", "v", bar), "near")
    state = written(classes.select("i", F.lit(None).cast("boolean").alias("leads")), "leaders")
    while True:  # at least the first open vector is settled in each round
        known = near.join(state.select(F.col("i").alias("j"), F.col("leads").alias("before")), "j")
        said = known.groupBy("i").agg(F.bool_or(F.coalesce("before", F.lit(False))).alias("reached"), F.bool_or(F.col("before").isNull()).alias("open"))
        state = state.join(said, "i", "left").select("i", F.when(F.coalesce("reached", F.lit(False)), False).when(F.coalesce("open", F.lit(False)), None).otherwise(True).alias("leads"))
        state = written(state, "leaders")
        if state.where("leads is null").isEmpty():
            break
    leaders = state.where("leads").select(F.col("i").alias("j"))
    joined = near.join(leaders, "j").groupBy("i").agg(F.min("j").alias("_l"))
    of = state.join(joined, "i", "left").select("i", F.when(F.col("leads"), F.col("i")).otherwise(F.col("_l")).alias("leader"))
    settled_ = v.where("_ok").join(classes, "v").join(of, "i").select(key, "leader")
    return settled_.union(v.where("NOT _ok").select(key, F.col(key).alias("leader")))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, e: s + e)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))
