"""Nested walk-forward training: outer folds, training windows, an inner split of each, and one table of predictions.

Rows are dealt into folds, windows and inner splits once and written. Each fold and window is prepared once on its base
rows; candidates are fitted side by side by a few threads that hand jobs to Spark, and every score goes into one table.
All choices (calibration, threshold, candidate, size of the outcome) are then made by grouped jobs over that table, so their number
doesn't grow with folds, windows or candidates. Test rows take no part in any choice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fundtrace.operators import evaluation as ev
from fundtrace.operators import selection as sl
from fundtrace.operators.models import BOOSTED, direction_candidates, fitted, preprocessing
from fundtrace.operators.scores import number_rows
from fundtrace.sources.scratch import scratch_path, written

#: Support that isotonic calibration needs (rows, rows of each class, different scores).
ISOTONIC = (1000, 200, 50)
#: Order of calibrations on a tie; weights of Brier score and rate gap in their choice.
PREFERENCE, BRIER_WEIGHT, GAP_WEIGHT = {"sigmoid": 0, "none": 1, "isotonic": 2}, 0.5, 0.25
#: Weights of the candidate score, and what a level of depth and a threshold without safety cost.
CANDIDATE_WEIGHTS, DEPTH_COST, UNSAFE_COST = {"auc": 1.0, "average_precision": 0.5, "balanced": 0.3, "brier": -0.5, "gap": -0.25}, 0.005, 1.0
#: Least base and validation rows of a size model, winsor shares, weights of its score, quantile of large outcomes, neutral band.
SIZE_ROWS, WINSOR, SIZE_SCORE, LARGE, NEUTRAL = (50, 20), (0.01, 0.99), {"mae": 1.0, "rmse": 0.25, "spearman": -0.1}, 0.67, 0.005
#: Inner cuts by share of dates and the least number of dates.
CUTS, LEAST_DATES = (0.45, 0.8), 12
GROUP = ["fold", "window_years"]


def nested_splits(rows: DataFrame, features: list[str], windows: Iterable[int | None], folds: int = 3, date: str = "report_dt", label_end: str = "label_end") -> tuple[DataFrame, DataFrame]:
    """Rows by fold, window and split (base, calibration, validation, test), and whether each fold and window can be used.

    ``rows`` has a key, ``date``, ``label_end``, direction (-1, 0, 1), excess and the features. Training rows are cut by whole
    dates; a label must end before the next part begins. Neutral rows (0) are only in tests. A group can be used with
    twelve dates, both directions in each part and no feature without values in base; others keep only their status.
    """
    each = ev.training_windows(ev.walk_forward(rows, date, label_end, folds), date, list(windows))
    dates = each.where("role = 'train'").select(*GROUP, date).distinct()
    w = W.partitionBy(*GROUP)  # a row for each date
    placed = dates.withColumns({"_i": F.row_number().over(w.orderBy(date)) - 1, "_n": F.count("*").over(w)})
    start = lambda cut, least: F.min(F.when(F.col("_i") == F.greatest(F.lit(least), F.floor(F.col("_n") * cut)), F.col(date)))
    cuts = placed.groupBy(*GROUP).agg(F.max("_n").alias("dates"), start(CUTS[0], 2).alias("_calibration"), start(CUTS[1], 3).alias("_validation"))
    each = each.join(F.broadcast(cuts), GROUP)  # a row for each fold and window
    ended = lambda c: F.col(label_end) < F.col(c)
    split = (
        F.when(F.col("role") == "test", "test").when(F.col("direction") == 0, None)
        .when(F.col(date) >= F.col("_validation"), "validation")
        .when((F.col(date) >= F.col("_calibration")) & ended("_validation"), "calibration")
        .when((F.col(date) < F.col("_calibration")) & ended("_calibration"), "base")
    )
    dealt = written(each.withColumn("split", split).where("split is not null").drop("role", "_calibration", "_validation"), "splits", GROUP)
    both = [(F.count_if((F.col("split") == s) & (F.col("direction") == d)) > 0) for s in ("base", "calibration", "validation") for d in (-1, 1)]
    known = [F.count(F.when(F.col("split") == "base", F.col(f))) > 0 for f in features]
    all_ = lambda cs: F.array_min(F.array(*cs))
    parts = dealt.groupBy(*GROUP).agg(F.count_if(F.col("split") != "test").alias("rows"), all_(both).alias("_both"), all_(known).alias("_known"))
    status = F.when(F.col("dates") < LEAST_DATES, "too_few_dates").when(~F.coalesce("_both", F.lit(False)), "one_direction_only").when(~F.col("_known"), "feature_without_values").otherwise("ok")
    return dealt, cuts.join(parts, GROUP, "left").select(*GROUP, "dates", F.coalesce("rows", F.lit(0)).alias("rows"), status.alias("status"))


def side_by_side(work: Callable[[Any], Any], tasks: list, threads: int = 8) -> list:
    """Results of independent jobs that the driver hands to Spark from a few threads."""
    if not tasks:
        return []
    with ThreadPool(min(threads, len(tasks))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(work), tasks)


def _part(df: DataFrame, path: str) -> None:
    """Write one part of a table: each job has a folder of its own, as jobs that run side by side can't share one."""
    df.coalesce(1).write.parquet(f"{path}/{uuid.uuid4().hex}")


def _parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


@dataclass
class Trained:
    """Tables of a run: splits, groups (their status), scores (each candidate and calibration), sizes (each size model) and fitted models."""

    splits: DataFrame
    groups: DataFrame
    scores: DataFrame
    sizes: DataFrame
    models: dict[tuple, tuple] = field(default_factory=dict)


def _methods(raw: DataFrame) -> list[DataFrame]:
    """Raw scores (p) and, fitted on their calibration rows, those of the sigmoid and, given its support, the isotonic calibration."""
    fit_on = raw.where("split = 'calibration'")
    n, ones, different = fit_on.agg(F.count("*"), F.sum("y"), F.count_distinct("p")).first()
    as_vector = lambda df: df.withColumn("_v", array_to_vector(F.array("p")))
    out = [raw.withColumn("method", F.lit("none"))]
    sigmoid = fitted(LogisticRegression(featuresCol="_v", labelCol="y", probabilityCol="_s", rawPredictionCol="_r", predictionCol="_q"), as_vector(fit_on))
    out.append(sigmoid.transform(as_vector(raw)).withColumn("p", vector_to_array("_s")[1]).select(*raw.columns, F.lit("sigmoid").alias("method")))
    if n >= ISOTONIC[0] and min(ones, n - ones) >= ISOTONIC[1] and different >= ISOTONIC[2]:
        steps = IsotonicRegression(featuresCol="p", labelCol="y", predictionCol="_q").fit(fit_on).transform(raw)
        out.append(steps.withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "_q"))).select(*raw.columns, F.lit("isotonic").alias("method")))
    return out


def size_families(n: int) -> dict[str, dict]:
    """The three linear families of size models; penalties are of the sum over n rows, as a mean."""
    return {
        "ridge": {"regParam": 4.0 / n},
        "elastic_net": {"regParam": 0.0005, "elasticNetParam": 0.25},
        "huber": {"loss": "huber", "epsilon": 1.35, "regParam": 2e-4 / n, "maxIter": 500},
    }


def _size_side(prepared: DataFrame, side: int, key: str, base: DataFrame) -> list[DataFrame]:
    """Predicted sizes of one side by each family, plain and winsorised: or the median of base alone where rows are too few."""
    own = prepared.where(F.col("direction") == side).withColumn("size", F.abs("excess"))
    n, middle, low, high = own.where("split = 'base'").agg(F.count("size"), F.percentile("size", F.lit(0.5)), *[F.percentile("size", F.lit(s)) for s in WINSOR]).first()
    held = own.where("split = 'validation' and excess is not null").count()
    asked = prepared.where("split = 'validation' or split = 'test'")
    kept = [F.col(key), "split", "direction", "excess", F.lit(side).alias("side"), F.lit(middle or 0.0).alias("fallback")]
    if n < SIZE_ROWS[0] or held < SIZE_ROWS[1]:
        return [asked.select(*kept, F.lit("constant").alias("model"), F.lit(middle or 0.0).alias("predicted"))]
    out = []
    for cut in (False, True):
        rows = own.where("split = 'base' and size is not null").withColumn("size", F.least(F.greatest("size", F.lit(low)), F.lit(high)) if cut else F.col("size"))
        for name, params in size_families(n).items():
            model = fitted(LinearRegression(featuresCol="features", labelCol="size", predictionCol="_size", standardization=False, **params), rows)
            out.append(model.transform(asked).select(*kept, F.lit(f"{name}{'_winsorised' * cut}").alias("model"), F.greatest(F.lit(0.0), "_size").alias("predicted")))
    return out


def train_nested(
    rows: DataFrame,
    features: list[str],
    key: str = "event_id",
    windows: Iterable[int | None] = (None, 5),
    folds: int = 3,
    candidates: tuple[str, ...] | None = None,
    sizes: bool = True,
    trees: int = 10,
    threads: int = 8,
) -> Trained:
    """Fit every candidate (or those named), weighted and not, and both size models for each fold and window.

    ``scores``: fold, window_years, candidate, key, split (calibration, validation, test), y, excess, method, p.
    ``sizes``: fold, window_years, key, split, direction, excess, side, model, predicted, fallback.
    """
    spark = rows.sparkSession
    splits, groups = nested_splits(rows, features, windows, folds)
    groups = written(groups, "groups")
    usable = [(r["fold"], r["window_years"]) for r in groups.where("status = 'ok'").orderBy(*GROUP).collect()]
    at = {"scores": scratch_path(spark, "scores"), "sizes": scratch_path(spark, "sizes")}
    models: dict[tuple, tuple] = {}

    def prepare(group: tuple) -> tuple:
        own = splits.where((F.col("fold") == group[0]) & (F.col("window_years") == group[1])).select(key, "split", "direction", "excess", *features)
        own = own.withColumn("y", F.when(F.col("direction") != 0, (F.col("direction") == 1).cast("int")))
        base = own.where("split = 'base'")
        made = Pipeline(stages=preprocessing(features)).fit(base)
        zeros, ones = base.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
        return made, made.transform(own).persist(), min(10.0, max(1.0, zeros / ones))

    ready = dict(zip(usable, side_by_side(prepare, usable, threads), strict=True))
    named = {"logistic", *[f"boosted_{i + 1}" for i in range(len(BOOSTED))]} if candidates is None else set(candidates)
    tasks: list[tuple] = [(g, c, weighted) for g in usable for c in sorted(named) for weighted in (False, True)]
    tasks += [(g, side, None) for g in usable for side in (1, -1)] if sizes else []

    def named_by(df: DataFrame, group: tuple) -> DataFrame:
        return df.select(F.lit(group[0]).alias("fold"), F.lit(group[1]).alias("window_years"), "*")

    def fit(task: tuple) -> None:
        group, what, weighted = task
        made, prepared, scale = ready[group]
        if weighted is None:
            for out in _size_side(prepared, what, key, prepared):
                _part(named_by(out, group), at["sizes"])
            return
        base = prepared.where("split = 'base'").withColumn("weight", F.when(F.col("y") == 1, scale).otherwise(1.0) if weighted else F.lit(1.0))
        model = fitted(direction_candidates(trees=trees)[what], base)
        name = f"{what}{'_weighted' * weighted}"
        models[(*group, name)] = made, model
        raw = model.transform(prepared.where("split != 'base'")).select(key, "split", "y", "excess", vector_to_array("probability")[1].alias("p")).persist()
        for out in _methods(raw):
            _part(named_by(out.withColumn("candidate", F.lit(name)), group), at["scores"])
        raw.unpersist()

    side_by_side(fit, tasks, threads)
    for _, prepared, _ in ready.values():
        prepared.unpersist()
    kinds = {c: splits.schema[c].dataType.simpleString() for c in (key, "fold", "window_years", "direction", "excess")}
    of = lambda *names: ", ".join(f"{n} {kinds.get(n, t)}" for n, t in (x.split() if " " in x else (x, "double") for x in names))
    schema = {
        "scores": of("fold", "window_years", key, "split string", "y int", "excess", "p", "candidate string", "method string"),
        "sizes": of("fold", "window_years", key, "split string", "direction", "excess", "side int", "fallback", "model string", "predicted"),
    }
    found = {n: _parts(spark, at[n], s) if usable and (named if n == "scores" else sizes) else spark.createDataFrame([], s) for n, s in schema.items()}
    return Trained(splits, groups, found["scores"], found["sizes"], models)


def _judged(scores: DataFrame, by: list[str]) -> DataFrame:
    """Safe threshold and figures of each group of scores on its validation rows."""
    held = scores.where("split = 'validation' and y is not null")
    safe = sl.safe_threshold(ev.threshold_sweep(held, "y", "p", by), by)
    p = F.least(F.lit(1 - 1e-8), F.greatest(F.lit(1e-8), "p"))
    return safe.join(held.groupBy(*by).agg(F.avg((p - F.col("y")) ** 2).alias("brier")), by).withColumn("eligible", F.col("status") == "selected_safe_threshold")


def choose_calibrations(scores: DataFrame) -> DataFrame:
    """Place of each calibration of a candidate: safe threshold first, then balanced accuracy less half the Brier score and a quarter of the rate gap."""
    by = [*GROUP, "candidate"]
    judged = _judged(scores, [*by, "method"]).withColumn("choice_score", F.col("balanced") - BRIER_WEIGHT * F.col("brier") - GAP_WEIGHT * F.col("gap"))
    liked = F.create_map(*[F.lit(x) for kv in PREFERENCE.items() for x in kv])[F.col("method")]
    w = W.partitionBy(*by).orderBy(~F.col("eligible"), F.negative(F.round("choice_score", 6)), liked)  # three rows
    return judged.withColumn("place", F.row_number().over(w))


def _depth(candidate: Column) -> Column:
    base = F.regexp_replace(candidate, "_weighted$", "")
    deep = F.create_map(*[F.lit(x) for i, b in enumerate(BOOSTED) for x in (f"boosted_{i + 1}", b[0])])
    return F.coalesce(F.try_element_at(deep, base), F.lit(3))


def choose_candidates(scores: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Place of each candidate of a fold and window with its chosen calibration: eligible first, then the candidate score.

    Without any eligible one, the best of all is taken and the status tells so.
    """
    by = [*GROUP, "candidate"]
    first = calibrations.where("place = 1").drop("place")
    held = scores.where("split = 'validation' and y is not null").join(F.broadcast(first.select(*by, "method")), [*by, "method"])  # a row for each candidate
    judged = first.join(ev.roc_auc(held, "y", "p", by), by, "left").join(ev.average_precision(held, "y", "p", by), by, "left")
    score = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in CANDIDATE_WEIGHTS.items()), F.lit(0.0))
    score = score - F.when(F.col("eligible"), 0.0).otherwise(UNSAFE_COST) - DEPTH_COST * _depth(F.col("candidate"))
    judged = judged.withColumn("candidate_score", score)
    last = [F.desc_nulls_last(F.round(c, 9)) for c in ("average_precision", "balanced")]
    w = W.partitionBy(*GROUP).orderBy(F.desc("eligible"), F.desc(F.round("candidate_score", 9)), *last, F.round("brier", 9), "candidate")  # a row for each candidate
    found = F.when(F.col("eligible"), "selected_eligible_candidate").otherwise("diagnostic_fallback_no_eligible_candidate")
    return judged.withColumn("place", F.row_number().over(w)).withColumn("choice", F.when(F.col("place") == 1, found))


def choose_sizes(sizes: DataFrame) -> DataFrame:
    """Place of each size model of a side by mean error, root mean square error and rank correlation on that side's validation rows.

    A missing correlation counts as -0.25; a constant stands alone and has no figures. Ties go to the smaller mean error, then the name.
    """
    by = [*GROUP, "side", "model"]
    held = sizes.where("split = 'validation' and direction = side and excess is not null").withColumn("size", F.abs("excess"))
    figures = ev.regression_metrics(held, "size", "predicted", by)
    every = sizes.select(*by).distinct().join(figures, by, "left")
    parts = {"mae": F.col("mae"), "rmse": F.col("rmse"), "spearman": F.coalesce("spearman", F.lit(-0.25))}
    every = every.withColumn("size_score", sum((parts[c] * w for c, w in SIZE_SCORE.items()), F.lit(0.0)))
    w = W.partitionBy(*GROUP, "side").orderBy(F.asc_nulls_last(F.round("size_score", 9)), F.asc_nulls_last(F.round("mae", 9)), "model")  # seven rows at most
    fallback = (F.col("model") == "constant").alias("fallback_used")
    return every.withColumn("place", F.row_number().over(w)).select(*by, "mae", "rmse", "spearman", "size_score", "place", fallback)


def out_of_fold(trained: Trained, chosen: DataFrame, sizes: DataFrame, key: str = "event_id") -> DataFrame:
    """One row for each validation and test row of a fold and window: what the chosen models say.

    fold, window_years, key, split, y (null if neutral), excess, candidate, method, choice, t (threshold in hundredths), p, positive, negative
    (sizes of the two sides), expected (p x positive - (1 - p) x negative), large (bar of a large outcome, from base rows).
    """
    first = F.broadcast(chosen.where("place = 1").select(*GROUP, "candidate", "method", "t", "choice"))  # a row for each fold and window
    out = trained.scores.where("split != 'calibration'").join(first, [*GROUP, "candidate", "method"])
    pick = F.broadcast(sizes.where("place = 1").select(*GROUP, "side", "model"))
    amount = trained.sizes.join(pick, [*GROUP, "side", "model"]).groupBy(*GROUP, key, "split").agg(
        F.max(F.when(F.col("side") == 1, F.col("predicted"))).alias("positive"), F.max(F.when(F.col("side") == -1, F.col("predicted"))).alias("negative")
    )
    size = F.percentile(F.abs("excess"), F.lit(LARGE))
    large = trained.splits.where("split = 'base'").groupBy(*GROUP).agg(F.greatest(size, F.lit(NEUTRAL)).alias("large"))
    out = out.join(amount, [*GROUP, key, "split"], "left").join(F.broadcast(large), GROUP, "left")
    return out.withColumn("expected", F.coalesce(ev.expected_excess(F.col("p"), F.col("positive"), F.negative("negative")), F.lit(0.0)))


def fold_figures(predictions: DataFrame, split: str) -> DataFrame:
    """Figures of the predictions of each fold and window on one split, at the chosen threshold, as :func:`selection.window_summary` reads them."""
    held = predictions.where((F.col("split") == split) & F.col("y").isNotNull())
    said, y = F.col("p") >= F.col("t") / 100, F.col("y")
    share = lambda a, b: F.coalesce(F.count_if(a) / F.nullif(F.count_if(b), F.lit(0)), F.lit(0.0))
    rates = held.groupBy(*GROUP).agg(
        F.count("*").alias("rows"), F.avg((F.col("p") - y) ** 2).alias("brier"), F.avg(said.cast("int")).alias("predicted_rate"), F.avg("y").alias("actual_rate"),
        ((share(said & (y == 1), y == 1) + share(~said & (y == 0), y == 0)) / 2).alias("balanced"), (F.abs(F.avg("p") - F.avg("y")) > 0.15).alias("warning"), F.bool_or(F.col("choice").startswith("diagnostic")).alias("failed"),
    )
    ranks = ev.regression_metrics(predictions.where((F.col("split") == split) & F.col("excess").isNotNull()), "excess", "expected", GROUP).select(*GROUP, "spearman", F.col("hit_rate").alias("hits"))
    out = rates.join(ev.roc_auc(held, "y", "p", GROUP), GROUP, "left").join(ev.average_precision(held, "y", "p", GROUP), GROUP, "left").join(ranks, GROUP, "left")
    return out


def baselines(rows: DataFrame, layers: dict[str, list[str]], only: dict[str, list[str]], key: str = "event_id", folds: int = 3, threads: int = 8) -> DataFrame:
    """Scores of test rows of each outer fold by plain models: fold, baseline, key, y, p.

    The majority direction, the share of gains, a balanced logistic model on all features, on some layers alone (``only``) and
    on all less one layer (``full_minus_<layer>``). Neutral rows take no part; a fold whose training rows have one
    direction has no baselines.
    """
    spark, every = rows.sparkSession, [c for cs in layers.values() for c in cs]
    dealt = written(ev.walk_forward(rows, "report_dt", "label_end", folds).where("direction != 0").withColumn("y", (F.col("direction") == 1).cast("int")), "baselines", ["fold"])
    usable = {r["fold"]: (r["ones"], r["n"]) for r in dealt.where("role = 'train'").groupBy("fold").agg(F.sum("y").alias("ones"), F.count("*").alias("n")).collect() if 0 < r["ones"] < r["n"]}
    sets = {"logistic_full": every} | {n: [c for layer in ls for c in layers[layer]] for n, ls in only.items()}
    sets |= {f"full_minus_{n}": [c for c in every if c not in cs] for n, cs in layers.items() if len(cs) < len(every)}
    path = scratch_path(spark, "baseline-scores")

    def fit(task: tuple) -> None:
        fold, name = task
        ones, n = usable[fold]
        own = dealt.where(F.col("fold") == fold)
        train, test = own.where("role = 'train'"), own.where("role = 'test'")
        if name in sets:
            balanced = train.withColumn("weight", F.when(F.col("y") == 1, n / (2 * ones)).otherwise(n / (2 * (n - ones))))
            made = Pipeline(stages=preprocessing(sets[name])).fit(train)
            model = fitted(LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", regParam=1 / n, standardization=False), made.transform(balanced))
            p = model.transform(made.transform(test)).withColumn("p", vector_to_array("probability")[1])
        else:
            p = test.withColumn("p", F.lit(ones / n if name == "constant_probability" else float(2 * ones >= n)))
        _part(p.select(F.lit(fold).alias("fold"), F.lit(name).alias("baseline"), key, "y", "p"), path)

    side_by_side(fit, [(f, n) for f in sorted(usable) for n in ["majority_class", "constant_probability", *sets]], threads)
    schema = f"fold int, baseline string, {key} {rows.schema[key].dataType.simpleString()}, y int, p double"
    return _parts(spark, path, schema) if usable else spark.createDataFrame([], schema)


def permuted(rows: DataFrame, key: str, features: list[str], repeats: int) -> DataFrame:
    """Rows once for each feature and repeat (nth) with that feature's values dealt anew, as :func:`models.shuffled` deals them: feature, nth, y, features.

    The order by hash is the same for all features of a repeat, so a repeat takes one sort, and the order by key one for all.
    """
    placed = number_rows(rows, [F.col(key)], "_nth")
    dealt = [number_rows(rows.select(key, F.struct(*features).alias("_other")), [F.xxhash64(F.col(key), F.lit(i)), F.col(key)], "_nth").select("_nth", F.lit(i).alias("nth"), "_other") for i in range(repeats)]
    both = placed.join(reduce(DataFrame.unionAll, dealt), "_nth")
    each = [F.struct(F.lit(f).alias("feature"), *[F.col(f"_other.{c}" if c == f else c).alias(c) for c in features]) for f in features]
    return both.select("nth", "y", F.explode(F.array(*each)).alias("_row")).select("_row.feature", "nth", "y", *[f"_row.{c}" for c in features])


def permutation_importance(trained: Trained, chosen: DataFrame, features: list[str], key: str = "event_id", repeats: int = 3) -> DataFrame:
    """Fall of the area on validation rows when a feature's values are dealt anew, by the chosen raw model of each fold and window.

    fold, window_years, feature, importance (mean of the repeats), rank (1 is the largest).
    """
    parts = None
    for r in chosen.where("place = 1").select(*GROUP, "candidate").collect():  # a row for each fold and window
        made, model = trained.models[r["fold"], r["window_years"], r["candidate"]]
        held = trained.splits.where((F.col("fold") == r["fold"]) & (F.col("window_years") == r["window_years"]) & (F.col("split") == "validation"))
        held = held.select(key, (F.col("direction") == 1).cast("int").alias("y"), *features).persist()
        asked = permuted(held, key, features, repeats).unionByName(held.select(F.lit("").alias("feature"), F.lit(0).alias("nth"), "y", *features))
        p = model.transform(made.transform(asked)).select(F.lit(r["fold"]).alias("fold"), F.lit(r["window_years"]).alias("window_years"), "feature", "nth", "y", vector_to_array("probability")[1].alias("p"))
        parts = p if parts is None else parts.unionAll(p)
    areas = ev.roc_auc(written(parts, "permuted"), "y", "p", [*GROUP, "feature", "nth"])
    plain = areas.where("feature = ''").select(*GROUP, F.col("auc").alias("_plain"))
    falls = areas.where("feature != ''").join(F.broadcast(plain), GROUP).groupBy(*GROUP, "feature").agg(F.avg(F.col("_plain") - F.col("auc")).alias("importance"))
    return falls.withColumn("rank", F.row_number().over(W.partitionBy(*GROUP).orderBy(F.desc(F.round("importance", 9)), "feature")))  # a row for each feature
