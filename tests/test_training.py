"""Nested training: splits and choices against plain versions, and that tests take no part in a choice."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fundtrace.operators import training as tr

ROWS = "event_id string, report_dt date, label_end date, direction int, excess double, a double, b double"


def month(i):
    return dt.date(1990 + i // 12, i % 12 + 1, 1)


def made(n_dates=40, per_date=6, seed=1):
    rng = random.Random(seed)
    out = []
    for d in range(n_dates):
        for k in range(per_date):
            a = rng.gauss(0, 1)
            excess = 0.02 * a + rng.gauss(0, 0.02)
            direction = 0 if abs(excess) < 0.005 else 1 if excess > 0 else -1
            out.append((f"{d}_{k}", month(3 * d), month(3 * d + 3), direction, excess, a, None if k == 0 else rng.gauss(0, 1)))
    return out


def plain_splits(rows, folds, years):
    """Fold, window and split of each row, by loops over dates."""
    dates = sorted({r[1] for r in rows})
    first = int(len(dates) * 0.6)
    blocks = [[d for i, d in enumerate(dates) if i >= first and (i - first) * folds // (len(dates) - first) == f] for f in range(folds)]
    back = lambda d, m: month((d.year - 1990) * 12 + d.month - 1 - m)
    out = {}
    for f, block in enumerate(blocks, 1):
        for y in years:
            train = [r for r in rows if r[2] < back(block[0], 1) and (not y or r[1] >= back(block[0], 12 * y))]
            own = sorted({r[1] for r in train})
            calibration, validation = own[max(2, int(len(own) * 0.45))], own[max(3, int(len(own) * 0.8))]
            for r in rows:
                if block[0] <= r[1] <= block[-1]:
                    out[f, y or 0, r[0]] = "test"
            for r in train:
                if r[3] == 0:
                    continue
                if r[1] >= validation:
                    out[f, y or 0, r[0]] = "validation"
                elif r[1] >= calibration and r[2] < validation:
                    out[f, y or 0, r[0]] = "calibration"
                elif r[1] < calibration and r[2] < calibration:
                    out[f, y or 0, r[0]] = "base"
    return out


def test_nested_splits_against_loops(spark):
    rows = made(52, 3)
    splits, groups = tr.nested_splits(spark.createDataFrame(rows, ROWS), ["a", "b"], (None, 5), 2)
    got = {(r.fold, r.window_years, r.event_id): r.split for r in splits.collect()}
    assert got == plain_splits(rows, 2, (None, 5))
    assert {r.status for r in groups.collect()} == {"ok"}


def test_nested_splits_say_why_a_group_is_left_out(spark):
    few = spark.createDataFrame(made(16, 3), ROWS)
    assert {r.status for r in tr.nested_splits(few, ["a"], (None,), 1)[1].collect()} == {"too_few_dates"}
    rows = spark.createDataFrame(made(40, 3), ROWS)
    one = rows.withColumn("direction", F.lit(1))
    assert {r.status for r in tr.nested_splits(one, ["a"], (None,), 1)[1].collect()} == {"one_direction_only"}
    blank = rows.withColumn("b", F.lit(None).cast("double"))
    assert {r.status for r in tr.nested_splits(blank, ["a", "b"], (None,), 1)[1].collect()} == {"feature_without_values"}
    run = tr.train_nested(few, ["a"], windows=(None,), folds=1, candidates=("logistic",))
    assert run.scores.count() == 0 and run.sizes.count() == 0
    assert tr.out_of_fold(run, tr.choose_candidates(run.scores, tr.choose_calibrations(run.scores)), tr.choose_sizes(run.sizes)).count() == 0


def plain_threshold(pairs):
    """The safe threshold by its rules: (eligible, balanced, gap, threshold)."""
    ones = sum(y for y, _ in pairs)
    zeros, n, rows = len(pairs) - ones, len(pairs), []
    for t in range(5, 96):
        tp = sum(y for y, p in pairs if p >= t / 100 - 1e-12)
        fp = sum(1 - y for y, p in pairs if p >= t / 100 - 1e-12)
        balanced = (tp / ones + 1 - fp / zeros) / 2
        gap = abs((tp + fp) / n - ones / n)
        safe = 20 <= t <= 80 and 0.02 <= (tp + fp) / n <= 0.98 and gap <= 0.2
        rows.append((safe, balanced, gap, t, fp / zeros))
    safe = [r for r in rows if r[0]]
    if not safe:
        return next((r[:4] for r in rows if r[3] == 50))
    return min(safe, key=lambda r: (-round(r[1] - 0.25 * r[2], 9), -round(r[1], 9), round(r[2], 9), abs(r[3] - 50), round(r[4], 9)))[:4]


def test_choices_against_plain_rules(spark):
    rng = random.Random(5)
    rows = []
    for window in (0, 5):
        for candidate, skill in (("logistic", 0.3), ("boosted_1", 0.5), ("boosted_5_weighted", 0.5), ("logistic_weighted", 0.0)):
            ys = [(f"e{i}", int(rng.random() < 0.5)) for i in range(40)]
            for method, shrink in (("none", 1.0), ("sigmoid", 0.7), ("isotonic", 0.7)):
                r = random.Random(method == "none")
                rows += [(1, window, i, "validation", y, 0.0, round(0.5 + shrink * (skill * (y - 0.5) + r.uniform(-0.2, 0.2)), 6), candidate, method) for i, y in ys]
                rows += [(1, window, f"t{i}", "test", 1 - y, 0.0, 0.9 if y else 0.1, candidate, method) for i, y in ys]  # must not matter
    scores = spark.createDataFrame(rows, "fold int, window_years int, event_id string, split string, y int, excess double, p double, candidate string, method string")
    calibrations = tr.choose_calibrations(scores)
    chosen = tr.choose_candidates(scores, calibrations)
    got = {(r.window_years, r.candidate): (r.method, r.t, r.place) for r in chosen.collect()}

    def auc(pairs):
        up, down = [p for y, p in pairs if y], [p for y, p in pairs if not y]
        return sum((a > b) + 0.5 * (a == b) for a in up for b in down) / (len(up) * len(down))

    def precision(pairs):
        ones, total = sum(y for y, _ in pairs), 0.0
        for cut in {p for _, p in pairs}:
            above = [y for y, p in pairs if p >= cut]
            total += sum(above) / len(above) * sum(y for y, p in pairs if p == cut) / ones
        return total

    for window in (0, 5):
        best = []
        for candidate in ("logistic", "boosted_1", "boosted_5_weighted", "logistic_weighted"):
            methods = []
            for method in ("none", "sigmoid", "isotonic"):
                pairs = [(r[4], r[6]) for r in rows if r[1] == window and r[3] == "validation" and r[7] == candidate and r[8] == method]
                safe, balanced, gap, t = plain_threshold(pairs)
                brier = sum((p - y) ** 2 for y, p in pairs) / len(pairs)
                methods.append((not safe, -round(balanced - 0.5 * brier - 0.25 * gap, 6), {"sigmoid": 0, "none": 1, "isotonic": 2}[method], method, t, pairs, balanced, gap, brier))
            unsafe, _, _, method, t, pairs, balanced, gap, brier = min(methods, key=lambda m: m[:3])
            assert got[window, candidate][:2] == (method, t)
            depth = {"boosted_1": 2, "boosted_5_weighted": 3}.get(candidate, 3)
            score = auc(pairs) + 0.5 * precision(pairs) + 0.3 * balanced - 0.5 * brier - 0.25 * gap - unsafe - 0.005 * depth
            best.append((unsafe, -round(score, 9), candidate))
        assert [c for _, _, c in sorted(best)] == [c for c, _ in sorted(((c, v[2]) for (w, c), v in got.items() if w == window), key=lambda x: x[1])]


def test_size_models_fall_back_to_a_constant(spark):
    rng = random.Random(3)
    rows = []
    for split, n in (("base", 80), ("validation", 30), ("test", 5)):
        for i in range(n):
            a = rng.gauss(0, 1)
            side = -1 if i % 10 == 0 else 1  # too few losses
            rows.append((f"{split}{i}", split, side, side * (0.05 + 0.02 * a * side + 0.001 * rng.random()), a))
    from pyspark.ml.feature import VectorAssembler

    given = VectorAssembler(inputCols=["a"], outputCol="features").transform(spark.createDataFrame(rows, "event_id string, split string, direction int, excess double, a double"))
    named = [df.select(F.lit(1).alias("fold"), F.lit(0).alias("window_years"), "*") for side in (1, -1) for df in tr._size_side(given, side, "event_id", given)]
    sizes = named[0]
    for df in named[1:]:
        sizes = sizes.union(df)
    picked = {r.side: r for r in tr.choose_sizes(sizes).where("place = 1").collect()}
    assert picked[-1].model == "constant" and picked[-1].fallback_used and picked[-1].mae is not None
    assert picked[1].model != "constant" and picked[1].mae < 0.005
    losses = sorted(abs(r[3]) for r in rows if r[1] == "base" and r[2] == -1)
    said = {r.predicted for r in sizes.where("side = -1").collect()}
    assert len(said) == 1 and said.pop() == pytest.approx((losses[3] + losses[4]) / 2) and sizes.where("side = 1").select("model").distinct().count() == 6


def test_training_end_to_end(spark):
    rows = spark.createDataFrame(made(44, 12), ROWS)
    run = tr.train_nested(rows, ["a", "b"], windows=(None, 5), folds=1, candidates=("logistic",))
    chosen = tr.choose_candidates(run.scores, tr.choose_calibrations(run.scores))
    made_ = tr.written(tr.out_of_fold(run, chosen, tr.choose_sizes(run.sizes)), "predictions")
    both = {(r.window_years, r.split): r for r in tr.fold_figures(made_, "test").withColumn("split", F.lit("test")).collect()}
    assert set(both) == {(0, "test"), (5, "test")} and all(r.auc > 0.7 and r.spearman > 0.4 for r in both.values())
    tests = made_.where("split = 'test'").collect()
    assert len(tests) == 2 * len({t.event_id for t in tests}) and all(t.p is not None and t.positive >= 0 and t.negative >= 0 and t.large >= tr.NEUTRAL for t in tests)
    assert all(abs(t.expected - (t.p * t.positive - (1 - t.p) * t.negative)) < 1e-9 for t in tests)
    assert run.scores.where("method = 'isotonic'").count() == 0  # too few rows for it


def test_models_work_in_a_session_that_has_observed_something(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import Observation

    from fundtrace.operators import models as md

    seen = Observation()
    spark.range(5).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 5}
    rows = VectorAssembler(inputCols=["a"], outputCol="features").transform(spark.createDataFrame([(i % 2, 1.0, float(i % 7)) for i in range(60)], "y int, weight double, a double"))
    for name in ("logistic", "forest", "boosted_1"):
        out = md.fitted(md.direction_candidates(trees=2)[name], rows).transform(rows).select("y", tr.vector_to_array("probability")[1].alias("p"))
        assert out.where("p between 0 and 1").count() == 60 and len(out.collect()) == 60
    scores = rows.select(F.monotonically_increasing_id().alias("event_id"), F.lit("calibration").alias("split"), "y", (F.col("a") / 7).alias("p"))
    assert len(md.calibrate(scores).collect()) == 180 and len(tr._methods(scores)[1].collect()) == 60
    dates = spark.createDataFrame(made(44, 6), ROWS)
    said = tr.baselines(dates, {"one": ["a"], "two": ["b"]}, {"one_only": ["one"]}, folds=1)
    assert {r.baseline for r in said.select("baseline").distinct().collect()} == {"majority_class", "constant_probability", "logistic_full", "one_only", "full_minus_one", "full_minus_two"}


def test_permuted_rows_are_those_of_one_shuffle_for_each_feature(spark, monkeypatch):
    from fundtrace.operators import models as md

    rng, sorts, number = random.Random(9), [], tr.number_rows
    rows = spark.createDataFrame([(f"e{i}", i % 2, rng.random(), None if i % 5 == 0 else rng.random()) for i in range(70)], "event_id string, y int, a double, b double")
    monkeypatch.setattr(tr, "number_rows", lambda *args: sorts.append(args) or number(*args))
    got = sorted(map(repr, tr.permuted(rows, "event_id", ["a", "b"], 3).collect()))
    want = [r for f in ("a", "b") for i in range(3) for r in md.shuffled(rows, "event_id", f, i).select(F.lit(f).alias("feature"), F.lit(i).alias("nth"), "y", "a", "b").collect()]
    assert got == sorted(map(repr, want)) and len(got) == 420 and len(sorts) == 4
