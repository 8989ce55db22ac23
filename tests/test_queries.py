"""Every query of the library itself against its SQL, on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from fundtrace import plans
from tests.oracle import assert_same, duck

SF = "/root/testdata/sf0.001"
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert_same(got, duck(SQL[name], SF))
    else:
        assert len(got)


@pytest.mark.parametrize("name", ["j17_actions_predictions", "l12_prediction_class", "l13_actual_class", "m20_drift_reference", "w20_weighted_signal"])
def test_views_that_a_query_reads_several_times_are_written_once(spark, name):
    read = [f.rsplit("/", 1)[-1] for f in QUERIES[name](spark, SF).inputFiles()]
    assert "lineitem.parquet" not in read or name == "j17_actions_predictions"  # which reads its holdings once
    assert "supplier.parquet" not in read and "orders.parquet" not in read


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("name", ["p07_holding_filter", "a20_collapsed_identities"])
def test_holdings_are_dealt_by_size(spark, monkeypatch, name, broadcast):
    from fundtrace.plans import fixtures

    monkeypatch.setattr(fixtures, "TASK_LINES", 500, raising=False)
    monkeypatch.setattr(fixtures, "BROADCAST_PARTS", 1_500_000 if broadcast else 0, raising=False)
    got = QUERIES[name](spark, SF)
    assert_same(got.toPandas(), duck(SQL[name], SF))
    assert got.rdd.getNumPartitions() == 12  # 6,000 lines, whatever spark.sql.shuffle.partitions is


def test_models_are_asked_once(spark, monkeypatch):
    from fundtrace.operators import models as md

    monkeypatch.setattr(md, "BOOSTED", md.BOOSTED[:1])
    got = QUERIES["m05_direction_models"](spark, SF)
    assert {f.split("/")[-2].split("-")[0] for f in got.inputFiles()} == {"scores"} and got.count() == 6


def test_kept_views_are_read_through_other_views(spark):
    from fundtrace.plans.fixtures import ACTIONS
    from fundtrace.plans.registry import Views
    from fundtrace.plans.training import training_rows

    plain, v = Views(spark, SF), Views(spark, SF).keep(*ACTIONS)
    at = {n: df.inputFiles() for n, df in v.kept.items()}
    assert not any(f.startswith("file:/root/testdata") for f in v.fx_fold_scores.inputFiles())
    assert sorted(map(repr, v.fx_actions.collect())) == sorted(map(repr, plain.fx_actions.collect()))
    v.keep(*ACTIONS)
    assert {n: df.inputFiles() for n, df in v.kept.items()} == at
    assert not any(f.startswith("file:/root/testdata") for f in training_rows(v).inputFiles()) and training_rows(v) is training_rows(v)


def test_entry_has_all():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("hidden", [["fundtrace/llm", "tests/llm"], ["fundtrace/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_the_training_data_operators(tmp_path, hidden):
    root = Path(__file__).resolve().parent.parent
    for name in ("fundtrace", "tests", "__spark_entry__.py", "corpus_pipeline.py"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    for name in hidden:
        at = tmp_path / name
        shutil.rmtree(at) if at.is_dir() else at.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    path = os.pathsep.join([str(tmp_path), *(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != root)])
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": path}, capture_output=True, text=True, check=True)
    n, sql, llm = map(int, out.stdout.split())
    assert n - llm == len(QUERIES) and sql >= len(SQL) and (llm == 0) == ("fundtrace/llm" in hidden)
