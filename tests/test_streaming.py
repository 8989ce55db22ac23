"""Streaming forms over files that arrive."""

import datetime as dt

from fundtrace.streaming import monthly


def test_windows_and_upserts(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1 + i), i % 2, float(i)) for i in range(10)]
    data = spark.createDataFrame(rows, "ts timestamp, k int, v double")
    data.write.parquet(str(tmp_path / "in"))
    stream = monthly.stream_of_files(spark, str(tmp_path / "in"), data.schema)
    q = monthly.portfolio_windows(stream, "ts", "k", "v").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select sum(n), sum(total) from windows").first() == (10, 45.0)
    q = monthly.upsert_months(stream, str(tmp_path / "out"), ["k"], str(tmp_path / "check"))
    q.awaitTermination(60)
    assert {r["k"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {0: 5, 1: 5}


def test_labels_mature(spark):
    e = spark.createDataFrame([(dt.date(2000, 1, 31),), (dt.date(2000, 6, 30),)], "d date")
    got = [[r["label_available"] for r in monthly.mature_labels(e, "d", 3, until).orderBy("d").collect()] for until in ("2000-04-29", "2000-04-30", "2000-09-30")]
    assert got == [[False, False], [True, False], [True, True]]
