"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundtrace.llm.common import materialise, release


def _towards_minimum(edges: DataFrame) -> DataFrame:
    """Columns hi, lo without loops or repeats."""
    return (
        edges.where("a != b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """The smallest id reachable from each id that has an edge.

    ``edges``: columns a, b (long), in any direction, repeats and loops allowed. Returns id, component. Each round
    links the larger neighbours of a node to its smallest one, then its smaller neighbours likewise, and is written
    to the scratch folder. A hub's edges are joined to one row of minima, so that Spark can split a large hub. An
    empty table gives an empty one.
    """
    now = materialise(_towards_minimum(edges), "edges")
    before = None
    while True:
        both = now.select("hi", "lo").union(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m"))
        large = (
            both.join(least, "hi")
            .where("lo > hi")
            .select(F.col("lo").alias("a"), F.least("m", "hi").alias("b"))
        )
        large = _towards_minimum(large)
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        linked = small.select(F.col("lo").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("hi").alias("a"), F.col("m").alias("b"))
        )
        last, now = now, materialise(_towards_minimum(linked), "edges")
        release(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("lo").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(roots)
