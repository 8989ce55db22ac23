"""Operator 11: centroid clustering (k-means in integers) by JVM-native expressions.

Centroids are literal arrays of the plan. ``zip_with`` and ``aggregate`` give the squared distance of a vector to each of
them, ``array_min`` over structs of distance and number picks the nearest one, and one sum for each component by cluster
gives the next centroids. A round is one scan with a partial aggregation: what is shuffled, and what the driver gets, is a
row of sums for each cluster (and task), whatever the number of vectors.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm.common import materialise, spread

CLUSTERS, ROUNDS, DIM, SCALE = 16, 3, 64, 64


def quantised(df: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """id, v (floor(scale * x) of each component) and square (its inner product with itself) of vectors with ``dim`` components, all finite."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.where(F.size(vector_col) == dim).select(F.col(id_col).alias("id"), v.alias("v")).where(ok)
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))
    return rows.withColumn("square", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x))


def _longs(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{x}L' for x in values)})")


def nearest(centroids: list[list[int]]) -> Column:
    """Struct of distance (squared) and cluster of the nearest of ``centroids``; ties go to the smaller number."""

    def squared(c: list[int]) -> Column:
        product = F.aggregate(F.zip_with("v", _longs(c), lambda x, y: x * y), F.lit(0).cast("long"), lambda a, x: a + x)
        return F.col("square") - 2 * product + F.lit(sum(x * x for x in c)).cast("long")

    return F.array_min(F.array(*[F.struct(squared(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]))


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """Vectors of the k rows with the smallest sha256 of ``seed:id``, in that order; equal hashes by their components."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    first = rows.select(F.sha2(text.cast("binary"), 256).alias("h"), "v").orderBy("h", "v").limit(k)
    return [list(r["v"]) for r in first.collect()]


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round: the floor of the mean of the vectors nearest to each; those without vectors stay."""
    assigned = rows.select("v", nearest(centroids)["cluster"].alias("cluster"))
    sums = [F.sum(F.get("v", F.lit(d))).alias(f"s{d}") for d in range(len(centroids[0]))]
    found = {r["cluster"]: [r[f"s{d}"] // r["n"] for d in range(len(sums))] for r in assigned.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect()}
    return [found.get(i, c) for i, c in enumerate(centroids)]


def cluster(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    dim: int = DIM,
    scale: int = SCALE,
    seed: int = 1,
) -> DataFrame:
    """Clusters of the vectors: ``id_col``, cluster, distance (squared), cluster_inertia, inertia, centroid (array of its components).

    Vectors that are null, have another length than ``dim`` or a null or non-finite component are left out. Each row is a
    vector of its own: repeated rows each count, and a null id counts as an empty text where the first centroids are
    drawn. With fewer than k vectors there are as many centroids; an empty table gives an empty result. Other columns
    play no part. A component or sum beyond 64 bits is an error.
    """
    rows = quantised(df, id_col, vector_col, dim, scale)
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        none = rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")])
        return none.withColumn("centroid", F.array().cast("array<bigint>"))
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    last = materialise(rows.select("id", nearest(centroids).alias("at")).select("id", "at.cluster", "at.distance"), "clusters")
    of = {r["cluster"]: r["s"] for r in last.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    inertia = F.array(*[F.lit(of.get(i, 0)).cast("long") for i in range(len(centroids))])
    at = F.array(*[_longs(c) for c in centroids])
    return last.select(
        F.col("id").alias(id_col), "cluster", "distance",
        F.get(inertia, F.col("cluster")).alias("cluster_inertia"), F.lit(sum(of.values())).cast("long").alias("inertia"),
        F.get(at, F.col("cluster")).alias("centroid"),
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of all vectors after three rounds."""
    found = cluster(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",").cast("binary"), 256)
    return found.withColumn("centroid_sha256", digest).drop("centroid")


def _rounds(n: int) -> str:
    """SQL of the assignment to the centroids c0 and of each round after it."""
    distance = "list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    text = []
    for i in range(n + 1):
        text.append(f"a{i} AS (SELECT row, arg_min(k, struct_pack(d := d, k := k)) AS k, min(d) AS d FROM (SELECT v.row, c.k, {distance} AS d FROM v CROSS JOIN c{i} c) GROUP BY row)")
        if i < n:
            text.append(f"""s{i} AS (SELECT k, j, sum(e[j])::BIGINT AS s, count(*) AS n FROM (SELECT a.k, v.e, unnest(generate_series(1, 64)) AS j FROM a{i} a JOIN v USING (row)) GROUP BY k, j),
c{i + 1} AS (SELECT c.k, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS e FROM s{i} GROUP BY k) m USING (k))""")
    return ",\n".join(text)


ORACLE_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, e) - 1 AS k, e FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, e FROM v ORDER BY h, e LIMIT 16)),
{_rounds(ROUNDS)}
SELECT vec_id, a.k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (row) JOIN c{ROUNDS} c ON c.k = a.k
"""
