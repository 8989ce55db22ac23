"""Operator 7: exact top-k search by tiled integer matrix products.

Queries are packed into blocks and candidates into shards. Each block meets each shard as one tile: a matrix product,
of which every query keeps its k best. The short lists are merged in two levels, so no task gets more than a few
lists of one query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fundtrace.llm.common import materialise

SHARD_ROWS, BLOCK_ROWS = 8192, 1024
#: Lists of one query that a task of the first merge gets.
MERGE = 64


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each row of a tile, the positions of the k highest scores, ties to the smaller id, its own id left out."""
    for r in range(len(scores)):
        row = scores[r]
        open_ = np.flatnonzero(ids != own[r])
        if len(open_) > k:
            least = np.partition(row[open_], len(open_) - k)[len(open_) - k]
            open_ = open_[row[open_] >= least]
        yield r, open_[np.lexsort((ids[open_], -row[open_]))][:k]


def exact_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k candidates with the highest inner product for each query: query_id, rank (from 1), id, score.

    Both tables have ``id_col`` (long) and ``vector_col``; components become floor(scale * x). Vectors that are null
    or have null or non-finite components take no part; only vectors of one length meet. Rows with the query's id are
    no candidates of it. Repeated rows of the queries count once; repeated candidates each count. Empty tables give
    an empty result. A score beyond 64 bits is an error.
    """

    def clean(df: DataFrame) -> DataFrame:
        v = F.transform(vector_col, lambda x: x.cast("double"))
        ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        out = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(ok)
        return out.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"), F.size("v").alias("dim"))

    def packed(df: DataFrame, rows: int, name: str) -> tuple[DataFrame, int]:
        """Rows gathered into parts of about ``rows``: part, dim, ids and values as bytes. And the number of parts."""
        parts = max(1, math.ceil(df.count() / rows))

        def pack(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
            b = b.sort_values("id")
            m = np.stack([np.asarray(x, dtype=np.int64) for x in b["v"]]) if key[1] else np.zeros((len(b), 0), np.int64)
            return pd.DataFrame({"part": [key[0]], "dim": [key[1]], "ids": [b["id"].to_numpy(np.int64).tobytes()], "m": [m.tobytes()]})

        part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
        out = df.withColumn("part", part).groupBy("part", "dim").applyInPandas(pack, "part int, dim int, ids binary, m binary")
        return materialise(out, name), parts

    shards, n_shards = packed(clean(vectors), shard_rows, "shards")
    blocks, n_blocks = packed(clean(queries).distinct(), block_rows, "blocks")
    # each shard goes to the tiles of all blocks and each block to those of all shards: one shuffle of either, by tile
    shards = shards.withColumnsRenamed({"ids": "ids_s", "m": "m_s"}).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    blocks = blocks.withColumnsRenamed({"ids": "ids_q", "m": "m_q", "part": "block"}).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    tiles = shards.join(blocks, ["part", "block", "dim"])

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b.itertuples(index=False):
                ids, own = np.frombuffer(t.ids_s, np.int64), np.frombuffer(t.ids_q, np.int64)
                x, y = np.frombuffer(t.m_q, np.int64).reshape(len(own), t.dim), np.frombuffer(t.m_s, np.int64).reshape(len(ids), t.dim)
                most = t.dim * float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0))
                if most < 2**53:  # exact in doubles
                    scores = (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
                elif most < 2**63:
                    scores = x @ y.T
                else:
                    raise OverflowError("inner products exceed 64 bits")
                found = [(int(own[r]), t.part, ids[at], scores[r, at]) for r, at in _best(scores, ids, own, k)]
                if found:
                    n = [len(f[2]) for f in found]
                    yield pd.DataFrame({
                        "query_id": np.repeat([f[0] for f in found], n), "part": np.repeat([f[1] for f in found], n),
                        "id": np.concatenate([f[2] for f in found]), "score": np.concatenate([f[3] for f in found]),
                    })

    lists = tiles.select("block", "part", "dim", "ids_s", "m_s", "ids_q", "m_q").mapInPandas(product, "query_id long, part int, id long, score long")

    def merge(df: DataFrame, *by: str) -> DataFrame:
        w = W.partitionBy(*by).orderBy(F.desc("score"), "id")
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    first = merge(lists.withColumn("part", F.floor(F.col("part") / MERGE)), "query_id", "part").drop("rank")
    return merge(first, "query_id").select("query_id", "rank", "id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best of all vectors for each vector whose id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = exact_top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10
"""
