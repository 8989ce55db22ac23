"""A corpus filter in five stages over the documents table, each on all that the one before it kept.

What holds for every stage: a null text counts as empty and stays null; rows that repeat an id are told apart by their
texts, null ids included; rows alike in id and text fare alike; texts are taken whole; an empty table gives an empty one; other
columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm import bpe, decontaminate, minhash, pii, toxicity
from fundtrace.llm.common import documents, materialise, release, scratch_released

#: No SQL expresses the learned and iterative stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the nearest labelled examples call toxic. Labels: those of the teaching rows.

    Each row is judged by its own text; an empty one, or any without labels to learn from, gets the base rate and stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, labels, "toxic", toxicity.TRAIN, toxicity.REJECT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group, by five-word shingles at 0.8.

    Rows of one id are one document and stay or go together. Rows without an id stand behind all ids, one document for each
    text. Texts without words have no copies and stay.
    """
    copies = minhash.near_duplicates(docs).where("NOT kept").select(F.col("node").alias("node of copy")).distinct()
    return docs.join(copies, minhash.node(docs["doc_id"], docs["text"]) == F.col("node of copy"), "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that share a window of words with the benchmark. An empty benchmark drops none."""
    hits = decontaminate.benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = hits.where("n_hit > 0").select(F.col("doc_id").alias("id of leak"), F.col("text_hash").alias("text of leak"))
    same = docs["doc_id"].eqNullSafe(F.col("id of leak")) & (F.xxhash64(docs["text"]) == F.col("text of leak"))
    return docs.join(leaks, same, "left_anti").select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind, in each row what its own text has."""
    masked = pii.mask(docs, pii.personal_data(docs))
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (packed as unsigned 32-bit integers) and whether decoding gives its text back.

    Null text has no tokens. Repeated rows stay.
    """
    out = bpe.encode_decode(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), public_tokenizers.path("byte_bpe_50k.json"), keep_text=True)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table; each is written and read again before the next, and what it needed is freed."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with scratch_released() as scratch:
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
            scratch.remove(docs)
        release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
