"""Operator 1: benchmark decontamination by winnowing, in DataFrame functions only.

Both sides keep, in each sliding window of ``WINDOW - GRAM + 1`` hashes of ``GRAM``-word grams, the smallest one (all of
them on a tie). Texts that share ``WINDOW`` words in a row therefore share a kept gram at the same place in them. Kept
grams are joined; each hit is checked word by word and extended to both sides, as far as a window around the gram
reaches. The union of the extended spans of at least ``WINDOW`` words is what the benchmark covers.

Benchmark items with fewer words are a window as a whole; they are joined by all grams of their own length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm.common import documents, row_key

#: What separates words once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW, GRAM = 10, 5
SIDE = WINDOW - GRAM
#: Benchmarks with at most this many kept grams (some 150 bytes each) are broadcast; larger ones are shuffled.
BROADCAST_GRAMS = 100_000


def words_of(text: str | Column) -> Column:
    """Words of a text; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def _hashes(df: DataFrame) -> DataFrame:
    """Add hashes of the words, of the grams, and the smallest gram of each window."""
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    gram = F.transform("h", lambda x, i: F.xxhash64(x, *[F.get("h", i + d) for d in range(1, GRAM)]))
    df = df.withColumn("k", F.when(F.size("h") >= WINDOW, F.slice(gram, 1, F.size("h") - (GRAM - 1))).otherwise(F.array().cast("array<bigint>")))
    return df.withColumn("low", F.transform("k", lambda x, i: F.least(x, *[F.get("k", i + d) for d in range(1, SIDE + 1)])))


def _entry(length: Column, h: Column, at: Column, size: int | Column, side: int) -> Column:
    size = F.lit(size)
    return F.struct(
        length.alias("length"),
        h.alias("h"),
        at.alias("at"),
        F.slice("words", at + 1, size).alias("gram"),
        F.reverse(F.slice("words", F.greatest(at - (side - 1), F.lit(1)), F.least(F.lit(side), at))).alias("before"),
        F.slice("words", at + size + 1, side).alias("after"),
    )


def _whole(n: int) -> Column:
    """All grams of n words."""
    each = F.transform("h", lambda x, i: _entry(F.lit(n), F.xxhash64(x, *[F.get("h", i + d) for d in range(1, n)]), i, n, 0))
    return F.filter(each, lambda e: F.size(e["gram"]) == n)


def fingerprints(df: DataFrame, short: list[int]) -> Column:
    """Array of kept grams: length (0: kept by winnowing), h, at, gram, before (nearest first) and after."""
    kept = F.filter(
        F.transform("k", lambda x, i: F.when(x == F.greatest(*[F.get("low", i - d) for d in range(SIDE + 1)]), i)),
        lambda i: i.isNotNull(),
    )
    found = [F.transform(kept, lambda i: _entry(F.lit(0), F.get("k", i), i, GRAM, SIDE))]
    found += [_whole(n) for n in short]
    return found[0] if len(found) == 1 else F.concat(*found)


def _run(a: Column, b: Column) -> Column:
    """How many first elements of two arrays are alike."""
    return reduce(lambda rest, d: F.when(F.get(a, F.lit(d)) == F.get(b, F.lit(d)), rest + 1).otherwise(0), reversed(range(SIDE)), F.lit(0))


def benchmark_hits(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """What each document shares with the benchmark.

    Returns ``id_col``, n_words, spans (sorted array of word ranges, end exclusive; they may overlap), n_hit (words in
    their union), items (sorted array of the item ids as text) and text_hash (xxhash64 of the text). A document with null
    or empty text has no words; an empty benchmark or item hits nothing. Rows alike in id and text are one document, null
    ids included; an id with several texts has a row for each. Repeated items count once.
    """
    items = _hashes(benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(item_text).alias("words")).where(F.size("words") > 0))
    short = sorted(r[0] for r in items.where(F.size("words") < WINDOW).select(F.size("words")).distinct().collect())
    entries = items.select("item", F.size("words").alias("n"), F.explode(fingerprints(items, short)).alias("e"))
    entries = entries.where("(e.length = 0 AND n >= 10) OR (e.length = n AND e.at = 0)".replace("10", str(WINDOW)))
    entries = entries.select("item", *[F.col(f"e.{c}").alias(f"item_{c}") for c in ("length", "h", "gram", "before", "after")]).distinct()
    few = entries.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
    whole = _hashes(df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("of_text"), words_of(text_col).alias("words")))
    row = row_key("id", F.col("of_text"), hashed=True)
    if few:
        entries, rows = F.broadcast(entries), whole
    else:  # shuffle bare hashes first, then the words of those documents alone that share one
        bare = whole.select("id", "of_text", F.explode(fingerprints(whole, short)).alias("e")).select("id", "of_text", "e.h", "e.length").distinct()
        known = entries.select(F.col("item_h").alias("h"), F.col("item_length").alias("length")).distinct()
        rows = whole.withColumn("row", row).join(bare.join(known, ["h", "length"], "left_semi").select(row.alias("row")).distinct(), "row", "left_semi").drop("row")
    each = rows.select("id", "of_text", F.size("words").alias("n_words"), F.posexplode_outer(fingerprints(rows, short)).alias("nth", "e"))
    each = each.select("id", "of_text", "n_words", "nth", "e.*")
    joined = each.join(entries, (F.col("h") == F.col("item_h")) & (F.col("length") == F.col("item_length")) & (F.col("gram") == F.col("item_gram")), "left")
    left, right = _run(F.col("before"), F.col("item_before")), _run(F.col("after"), F.col("item_after"))
    hit = F.col("item").isNotNull() & ((F.col("length") > 0) | (left + right + GRAM >= WINDOW))
    span = F.struct((F.col("at") - F.when(F.col("length") > 0, 0).otherwise(left)).alias("start"), (F.col("at") + F.size("gram") + F.when(F.col("length") > 0, 0).otherwise(right)).alias("end"))
    marked = joined.select("id", "of_text", "n_words", "nth", F.when(hit, F.col("item")).alias("item"), F.when(hit, span).alias("span"))
    marked = marked.where("item is not null or coalesce(nth, 0) = 0")
    out = marked.groupBy("id", "of_text", "n_words").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    if not few:
        every = whole.select("id", "of_text", F.size("words").alias("n_words")).distinct()
        out = every.withColumn("row", row).join(out.select(row.alias("row"), "spans", "items"), "row", "left").drop("row")
        none = {c: F.array().cast(out.schema[c].dataType) for c in ("spans", "items")}
        out = out.withColumns({c: F.coalesce(c, none[c]) for c in none})
    union = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))).alias("n"),
            F.greatest(acc["upto"], s["end"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )
    return out.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "spans", union.alias("n_hit"), "items", F.col("of_text").alias("text_hash"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark table."""
    found = benchmark_hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
occ AS (SELECT doc_id, item_id, i, n FROM (SELECT doc_id, i, s.n, array_to_string(w[i:i + s.n - 1], ' ') AS g
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM dw), (SELECT DISTINCT n FROM win) s WHERE i + s.n - 1 <= len(w)) d JOIN win USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM occ) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM occ) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
