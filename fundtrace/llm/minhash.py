"""Operator 6: near-duplicate documents by MinHash banding with sequential Bayesian verification.

Documents with the same words in the same order are one class from the start. Signatures of the classes are banded;
classes that share a band are candidates. A candidate's signatures are compared batch after batch: once the posterior
probability of a similarity at or above the threshold, given the matches so far (uniform prior), falls below the
chosen miss probability, the pair is dropped. The rest are verified on their full shingle sets.

No bucket is expanded into all its pairs. Its members are compared with the most central one, its leader: the member
that meets most others over all bands. Documents that share a leader but are then still in different components are
compared in tiles of blocks, of which only links come out, so none between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm.common import documents, materialise, release
from fundtrace.llm.graph import connected_components

BANDS, ROWS = 32, 5
BATCH = 16
#: Highest posterior probability of a link at which a candidate is dropped.
MISS = 1e-9
WORD_HASHES = 100_000
#: Documents of a block in a tile.
BLOCK, BLOCK_BYTES = 128, 4 << 20
#: Parts of a large group in a join by leader.
SALTS = 16
#: Tiles that a Python worker gets at once.
TILES = 8
_word_hash: dict[bytes, int] = {}


def words_of(text: str | None) -> list[bytes]:
    """Lower-case A-Z only; words are runs of anything but space and \\t to \\r."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], size: int) -> set:
    """Distinct shingles; fewer words than ``size`` are one shingle, no words none."""
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(size)), strict=False))


def _hash_words(words: list[bytes]) -> np.ndarray:
    known = _word_hash
    if len(known) > WORD_HASHES:
        known.clear()
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = xxhash.xxh64_intdigest(w)
            if len(w) <= 48:
                known[w] = h
        out.append(h)
    return np.array(out, dtype=np.uint64)


def _shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A 64-bit hash for each distinct shingle."""
    if not words:
        return np.empty(0, np.uint64)
    h, n = _hash_words(words), max(1, len(words) - size + 1)
    mixed = np.full(n, 0x9E3779B97F4A7C15 * (min(size, len(words)) + 1) & (1 << 64) - 1, dtype=np.uint64)
    for i in range(min(size, len(words))):
        mixed = (mixed ^ h[i : i + n]) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


@lru_cache(1)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(6)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _signature(hashes: np.ndarray, n: int) -> np.ndarray:
    xors, factors = _permutations(n)
    h = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    least = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    step = max(1, (1 << 18) // n)
    for i in range(0, len(h), step):  # blocks that stay in the cache, however long the text
        block = (h[i : i + step, None] ^ xors) * factors
        np.minimum(least, block.min(axis=0), out=least)
    return least


def signatures(df: DataFrame, id_col: str, text_col: str, shingle: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, mark (hash of the text), class key, number of distinct shingles, packed signature and band hashes of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, mark, text in zip(b["id"], b["mark"], b["text"], strict=True):
                words = words_of(text)
                if not words:
                    out.append((i, mark, b"", 0, b"", []))
                    continue
                s = _signature(hashes := _shingle_hashes(words, shingle), bands * rows)
                keys = [xxhash.xxh64_intdigest(s[k * rows : (k + 1) * rows].tobytes(), seed=k) - (1 << 63) for k in range(bands)]
                out.append((i, mark, hashlib.md5(b" ".join(words)).digest(), len(hashes), s.tobytes(), keys))
            yield pd.DataFrame(out, columns=["id", "mark", "key", "n_shingles", "signature", "bands"])

    return _marked(df, id_col, text_col).mapInPandas(run, "id long, mark long, key binary, n_shingles long, signature binary, bands array<long>")


#: Rows without an id are nodes from here on, by the hash of their text; ids are below.
NO_ID = 1 << 62


def node(i: Column, text: Column) -> Column:
    """The number of a row among the links: its id, or one from ``NO_ID`` on made of its text."""
    return F.coalesce(i.cast("long"), F.xxhash64(text).bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID))


def _marked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(node(F.col(id_col), F.col(text_col)).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))


def fewest_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest of n matches at which P(similarity >= threshold | matches), by a uniform prior, is at least ``miss``."""
    for m in range(n + 1):
        tail = sum(comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))
        if tail >= miss:
            return m
    return n + 1


def bayes_prune(pairs: DataFrame, threshold: float, miss: float, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Candidates (a, b, signature_a, signature_b) that sequential comparison of their signatures leaves: a, b."""
    ends = [*range(BATCH, bands * rows + 1, BATCH)]
    least = np.array([fewest_matches(n, threshold, miss) for n in ends])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            alive = b
            done = np.zeros(len(b), dtype=np.int64)
            for end, fewest in zip(ends, least, strict=True):
                if not len(alive):
                    break
                at = slice((end - BATCH) * 4, end * 4)
                x, y = (np.frombuffer(b"".join(s[at] for s in alive[c]), np.uint32).reshape(-1, BATCH) for c in ("signature_a", "signature_b"))
                done = done + (x == y).sum(axis=1)
                keep = done >= fewest
                alive, done = alive[keep], done[keep]
            yield alive[["a", "b"]]

    return pairs.mapInPandas(run, pairs.select("a", "b").schema)


def verify(pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b, id_a, id_b, text_a, text_b) with 100 * intersection >= percent * union of their shingle sets: a, b (ids)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep, last, one = [], None, set()
            for a, ta, tb in zip(b["a"], b["text_a"], b["text_b"], strict=True):
                if a != last:
                    one, last = shingle_set(words_of(ta), shingle), a
                two = shingle_set(words_of(tb), shingle)
                both = len(one & two)
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            yield b.loc[np.array(keep, dtype=bool), ["id_a", "id_b"]].set_axis(["a", "b"], axis=1)

    return pairs.mapInPandas(run, "a long, b long")


def tiled_links(members: DataFrame, components: DataFrame, texts: DataFrame, shingle: int, percent: int, miss: float, bands: int, rows: int) -> DataFrame:
    """Links between components of documents that share a leader: a, b; one for each document and component at least.

    Documents with one leader that aren't in the leader's component are dealt into blocks, and so are those that are. Each
    block of the former meets every block as one tile, in which signatures are compared batch after batch and what is
    left is verified. Tiles are dealt out on their own, so a large group is the work of many tasks; a block has about
    ``BLOCK`` documents and ``BLOCK_BYTES`` of text at most, beyond a single longer one. Joins by leader are salted.
    """
    ends = [*range(BATCH, bands * rows + 1, BATCH)]
    least = [fewest_matches(n, percent / 100, miss) for n in ends]
    own = components.select("id", "component")
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    of_leader = own.select(F.col("id").alias("leader"), F.col("component").alias("of_leader")).join(members.select("leader").distinct(), "leader", "left_semi")
    named = members.select("key", "id", "leader").distinct().join(own, "id", "left").withColumn("salt", salt)
    named = named.join(of_leader.withColumn("salt", salts), ["leader", "salt"], "left")
    named = named.select("key", "id", "leader", "salt", F.coalesce("component", "id").alias("component"), F.coalesce("of_leader", "leader").alias("of_leader"))
    named = materialise(named.withColumn("other", F.col("component") != F.col("of_leader")).join(texts.select("key", "bytes"), "key"), "named")

    def blocks(part: Column) -> Column:
        return F.ceil(F.greatest(F.count_if(part) / BLOCK, F.sum(F.when(part, F.col("bytes"))) / BLOCK_BYTES)).cast("int")

    sizes = named.groupBy("leader").agg(blocks(F.col("other")).alias("others"), blocks(~F.col("other")).alias("mains")).where("others > 0")
    dealt = named.join(sizes.withColumn("salt", salts), ["leader", "salt"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("key", "leader"), F.when(F.col("other"), F.col("others")).otherwise(F.col("mains"))).cast("int"))
    dealt = dealt.select("key", "leader", "component", "other", "block").join(texts.drop("bytes"), "key")
    packed = dealt.groupBy("leader", "other", "block").agg(F.collect_list(F.struct("id", "component", "signature", "text")).alias("docs"))
    packed = materialise(packed, "blocks")
    first = packed.where("other").select("leader", F.col("block").alias("block_a"))
    tiles = first.join(packed.select("leader", "other", F.col("block").alias("block_b")), "leader").where("NOT other OR block_a <= block_b")
    tiles = tiles.repartition("leader", "block_a", "block_b")
    one = packed.where("other").select("leader", F.col("block").alias("block_a"), F.col("docs").alias("docs_a"))
    two = packed.select("leader", "other", F.col("block").alias("block_b"), F.col("docs").alias("docs_b"))
    met = tiles.join(one, ["leader", "block_a"]).join(two, ["leader", "other", "block_b"]).select("docs_a", "docs_b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for docs_a, docs_b in zip(b["docs_a"], b["docs_b"], strict=True):
                x, y = (np.frombuffer(b"".join(d["signature"] for d in docs), np.uint32).reshape(len(docs), -1) for docs in (docs_a, docs_b))
                of_a, of_b = (np.array([d["component"] for d in docs]) for docs in (docs_a, docs_b))
                i, j = np.nonzero(of_a[:, None] != of_b[None, :])
                done = np.zeros(len(i), dtype=np.int64)
                for end, fewest in zip(ends, least, strict=True):
                    at = slice(end - BATCH, end)
                    done = done + (x[i, at] == y[j, at]).sum(axis=1)
                    keep = done >= fewest
                    i, j, done = i[keep], j[keep], done[keep]
                    if not len(i):
                        break
                found, linked = [], set()
                sets: dict[int, set] = {}
                for k in np.argsort(-done, kind="stable"):
                    a, c = int(i[k]), int(j[k])
                    if (a, of_b[c]) in linked:
                        continue  # this document has its link to that component
                    both = []
                    for docs, n, key in ((docs_a, a, a), (docs_b, c, ~c)):
                        if key not in sets:
                            sets[key] = shingle_set(words_of(docs[n]["text"]), shingle)
                        both.append(sets[key])
                    common = len(both[0] & both[1])
                    if 100 * common >= percent * (len(both[0]) + len(both[1]) - common):
                        linked.add((a, of_b[c]))
                        found.append((docs_a[a]["id"], docs_b[c]["id"]))
                if found:
                    yield pd.DataFrame(found, columns=["a", "b"])

    return met.mapInPandas(run, "a long, b long")


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    miss: float = MISS,
) -> DataFrame:
    """Groups of near-duplicate documents: id, n_shingles, component (smallest id reachable by links), node, kept.

    Two documents are linked if their sets of distinct ``shingle``-word shingles have a Jaccard similarity of at least
    ``percent`` / 100. Ids are integers below 2^62 and name a document: rows that repeat an id with other words are one
    node that has the links of all of them; the rows stay. Rows without an id are one node for each text, after all ids:
    their component is the smallest id that they reach, null if there is none. ``kept`` tells whether a row's node is the
    first of its component. Null or blank text has an empty set and no links. An empty table gives an empty one. With the default 32 bands of 5, a pair right at 0.8 escapes all bands with a
    probability of 3e-6.
    """
    base = materialise(signatures(df, id_col, text_col, shingle, bands, rows), "signatures")
    full = base.where("n_shingles > 0")
    classes = materialise(full.groupBy("key").agg(F.min(F.struct("id", "mark")).alias("rep")).select("key", "rep.id", "rep.mark"), "classes")
    # an id with several texts ties its classes together
    ties = full.select("key", F.col("id").alias("a")).join(classes.select("key", F.col("id").alias("b")), "key").where("a != b").select("a", "b").distinct()
    ties = materialise(ties, "ties")
    reps = full.join(classes, ["key", "id", "mark"], "left_semi").dropDuplicates(["key"]).select("key", "id", "mark", "signature", "bands")
    banded = reps.select("key", "id", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    crowded = materialise(banded.join(shared, "bucket"), "crowded")
    # the most central member stands for a bucket: an original is in the large bucket of every band, an edited copy is not
    central = crowded.groupBy("key").agg(F.sum("n").alias("weight"))
    crowded_by = crowded.select("key", "id", "bucket").join(central, "key")
    leaders = crowded_by.groupBy("bucket").agg(F.max(F.struct("weight", F.negative("id").alias("id"), "key")).alias("top"))
    leaders = leaders.select("bucket", F.negative("top.id").alias("leader"), F.col("top.key").alias("leader_key"))
    members = materialise(crowded_by.join(leaders, "bucket").select("key", "id", "leader", "leader_key").distinct(), "members")
    involved = members.select("key").distinct()
    signs = materialise(reps.select("key", "id", "mark", "signature").join(involved, "key", "left_semi"), "signs")
    # a text for each class: rows that repeat it are one; only texts with a candidate are shuffled with their signatures
    texts = _marked(df, id_col, text_col).join(signs.select("id", "mark"), ["id", "mark"], "left_semi").groupBy("id", "mark").agg(F.min("text").alias("text"))
    texts = texts.join(signs, ["id", "mark"]).select("key", "id", "signature", "text", F.octet_length("text").alias("bytes"))
    texts = materialise(texts, "texts")
    # from here on of each row only what it returns
    whole, base = base, materialise(base.select("id", "key", "n_shingles"), "rows")
    release(signs, whole)

    def confirm(candidates: DataFrame) -> DataFrame:
        def ends(pairs: DataFrame, *columns: str) -> DataFrame:
            for side in ("a", "b"):
                pairs = pairs.join(texts.select(F.col("key").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
            return pairs

        # classes of one id are one node already
        left = bayes_prune(ends(candidates, "signature"), percent / 100, miss, bands, rows)
        return verify(ends(left, "id", "text"), shingle, percent)

    met = members.where("key != leader_key AND id != leader").select(F.least("key", "leader_key").alias("a"), F.greatest("key", "leader_key").alias("b")).distinct()
    links = materialise(ties.union(confirm(met)), "links")
    components = materialise(connected_components(links), "components")
    more = materialise(tiled_links(members, components, texts, shingle, percent, miss, bands, rows), "links", TILES)
    if not more.isEmpty():
        merged = components.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)
        components = materialise(connected_components(merged), "components")
    release(crowded, members, texts, links, more, ties)

    named = (
        classes.join(components, "id", "left")
        .select("key", F.coalesce("component", "id").alias("component"))
    )
    out = base.join(named, "key", "left").withColumn("component", F.coalesce("component", "id"))
    named_by = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return out.select(named_by("id").alias(id_col), "n_shingles", named_by("component").alias("component"), F.col("id").alias("node"), (F.col("id") == F.col("component")).alias("kept"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document by two-word shingles."""
    found = near_duplicates(documents(spark, sf_dir), shingle=2)
    return found.select(
        "doc_id", "n_shingles", F.col("component").alias("component_id"), "kept"
    )


ORACLE_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 2 THEN [words]
      ELSE list_transform(generate_series(1, len(words) - 1), lambda i: words[i:i + 1]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r(id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.id WHERE r.seen < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(seen) AS component_id FROM r GROUP BY 1) c ON c.id = d.doc_id
"""
