"""Operator 10: toxicity by the nearest labelled examples under exact TF-IDF cosine.

The vector of a text has all its words: (1 + ln tf) * idf * relevance. The idf is over all documents. The relevance
frequency log2(2 + a / max(1, c)), for a toxic and c other examples with the word, tells words that set toxic texts apart
from words of every text; it is 1 at least, so no word is left out. Examples are a bounded sample of labelled rows, those
with equal words are one, with counts, and each counts once in a, c. They form an inverted index in blocks with the largest
weight of each word in each block. Texts visit blocks in order of their bound and stop when no other block can reach their
k-th best, so the neighbours are exact. Votes weigh by similarity over distance, so a copy of an example outweighs all else,
with a little weight for the overall share. A logistic curve, fitted to the votes that examples get without themselves,
makes them probabilities.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm.common import crc_of, documents, fit_logistic, materialise, release

LETTERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
#: Labelled rows that teach at most, about; chosen by a hash of their id.
MAX_EXAMPLES = 4_000
NEIGHBOURS, PRIOR_WEIGHT, NEAR = 31, 0.05, 0.02
#: Examples of a block; texts that visit blocks together; share of examples from which a word is kept as a dense row.
BLOCK, TOGETHER, DENSE = 512, 128, 1 / 12

#: Numbers of its words, in order, their counts, rows alike, toxic ones among them, and the smallest id.
Example = tuple[np.ndarray, np.ndarray, int, int, int]


def words_of(text: str | None) -> Counter:
    """Words, in lower case and as UTF-8, and their counts: runs of ASCII letters and of characters beyond ASCII."""
    return Counter((text or "").lower().encode("utf-8", "surrogatepass").translate(LETTERS).split())


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges after each other, and the size of each."""
    size = end - begin
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum()), size


def _highest(found: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest of each row, ties to the earlier one, in any order."""
    if found.shape[1] <= k:
        return np.broadcast_to(np.arange(found.shape[1]), found.shape)
    keep = np.argpartition(-found, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(found, keep, 1).min(axis=1)
    tied = np.flatnonzero((least > 0) & ((found >= least[:, None]).sum(axis=1) > k))
    keep[tied] = np.argsort(-found[tied], axis=1, kind="stable")[:, :k]
    return keep


class Block:
    """Examples of one block: words that many examples have as dense rows, the postings of the others by word."""

    def __init__(self, size: int, words: np.ndarray, rows: np.ndarray, weights: np.ndarray, dense: np.ndarray):
        at = dense[words]
        self.size, self.common = size, np.zeros((int(dense.max(initial=-1)) + 1, size))
        self.common[at[at >= 0], rows[at >= 0]] = weights[at >= 0]
        words, rows, weights = words[at < 0], rows[at < 0], weights[at < 0]
        order = np.argsort(words, kind="stable")
        self.rows, self.weights = rows[order], weights[order]
        self.words, begin = np.unique(words[order], return_index=True)
        self.begin = np.append(begin, len(order))

    def cosines(self, texts: int, common: np.ndarray, of: np.ndarray, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Of each text with each example. ``of``: the text of each of the words that are not ``common``."""
        found = common @ self.common
        if len(self.words) and len(words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            hit = np.flatnonzero(self.words[at] == words)
            place, size = _ranges(self.begin[at[hit]], self.begin[at[hit] + 1])
            cell = np.repeat(of[hit] * self.size, size) + self.rows[place]
            found += np.bincount(cell, np.repeat(weights[hit], size) * self.weights[place], found.size).reshape(found.shape)
        return found


class BlockMaxIndex:
    """Inverted index of normalised example vectors, in blocks with the largest weight of each word."""

    def __init__(self, place: dict[bytes, int], df: np.ndarray, total: int, examples: list[Example]):
        """``place``: number of each word of the examples; ``df``: how many of ``total`` documents have it, by number."""
        self.place, self.total = place, total
        toxic, other = np.zeros(len(place)), np.zeros(len(place))
        for at, _, n, t, _ in examples:
            (toxic if 2 * t > n else other)[at] += 1
        self.weight = (np.log((1 + total) / (1 + df)) + 1) * np.log2(2 + toxic / np.maximum(other, 1))
        use = toxic + other
        often = np.argsort(-use, kind="stable")
        often = often[use[often] > max(1, len(examples) * DENSE)]
        self.dense = np.full(len(self.place), -1)
        self.dense[often] = np.arange(len(often))
        # alike examples side by side: by class, then by which of the most common words they have
        bit = np.zeros(len(self.place), dtype=object)
        bit[often[:24]] = [1 << (23 - i) for i in range(len(often[:24]))]
        self.examples = sorted(examples, key=lambda e: (2 * e[3] > e[2], int(bit[e[0]].sum()), e[4]))
        self.rows = np.array([e[2] for e in self.examples], float)
        self.toxic = np.array([e[3] for e in self.examples], float)
        self.ids = [e[4] for e in self.examples]
        self.blocks, most = [], []
        for first in range(0, len(examples), BLOCK):
            part = [e[:2] for e in self.examples[first : first + BLOCK]]
            words = np.concatenate([p[0] for p in part])
            rows = np.repeat(np.arange(len(part)), [len(p[0]) for p in part])
            weights = np.concatenate([self._unit((1 + np.log(tf)) * self.weight[at]) for at, tf in part])
            self.blocks.append(Block(len(part), words, rows, weights, self.dense))
            best = np.zeros(len(self.place))
            np.maximum.at(best, words, weights)
            most.append(best)
        most = np.array(most).reshape(len(self.blocks), len(self.place))
        word, block = np.nonzero(most.T)
        self.most, self.most_block, self.most_begin = most.T[word, block], block, np.searchsorted(word, np.arange(len(self.place) + 1))

    @staticmethod
    def _unit(w: np.ndarray) -> np.ndarray:
        size = math.sqrt(float(w @ w))
        return w / size if size else w

    def vector(self, words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that examples have, and their weights in the unit vector of all words.

        Words that no example has weigh as words of this document alone; they only lengthen the vector.
        """
        get = self.place.get
        at = np.array([get(w, -1) for w in words], int)
        return self.weighed(at, np.fromiter(words.values(), float, len(words)))

    def weighed(self, at: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unknown = math.log((1 + self.total) / 2) + 1 if self.total else 1.0
        w = self._unit((1 + np.log(tf)) * np.where(at < 0, unknown, self.weight[at] if len(self.weight) else unknown))
        return at[at >= 0], w[at >= 0]

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        """For each vector the k examples of highest cosine (above 0), ties to the earlier one: (cosine, place)."""
        n, b = len(vectors), len(self.blocks)
        if not b or not n:
            return [[] for _ in vectors]
        of = np.repeat(np.arange(n), [len(v[0]) for v in vectors])
        words, weights = np.concatenate([v[0] for v in vectors]), np.concatenate([v[1] for v in vectors])
        place, size = _ranges(self.most_begin[words], self.most_begin[words + 1])
        cell = np.repeat(of * b, size) + self.most_block[place]
        bound = np.bincount(cell, np.repeat(weights, size) * self.most[place], n * b).reshape(n, b)
        dense = self.dense[words]
        common = np.zeros((n, len(self.blocks[0].common)))
        common[of[dense >= 0], dense[dense >= 0]] = weights[dense >= 0]
        of, words, weights = of[dense < 0], words[dense < 0], weights[dense < 0]
        begin = np.searchsorted(of, np.arange(n + 1))
        turn = np.argsort(-bound, axis=1, kind="stable")
        best, who, least = np.zeros((n, 0)), np.zeros((n, 0), int), np.zeros(n)
        for step in range(b):
            at = turn[:, step]
            alive = np.flatnonzero((bound[np.arange(n), at] > 0) & (bound[np.arange(n), at] >= least - 1e-12))
            if not len(alive):
                break
            new, names = np.zeros((n, k)), np.full((n, k), -1)
            for block in np.unique(at[alive]):
                mine = alive[at[alive] == block]
                pick, count = _ranges(begin[mine], begin[mine + 1])
                found = np.round(self.blocks[block].cosines(len(mine), common[mine], np.repeat(np.arange(len(mine)), count), words[pick], weights[pick]), 12)
                keep = _highest(found, k)
                new[mine, : keep.shape[1]] = np.take_along_axis(found, keep, 1)
                names[mine, : keep.shape[1]] = keep + block * BLOCK
            best, who = np.hstack([best, new]), np.hstack([who, names])
            keep = np.lexsort((who, -best), axis=1)[:, :k]
            best, who = np.take_along_axis(best, keep, 1), np.take_along_axis(who, keep, 1)
            least = best[:, -1] if best.shape[1] == k else np.zeros(n)
        return [[(float(s), int(x)) for s, x in zip(*row, strict=True) if s > 0] for row in zip(best, who, strict=True)]

    def vote(self, near: list[tuple[float, int]], share: float, own: int = -1, y: int = 0) -> float:
        """Weighted share of toxic rows among neighbours. ``own``, ``y``: leave out one row of this place and label."""
        up, down = PRIOR_WEIGHT * share, PRIOR_WEIGHT
        for s, at in near:
            n, toxic = self.rows[at] - (at == own), self.toxic[at] - (at == own) * y
            if n > 0:
                w = s / (1 + NEAR - min(s, 1.0))
                up, down = up + w * toxic / n, down + w
        return up / down

    def votes_without_themselves(self, first: int, end: int, share: float) -> list[tuple[float, float]]:
        """What the neighbours of these examples say of each label that they have: the vote, as a logit, and the label."""
        out = []
        near_of = self.nearest([self.weighed(*e[:2]) for e in self.examples[first:end]], NEIGHBOURS + 1)
        for at, near in enumerate(near_of, first):
            near = near if self.rows[at] > 1 else [x for x in near if x[1] != at]
            for label, count in ((1, self.toxic[at]), (0, self.rows[at] - self.toxic[at])):
                if count:
                    out.append((_logit(self.vote(near[:NEIGHBOURS], share, at, label)), float(label)))
        return out


class Classifier:
    """A shared index, the share of toxic examples and the curve: all that a task needs to score texts."""

    def __init__(self, shared: Broadcast, share: float, slope: float, shift: float):
        self.shared, self.share, self.slope, self.shift = shared, share, slope, shift

    def score(self, texts: list[str | None]) -> list[tuple[float, list[tuple[float, int]]]]:
        """Score and neighbours of each text; one without a word that examples have gets the share of toxic examples."""
        out: list[tuple[float, list[tuple[float, int]]]] = []
        index = self.shared.value
        for first in range(0, len(texts), TOGETHER):
            for near in index.nearest([index.vector(words_of(t)) for t in texts[first : first + TOGETHER]], NEIGHBOURS):
                z = self.slope * _logit(index.vote(near, self.share)) + self.shift
                out.append((1 / (1 + math.exp(-min(50.0, max(-50.0, z)))) if near else self.share, near))
        return out


def _drawn(key: str, n: int) -> Column:
    """Whether a row is in a sample of about ``MAX_EXAMPLES`` of ``n``, by hash, on a grid of 1e12."""
    coarse, fine = (F.pmod(h, F.lit(1_000_000)) for h in (F.xxhash64(key), F.xxhash64(key, F.lit(1))))
    return coarse * 1_000_000 + fine < 10**12 * MAX_EXAMPLES // n


def choose_examples(df: DataFrame, labels: DataFrame, label_col: str, teach: str, id_col: str, text_col: str) -> tuple[dict[bytes, int], list[Example]]:
    """The words of the labelled rows, numbered, and these rows, a bounded sample by hash."""
    y = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").where(F.expr(teach)).distinct()
    n = y.count()
    if n > MAX_EXAMPLES:
        y = y.where(_drawn("id", n))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(y), "id")  # about MAX_EXAMPLES labels at most
    alike = materialise(rows.groupBy("text").agg(F.count("*").alias("n"), F.sum("y").alias("toxic"), F.min("id").alias("one")), "examples")
    n = alike.count()
    if n > 2 * MAX_EXAMPLES:  # ids that stand for many texts
        alike = alike.where(_drawn("text", n))
    place: dict[bytes, int] = {}
    found: dict[bytes, list] = {}
    for r in alike.orderBy("one", "text").toLocalIterator():
        coded = sorted((place.setdefault(w, len(place)), n) for w, n in words_of(r["text"]).items())
        at, tf = np.array(coded, np.int32).reshape(-1, 2).T.copy()
        own = found.setdefault(at.tobytes() + tf.tobytes(), [at, tf, 0, 0, r["one"]])
        own[2] += r["n"]
        own[3] += r["toxic"]
    release(alike)
    return place, [tuple(e) for e in found.values()]


def document_frequencies(df: DataFrame, text_col: str, place: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many rows each word of ``place`` is, by number, and the number of rows."""
    shared = df.sparkSession.sparkContext.broadcast(place)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        n, rows = np.zeros(len(known), np.int64), 0
        for b in batches:
            rows += len(b)
            for text in b["text"]:
                n[[known[w] for w in words_of(text) if w in known]] += 1
        at = np.flatnonzero(n)
        yield pd.DataFrame({"word": np.append(at, -1).astype(np.int32), "n": np.append(n[at], rows)})

    counts = df.select(F.col(text_col).alias("text")).mapInPandas(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # a row for each word of the examples
    shared.unpersist()
    out = np.zeros(len(place))
    out[found["word"][found["word"] >= 0]] = found["n"][found["word"] >= 0]
    return out, int(found["n"][found["word"] < 0].sum())


def train(df: DataFrame, labels: DataFrame, label_col: str, teach: str, id_col: str, text_col: str) -> Classifier:
    """The classifier. What reaches the driver is bounded by the number of examples."""
    place, examples = choose_examples(df, labels, label_col, teach, id_col, text_col)
    share = (sum(e[3] for e in examples) + 1) / (sum(e[2] for e in examples) + 2)
    seen, total = document_frequencies(df, text_col, place)
    index = BlockMaxIndex(place, seen, total, [e for e in examples if len(e[0])])
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(index)  # bounded by MAX_EXAMPLES texts

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first in b["id"]:
                yield pd.DataFrame(shared.value.votes_without_themselves(first, first + TOGETHER, share), columns=["z", "y"])

    starts = spark.range(0, len(index.examples), TOGETHER)
    found = starts.mapInPandas(votes, "z double, y double").orderBy("z", "y").toPandas()  # two rows for each example at most
    slope, shift = fit_logistic(found["z"].to_numpy(), found["y"].to_numpy(), np.ones(len(found))) if len(found) else (1.0, 0.0)
    return Classifier(shared, share, slope, shift)


def score_documents(df: DataFrame, labels: DataFrame, label_col: str, teach: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every row: ``id_col``, score (0 to 1) and evidence (nearest examples: id of one, rows alike, toxic ones
    among them, cosine; nearest first).

    ``labels`` has ``id_col`` and ``label_col`` (0 or 1; others are no labels; repeats count once). Only rows for which the
    SQL expression ``teach`` (over a column named id) holds are examples; about ``MAX_EXAMPLES`` at most, chosen by hash. A
    document without any word that an example has, an empty or null one included, gets the share of toxic examples. Without
    examples of both classes every score is near their share, starting from one row of each class. Repeated rows stay and
    score alike. Very long texts are taken whole. Other columns play no part, whatever their names.
    """
    classifier = train(df, labels, label_col, teach, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        i = classifier.shared.value
        for b in (w[first : first + 8 * TOGETHER] for w in batches for first in range(0, len(w), 8 * TOGETHER)):
            got = classifier.score(list(b["text"]))
            evidence = [[{"id": i.ids[at], "n": int(i.rows[at]), "toxic": int(i.toxic[at]), "cosine": s} for s, at in near] for _, near in got]
            yield pd.DataFrame({"id": b["id"], "score": [g[0] for g in got], "evidence": evidence})

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(run, f"id {kind}, score double, evidence array<struct<id: {kind}, n: long, toxic: long, cosine: double>>")
    return out.withColumnRenamed("id", id_col)


def without_toxic(df: DataFrame, labels: DataFrame, label_col: str, teach: str, reject: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that score below ``reject``, as they are. Each is scored where it is read, so no text is shuffled.

    Rows are as in :func:`score_documents`; all columns pass through as Arrow, unchanged.
    """
    classifier = train(df, labels, label_col, teach, id_col, text_col)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(first, TOGETHER)
                yield b.filter(pa.array([s < reject for s, _ in classifier.score(b.column(at).to_pylist())], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


#: SQL expression over id: rows that teach.
TRAIN = "crc32(cast(cast(id as string) as binary)) % 3 != 1"
REJECT = 0.7


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score_documents(documents(spark, sf_dir), labels, "toxic", TRAIN)
    return out.select(
        "doc_id", (crc_of("doc_id") % 3 == 1).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"),
        F.slice("evidence", 1, 3).alias("evidence"),
    )
