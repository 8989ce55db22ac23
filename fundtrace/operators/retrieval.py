"""Dated-evidence retrieval: chunks, exact TF-IDF, point-in-time eligibility."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType, TimestampType

from fundtrace.sources.scratch import written


_WORD = re.compile(r"\w{2,}")
#: Words that are counted together by a task before their terms are sent, about.
UNIT_WORDS = 4_000_000
#: Up to so many terms are counted a second time by name.
RECOUNTED = 500_000
#: Up to so many terms of questions are sent to the pieces, whose scores are then worked out where they are; more are joined by term.
BROADCAST_TERMS = 500_000
#: Pieces times events of a tile.
TILE = 1_000_000
#: Parts in which the best of an event are found before they are merged, where terms are joined.
TOP_PARTS = 16


def _once(c: Column, name: str) -> Column:
    """A column that is worked out once, as a generator's output is, however often later columns read it."""
    return F.explode(F.array(c)).alias(name)


def chunks(docs: DataFrame, doc: str, text: str, size: int = 1800, overlap: int = 220, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of the text, blanks as one: doc, the columns ``keep``, chunk (from 0), text. The piece that reaches the end is the last."""
    clean = docs.select(doc, *keep, _once(F.trim(F.regexp_replace(text, r"\s+", " ")), "_t"))
    n, step = F.char_length("_t"), size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    each = clean.where(n > 0).select(doc, *keep, "_t", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return each.select(doc, *keep, "chunk", F.substring(F.col("_t"), F.col("chunk") * step + 1, F.lit(size)).alias("text"))


def _words(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Words of two or more letters or digits of all texts after each other, and the number of words of each."""
    lists = [_WORD.findall(t.lower()) if t else [] for t in texts]
    return list(chain.from_iterable(lists)), np.fromiter(map(len, lists), np.int64, len(lists))


def _slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values of a sorted array begins, and its length."""
    if not len(ordered):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return starts, np.diff(np.append(starts, len(ordered)))


def _terms(codes: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms and their texts (by place): words as code * (n + 1), pairs as first * (n + 1) + second + 1; words have codes below n."""
    at = np.repeat(np.arange(len(sizes)), sizes)
    same = at[1:] == at[:-1] if len(at) else np.empty(0, bool)
    word = codes * (n + 1)
    return np.concatenate([word, word[:-1][same] + codes[1:][same] + 1]), np.concatenate([at, at[1:][same]])


def _named(terms: np.ndarray, names: list[str]) -> list[str]:
    first, second = np.divmod(terms, len(names) + 1)
    return [names[a] if b == 0 else f"{names[a]} {names[b - 1]}" for a, b in zip(first.tolist(), second.tolist(), strict=True)]


def grams(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Words of two or more letters or digits and pairs of them, with counts: keys, term, tf. Each row is counted where it is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                words, sizes = _words(part.column(len(keys)).to_pylist())
                names, codes = _coded(words)
                terms, at = _terms(codes, sizes, len(names))
                order = np.lexsort((terms, at))
                terms, at = terms[order], at[order]
                new = np.flatnonzero(np.append(True, (terms[1:] != terms[:-1]) | (at[1:] != at[:-1]))) if len(terms) else np.empty(0, np.int64)
                tf = np.diff(np.append(new, len(terms)))
                own = [part.column(i).take(pa.array(at[new])) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(_named(terms[new], names), pa.string()), pa.array(tf)], names=[*keys, "term", "tf"])

    given = df.select(*keys, text)
    return given.mapInArrow(count, StructType([*given.schema.fields[: len(keys)], StructField("term", StringType()), StructField("tf", LongType())]))


def _coded(words: list[str]) -> tuple[list[str], np.ndarray]:
    ids: defaultdict[str, int] = defaultdict()
    ids.default_factory = ids.__len__
    codes = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    return list(ids), codes


def _finder(terms: list[str]) -> Callable[[list[str], np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function that finds these terms in texts, by the words of all and the number of each: the text and the term (by place) of each hit."""
    ids: dict[str, int] = {}
    pairs = [[ids.setdefault(w, len(ids)) for w in t.split(" ")] for t in terms]
    n = len(ids) + 1  # words that no term has share the last code
    code = np.array([p[0] * (n + 1) + (p[1] + 1 if len(p) > 1 else 0) for p in pairs], np.int64)
    order = np.argsort(code)
    code, order = np.append(code[order], np.iinfo(np.int64).max), np.append(order, 0)

    def find(words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, at = _terms(np.fromiter((ids.get(w, n - 1) for w in words), np.int64, len(words)), sizes, n)
        place = np.searchsorted(code, found)
        hit = code[place] == found
        return at[hit], order[place[hit]]

    return find


def _unit_counts(codes: np.ndarray, sizes: np.ndarray, names: list[str], keep: int | None) -> pa.RecordBatch:
    """Terms of a unit of texts with their counts and numbers of texts: term, total, df, slack; and a row without a term.

    With ``keep`` only terms are given that have at least a quarter of the count of the ``keep``-th: ``slack`` is the highest count that
    is left out. The row without a term has it too.
    """
    terms, at = _terms(codes, sizes, len(names))
    n, texts = len(names) + 1, len(sizes)
    if n * n * texts < 1 << 62:
        known, key = None, np.sort(terms * texts + at)
    else:
        known, place = np.unique(terms, return_inverse=True)
        key = np.sort(place * texts + at)
    first, _ = _runs(key)
    starts, df = _runs(key[first] // texts)
    total = np.diff(np.append(first[starts], len(key)))
    terms = key[first[starts]] // texts
    terms = terms if known is None else known[terms]
    slack = 0
    if keep is not None and len(total) > keep:
        slack = max(0, int(np.partition(total, -keep)[-keep]) // 4 - 1)
        often = total > slack
        terms, total, df = terms[often], total[often], df[often]
    return pa.RecordBatch.from_arrays([pa.array([*_named(terms, names), None], pa.string()), pa.array(np.append(total, 0)), pa.array(np.append(df, 0)), pa.array(np.append(np.full(len(total), slack), slack))], names=["term", "total", "df", "slack"])


def _counts(pieces: DataFrame, text: str, keep: int | None = None) -> DataFrame:
    """Counts of terms over all texts: term, total, df, slack. Each task adds up units of about ``UNIT_WORDS`` words before it sends them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: defaultdict[str, int] = defaultdict()
        ids.default_factory = ids.__len__
        codes, sizes, n = [], [], 0
        for batch in batches:
            for part in _slices(batch):
                words, own = _words(part.column(0).to_pylist())
                codes.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
                sizes.append(own)
                n += len(words)
                if n >= UNIT_WORDS:
                    yield _unit_counts(np.concatenate(codes), np.concatenate(sizes), list(ids), keep)
                    codes, sizes, n = [], [], 0
                    ids.clear()
        if n:
            yield _unit_counts(np.concatenate(codes), np.concatenate(sizes), list(ids), keep)

    each = pieces.select(text).mapInArrow(count, "term string, total long, df long, slack long")
    return each.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("total", "df", "slack")])


def _counts_of(pieces: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Counts of these terms over all texts: term, total, df."""
    shared = pieces.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, n = _finder(shared.value), len(shared.value)
        total, df = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            for part in _slices(batch):
                at, term = find(*_words(part.column(0).to_pylist()))
                total += np.bincount(term, minlength=n)
                df += np.bincount(np.unique(at * n + term) % n, minlength=n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([shared.value[i] for i in some], pa.string()), pa.array(total[some]), pa.array(df[some])], names=["term", "total", "df"])

    return pieces.select(text).mapInArrow(count, "term string, total long, df long").groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def _top_terms(pieces: DataFrame, text: str, k: int) -> DataFrame:
    """The ``k`` terms of highest count over all texts (ties by name): term, total, df. Exact.

    Units of texts leave out terms that are rare in them, and say up to which count. What a term may lack is the sum of that over the
    units that did not give it. Terms that may reach the ``k``-th count and may lack something are counted again; where that can't be
    told, or where they are many, everything is counted.
    """
    best = lambda df: df.where("term is not null").orderBy(F.desc("total"), "term").limit(k).select("term", "total", "df")
    counts = written(_counts(pieces, text, k), "counts")
    lacking = counts.where("term is null").agg(F.max("slack")).first()[0] or 0
    if not lacking:
        return best(counts)
    least = best(counts).agg(F.min("total")).first()[0]
    maybe = counts.where((F.col("total") + lacking - F.col("slack") >= least) & F.col("term").isNotNull())
    unsure = maybe.where(F.col("slack") < lacking).select("term").limit(RECOUNTED + 1).collect() if lacking < least else None
    if unsure is None or len(unsure) > RECOUNTED:
        return best(written(_counts(pieces, text), "counts"))
    sure = maybe.where(F.col("slack") >= lacking).select("term", "total", "df")
    return best(sure.unionByName(_counts_of(pieces, text, [r["term"] for r in unsure])) if unsure else sure)


def _index(pieces: DataFrame, keys: list[str], text: str, weights: dict[str, float], asked: list[str], every: bool) -> DataFrame:
    """What scoring needs of each piece: keys, ``_base`` (sum of the squares of tf * weight), ``_at`` (places in ``asked`` of its terms) and ``_tf``.

    Pieces that have no term in ``asked`` are left out, unless ``every`` is set.
    """
    shared = pieces.sparkSession.sparkContext.broadcast((weights, asked))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, known = shared.value
        terms = list(dict.fromkeys([*known, *idf]))
        weight, n_known = np.array([idf.get(t, 0.0) for t in terms]), len(known)
        find = _finder(terms)
        for batch in batches:
            for part in _slices(batch):
                words, sizes = _words(part.column(len(keys)).to_pylist())
                at, term = find(words, sizes)
                key = np.sort(at * len(terms) + term)
                first, tf = _runs(key)
                at, term = np.divmod(key[first], max(1, len(terms)))
                base = np.bincount(at, weights=(tf * weight[term]) ** 2, minlength=len(sizes))
                own = term < n_known
                counts = np.bincount(at[own], minlength=len(sizes))
                ends = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[own], pa.int32())) for x in (term, tf)]
                out = pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keys))), pa.array(base), *lists], names=[*keys, "_base", "_at", "_tf"])
                yield out if every else out.filter(pa.array(counts > 0))

    given = pieces.select(*keys, text)
    more = [StructField("_base", DoubleType()), StructField("_at", ArrayType(IntegerType())), StructField("_tf", ArrayType(IntegerType()))]
    return given.mapInArrow(read, StructType([*given.schema.fields[: len(keys)], *more]))


def _nearest(index: DataFrame, keys: list[str], moment: str | None, own: list, limit: int) -> DataFrame:
    """The best pieces of each event of a task, from its part of the index: ``_asker`` (place), ``_rank`` (rounded score), score, keys.

    ``own``: for each event its last moment (or None) and its terms as (place, weight in the question, idf with it, idf without it).
    Pieces and events meet in tiles of bounded size; for each event only those better than its worst place so far go on.
    """
    shared = index.sparkSession.sparkContext.broadcast(own)
    lead = [moment] if moment else []

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events = shared.value
        rows = max(16, min(2_048, TILE // max(1, len(events))))
        last = np.array([m for m, _ in events], np.int64) if moment else None
        table = np.array([(t, e, qw, a, b) for e, (_, terms) in enumerate(events) for t, qw, a, b in terms], np.float64).reshape(-1, 5)
        table = table[np.argsort(table[:, 0], kind="stable")]
        starts, length = _runs(table[:, 0])
        by_term = {int(table[s, 0]): table[s : s + n, 1:] for s, n in zip(starts, length, strict=True)}
        bar = np.zeros(len(events))
        best = np.empty((0, 5))  # event, rounded score, score, arrival, row of held
        held, arrived = None, 0
        for batch in batches:
            for part in _slices(batch, rows):
                base = part.column(len(lead) + len(keys)).to_numpy()
                lists = part.column(len(lead) + len(keys) + 1)
                at = np.repeat(np.arange(len(base)), np.diff(lists.offsets.to_numpy()))
                term, tf = lists.flatten().to_numpy(), part.column(len(lead) + len(keys) + 2).flatten().to_numpy().astype(np.float64)
                order = np.argsort(term, kind="stable")
                at, term, tf = at[order], term[order], tf[order]
                dot, square = np.zeros((len(base), len(events))), np.repeat(base[:, None], len(events), axis=1)
                for s, n in zip(*_runs(term), strict=True):
                    if (mine := by_term.get(int(term[s]))) is not None:
                        a, x = at[s : s + n], tf[s : s + n, None]
                        e, qw, idf, plain = mine[:, 0].astype(np.int64), mine[:, 1], mine[0, 2], mine[0, 3]
                        cells = (a,) if len(e) == len(events) else np.ix_(a, e)
                        dot[cells] += x * idf * qw
                        square[cells] += x * x * (idf * idf - plain * plain)
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.where(dot > 0, dot / np.sqrt(square), 0.0)
                if moment:
                    score[part.column(0).to_numpy()[:, None] > last[None, :]] = 0.0
                rank = np.round(score, 9)
                r, e = np.nonzero((score > 0) & ((rank > bar) | (bar == 0)))
                if len(r):
                    best = np.concatenate([best, np.column_stack([e, rank[r, e], score[r, e], arrived + r, (0 if held is None else held.num_rows) + r])])
                    own_keys = pa.Table.from_batches([part.select([*keys])])
                    held = own_keys if held is None else pa.concat_tables([held, own_keys])
                    best = best[np.lexsort((best[:, 3], -best[:, 1], best[:, 0]))]
                    starts, length = _runs(best[:, 0])
                    best = best[np.arange(len(best)) - np.repeat(starts, length) < limit]
                    starts, length = _runs(best[:, 0])
                    full = length == limit
                    ends = starts[full] + limit - 1
                    bar[best[ends, 0].astype(np.int64)] = best[ends, 1]
                    rows_held, place = np.unique(best[:, 4].astype(np.int64), return_inverse=True)
                    held, best[:, 4] = held.take(pa.array(rows_held)), place
                arrived += len(base)
        if held is not None:
            out = held.take(pa.array(best[:, 4].astype(np.int64)))
            for c in reversed((("_asker", best[:, 0].astype(np.int32)), ("_rank", best[:, 1]), ("score", best[:, 2]))):
                out = out.add_column(0, c[0], pa.array(c[1]))
            yield from out.combine_chunks().to_batches()

    given = index.sortWithinPartitions(*keys).select(*lead, *keys, "_base", "_at", "_tf")
    fields = [StructField("_asker", IntegerType()), StructField("_rank", DoubleType()), StructField("score", DoubleType())]
    return given.mapInArrow(search, StructType([*fields, *given.schema.fields[len(lead) : len(lead) + len(keys)]]))


#: What evidence of one scope mentions.
SCOPES = {
    "macro_only": ("macro", "fomc", "rate", "inflation", "gdp", "yield", "recession", "market"),
    "micro_only": ("ticker", "company", "stock", "holding", "industry", "earnings", "fund", "manager"),
}


def in_scope(docs: DataFrame, scope: str, *columns: str) -> DataFrame:
    """Documents that mention a term of the scope in one of the columns; any other scope keeps all."""
    if scope not in SCOPES:
        return docs
    text = F.lower(F.concat_ws(" ", *columns))
    return docs.where(reduce(lambda a, b: a | b, [text.contains(t) for t in SCOPES[scope]]))


def distinct_evidence(docs: DataFrame, doc: str, *same: str) -> DataFrame:
    """One document, the one with the smallest ``doc``, for each title, date and text (``same``; nulls are alike)."""
    rest = [c for c in docs.columns if c not in (doc, *same)]
    first = docs.groupBy(*same).agg(F.min_by(F.struct(doc, *rest), F.struct(doc, *rest)).alias("_f"))
    return first.select("_f.*", *same).select(docs.columns)


def retrieve_many(pieces: DataFrame, keys: list[str], text: str, questions: DataFrame, event: str, question: str, limit: int, date: str | None = None, cutoff: str | None = None, max_terms: int = 16_000) -> DataFrame:
    """The pieces nearest to the question of every event under TF-IDF with words and pairs: event, place (from 1), keys, score.

    A piece can answer an event if its ``date`` is at most the event's ``cutoff`` (both given or neither); pieces without a
    date and events without a cutoff take no part then. Each question counts as a document among the pieces that any event can
    use: weights are tf * (ln((1 + n) / (1 + df)) + 1) with n and df of those and the question; the score is the dot product of
    L2-normalised weights. The vocabulary is the ``max_terms`` terms of highest count (ties by name); a question's own terms
    belong to its vocabulary too if their count with the question reaches that. Ties of the score (9 digits) go by keys.

    The keys of pieces are unique. Pieces are cut and dealt once and written. The text is read for the vocabulary (:func:`_top_terms`) and for
    an index of the pieces that share a term with any question; all later steps read that index. A task compares its part of the
    index with all questions in tiles and sends the best of each event, if the questions have at most ``BROADCAST_TERMS`` terms in all;
    more are joined by term. What a question changes in the norm of a piece is added to it by the terms they share.
    """
    spark, dates = pieces.sparkSession, [date] if date else []
    cutoffs = [cutoff] if date else []
    asked = questions.select(event, *cutoffs, question)
    if date:
        asked = asked.withColumn(cutoff, F.col(cutoff).cast(pieces.schema[date].dataType)).where(F.col(cutoff).isNotNull())
    questions = written(asked, "asked")
    if date:
        last = questions.agg(F.max(cutoff).alias("_last"))
        pieces = pieces.join(F.broadcast(last), F.col(date) <= F.col("_last")).drop("_last")  # one row
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a set number, so that pieces of few files are spread
    pieces = written(pieces.select(*keys, *dates, text).repartition(parts, *keys), "pieces")
    size = pieces.agg((F.count("*") + 1).alias("_n"))
    asked = written(grams(questions, [event, *cutoffs], question).withColumnRenamed("tf", "qtf"), "question_terms")
    known = asked.select("term").distinct()
    terms = [r["term"] for r in known.orderBy("term").limit(BROADCAST_TERMS + 1).collect()]
    few = len(terms) <= BROADCAST_TERMS
    idf = lambda df: F.log((1 + F.col("_n")) / (1 + df)) + 1
    top = _top_terms(pieces, text, max_terms)
    vocabulary = written(top.join(F.broadcast(size), F.lit(True)).withColumn("idf", idf(F.col("df"))), "vocabulary")  # max_terms rows
    weights = {r["term"]: r["idf"] for r in vocabulary.select("term", "idf").collect()}
    index = written(_index(pieces, [*keys, *dates], text, weights, terms if few else [], not few), "index")
    if few:
        places = F.broadcast(spark.createDataFrame(list(enumerate(terms)), "_place int, term string"))
        met = index.select(F.explode(F.arrays_zip("_at", "_tf")).alias("_m")).select(F.col("_m._at").alias("_place"), F.col("_m._tf").cast("long").alias("tf"))
        counted = met.groupBy("_place").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).join(places, "_place")
    else:
        asked_for = grams(pieces, [*keys, *dates], text).join(known, "term", "left_semi")
        counted = asked_for.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    edge = vocabulary.agg(F.count("*").alias("_c"), F.min(F.struct("total", F.lit(0).alias("z"))).alias("_e"), F.max_by("term", F.struct(F.negative("total"), "term")).alias("_t"))
    own = asked.join(counted, "term", "left").join(F.broadcast(edge), F.lit(True)).join(F.broadcast(size), F.lit(True))
    count = F.coalesce("total", F.lit(0)) + F.col("qtf")
    inside = (F.col("_c") < max_terms) | (count > F.col("_e.total")) | ((count == F.col("_e.total")) & (F.col("term") <= F.col("_t")))
    own = own.where(inside).withColumn("q_idf", idf(F.coalesce("df", F.lit(0)) + 1)).withColumn("_w", F.col("qtf") * F.col("q_idf"))
    length = own.groupBy(event).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_l"))
    own = own.join(length, event).join(F.broadcast(vocabulary.select("term", "idf")), "term", "left")
    own = own.select(event, *cutoffs, "term", (F.col("_w") / F.col("_l")).alias("qw"), "q_idf", F.coalesce("idf", F.lit(0.0)).alias("idf"))
    own = written(own, "questions")
    order = [F.desc("_rank"), *keys]
    if few and own.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        moments = _moment(F.col(cutoff), own.schema[cutoff].dataType) if date else F.lit(None).cast("long")
        place = {t: i for i, t in enumerate(terms)}
        by_event: dict = {}
        for r in own.select(F.col(event), moments.alias("_m"), "term", "qw", "q_idf", "idf").collect():
            by_event.setdefault(r[0], (r["_m"], []))[1].append((place[r["term"]], r["qw"], r["q_idf"], r["idf"]))
        if date:
            index = index.withColumn("_moment", _moment(F.col(date), index.schema[date].dataType))
        first = _nearest(index, keys, "_moment" if date else None, list(by_event.values()), limit)
        numbers = spark.createDataFrame(list(enumerate(by_event)), StructType([StructField("_asker", IntegerType()), StructField(event, own.schema[event].dataType)]))
        first = first.join(F.broadcast(numbers), "_asker")
    else:
        pairs = asked_for if not few else _joined_terms(index, keys, dates, places)
        met = pairs.join(own, (pairs["term"] == own["term"]) & ((F.col(date) <= F.col(cutoff)) if date else F.lit(True)))
        sums = met.groupBy(event, *keys).agg(F.sum(F.col("tf") * F.col("q_idf") * F.col("qw")).alias("_dot"), F.sum(F.col("tf") ** 2 * (F.col("q_idf") ** 2 - F.col("idf") ** 2)).alias("_more"))
        scored = sums.join(index.select(*keys, "_base"), keys).withColumn("score", F.col("_dot") / F.sqrt(F.col("_base") + F.col("_more"))).where("score > 0").withColumn("_rank", F.round("score", 9))
        part = F.pmod(F.xxhash64(*keys), F.lit(TOP_PARTS)).alias("_part")
        first = scored.select(event, *keys, "score", "_rank", part).withColumn("place", F.row_number().over(W.partitionBy(event, "_part").orderBy(*order))).where(F.col("place") <= limit)
    return first.withColumn("place", F.row_number().over(W.partitionBy(event).orderBy(*order))).where(F.col("place") <= limit).select(event, "place", *keys, "score")


def _joined_terms(index: DataFrame, keys: list[str], dates: list[str], places: DataFrame) -> DataFrame:
    """The index with a row for each term of a piece: keys, dates, term, tf."""
    met = index.select(*keys, *dates, F.explode(F.arrays_zip("_at", "_tf")).alias("_m")).select(*keys, *dates, F.col("_m._at").alias("_place"), F.col("_m._tf").cast("long").alias("tf"))
    return met.join(places, "_place").drop("_place")


def _moment(c: Column, kind: DataType) -> Column:
    """A date or time as a whole number; numbers as they are."""
    return F.unix_date(c).cast("long") if isinstance(kind, DateType) else F.unix_micros(c.cast("timestamp")) if isinstance(kind, (TimestampType, TimestampNTZType)) else c.cast("long")


def retrieve(pieces: DataFrame, keys: list[str], text: str, query: str, limit: int, max_terms: int = 16_000) -> DataFrame:
    """The pieces nearest to one query, by :func:`retrieve_many`: keys, score."""
    asked = pieces.sparkSession.range(1).select(F.lit(query).alias("_q"), F.lit(0).alias("_event"))
    return retrieve_many(pieces, keys, text, asked, "_event", "_q", limit, max_terms=max_terms).select(*keys, "score")


def overlap_score(df: DataFrame, text: str, query: str):
    """Share of the query's distinct words that the text has."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    q = words(F.lit(query))
    return df.withColumn("overlap", F.size(F.array_intersect(words(F.col(text)), q)) / F.nullif(F.size(q), F.lit(0)))


def dated(df: DataFrame, name: str, text: str):
    """Date in the name, else in the first 300 characters: yyyy-mm-dd, yyyymmdd, or yyyy-mm (its first day)."""
    def find(c):
        full = F.try_to_date(F.regexp_replace(F.nullif(F.regexp_extract(c, r"((?:19|20)\d{2}[-_/.]?\d{2}[-_/.]?\d{2})", 1), F.lit("")), "[-_/.]", ""), "yyyyMMdd")
        month = F.try_to_date(F.concat(F.regexp_replace(F.nullif(F.regexp_extract(c, r"((?:19|20)\d{2}[-_/.]\d{2})", 1), F.lit("")), "[-_/.]", ""), F.lit("01")), "yyyyMMdd")
        return F.coalesce(full, month)

    return df.withColumn("found_date", F.coalesce(find(F.col(name)), find(F.substring(text, 1, 300))))


def evidence_ids(df: DataFrame, order: list):
    """E001, E002, ... in order. For short lists that were already cut to their size."""
    return df.withColumn("evidence_id", F.format_string("E%03d", F.row_number().over(W.orderBy(*order))))
