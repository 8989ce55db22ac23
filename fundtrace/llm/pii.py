"""Operator 3: personal data by bootstrapped contextual extraction.

Identifiers of fixed form (the base) are seeds. The words around them are lexical patterns: the two words before, or the
word before with the word after. Every other token or run of digits, spaces within it included, that looks somewhat like an
identifier is a candidate of each kind it looks like, and has patterns too. Spark scores the graph of patterns and instances
in rounds until nothing changes: a pattern is as good as the share of its instances that are known, given enough different
known ones; a candidate is as good as its patterns together, and a candidate above the bar counts as known in the next
round. Candidates that patterns of high confidence reach are added.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm.common import BATCH_ROWS, documents, materialise, row_key

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: Runs that can't be part of a longer match are not tried again, so each scan is linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+(?<=[0-9])")
#: Tokens that hold a digit or an at sign.
TOKEN = re.compile(r"\S*[0-9@]\S*")
EDGE = "\"'`.,;:!?()[]{}<>|*#$%&=…"
LOOSE = (
    ("email", re.compile(r"[^\s@]+@[^\s@]+|[^\s@]+[\[(](?:at|AT)[\])][^\s@]+")),
    ("ip", re.compile(r"(?:[0-9A-Fa-f]{1,4}[:.]){3,7}[0-9A-Fa-f]{1,4}(?:[:/][0-9]+)?")),
    ("card", re.compile(r"[0-9][0-9\x20-]{10,24}[0-9]")),
    ("phone", re.compile(r"[+(]?[0-9][0-9()./\x20-]{5,20}[0-9]")),
)
#: Whole runs of the loose forms that may have spaces; matches are held against LOOSE. None is tried again from its inside.
RUNS = (
    ("card", re.compile(r"(?<!\w)[0-9](?:[\x20-]*+[0-9])*+")),
    ("phone", re.compile(r"(?<!\w)[+(]?[0-9](?:[()./\x20-]*+[0-9])*+")),
)
#: A pattern needs so many different known instances and this confidence; a candidate this score.
SUPPORT, CONFIDENCE, KNOWN = 4, 0.8, 0.9


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of local part, at sign and domain; each at sign is looked at once."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Base identifiers of each kind: leftmost, not overlapping, without those that fail their test."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    if not any(d in text for d in "0123456789"):
        return found
    if "." in text:
        found["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found["phone"].append(m.span())
    return found


def _context(word: str) -> str:
    return re.sub(r"[0-9]+", "0", word.strip(EDGE).lower())


def _neighbours(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[list[str], str]]:
    """For each span the two words before it and the one after. A word that touches it goes no further than the next span."""
    tokens = [m.span() for m in re.finditer(r"\S+", text)]
    begins, starts, ends = [t[0] for t in tokens], sorted(s for s, _ in spans), sorted(e for _, e in spans)
    for s, e in spans:
        i = bisect_left(begins, s) - 1  # the last token that begins before the span
        before = []
        if i >= 0:
            at = bisect_right(ends, s)
            begin = max(begins[i], ends[at - 1] if at else 0)
            if begin < min(s, tokens[i][1]):
                before = [text[begin : min(s, tokens[i][1])]]
            if i > 0 and begin == begins[i]:
                before.insert(0, text[slice(*tokens[i - 1])])
        j = bisect_right(begins, e) - 1
        if j < 0 or tokens[j][1] <= e:
            j += 1
        after = ""
        if j < len(tokens):
            at = bisect_left(starts, e)
            after = text[max(e, begins[j]) : min(tokens[j][1], starts[at]) if at < len(starts) and starts[at] > max(e, begins[j]) else tokens[j][1]]
        yield before, after


def mentions(text: str, base: dict[str, list[tuple[int, int]]]) -> list[dict]:
    """Base identifiers and candidates, with the patterns around them."""
    spans = [(s, e, k, True) for k in KINDS for s, e in base[k]]
    taken = sorted((s, e) for s, e, _, _ in spans)
    at, found, loose, digits = 0, set(), dict(LOOSE), any(d in text for d in "0123456789")
    for m in TOKEN.finditer(text) if "@" in text or digits else ():
        s, e = m.span()
        token = m[0]
        cut = len(token) - len(token.lstrip(EDGE))
        s, token = s + cut, token.strip(EDGE)
        e = s + len(token)
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if not token or any(a < e for a, b in taken[at : at + 4] if b > s):
            continue
        found.update((s, e, k) for k, p in LOOSE if p.fullmatch(token))
    begin = 0
    for a, b in [*taken, (len(text), len(text))] if digits else ():  # what lies between base identifiers
        for kind, run in RUNS if a > begin else ():
            for m in run.finditer(text, begin, a):
                s, e = m.span()
                if not text[e : e + 1].isalnum() and loose[kind].fullmatch(m[0]):
                    found.add((s, e, kind))
        begin = max(begin, b)
    spans += [(*x, False) for x in sorted(found)]
    out = []
    for (s, e, kind, seed), (before, after) in zip(spans, _neighbours(text, [x[:2] for x in spans]) if spans else (), strict=True):
        near = [_context(w) for w in before]
        follows = _context(after)
        patterns = []
        if len(near) == 2 and all(near):
            patterns.append(f"{near[0]} {near[1]} _")
        if near and near[-1] and follows:
            patterns.append(f"{near[-1]} _ {follows}")
        out.append({"kind": kind, "start": s, "end": e, "instance": text[s:e], "seed": seed, "patterns": patterns})
    return out


MENTION = "struct<kind: string, start: int, end: int, instance: string, seed: boolean, patterns: array<string>>"


def find_mentions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, base (array of kind, start, end by kind, then start) and mentions of each row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            base, found = [], []
            for text in b["text"]:
                spans = base_spans(text or "")
                base.append([{"kind": k, "start": s, "end": e} for k in KINDS for s, e in spans[k]])
                found.append(mentions(text or "", spans))
            yield pd.DataFrame({"id": b["id"], "text_hash": b["text_hash"], "base": base, "mentions": found})

    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, text_hash long, base array<struct<kind: string, start: int, end: int>>, mentions array<{MENTION}>")


def discover(found: DataFrame) -> DataFrame:
    """Candidates that the bootstrapping accepts: row, kind, start, end, score. ``found`` has row and mentions."""
    each = found.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    pairs = each.select("kind", "instance", "seed", F.explode("patterns").alias("pattern"))
    edges = pairs.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed"))
    # only patterns with enough different instances can ever be sure of anything
    able = edges.groupBy("kind", "pattern").agg(F.count("*").alias("of")).where(F.col("of") >= SUPPORT)
    edges = materialise(edges.join(able.select("kind", "pattern"), ["kind", "pattern"], "left_semi"), "patterns")
    scores, before = None, -1
    while True:  # scores only rise, on a grid of 1e-6
        known = F.col("seed").cast("double")
        if scores is not None:
            known = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
        rated = (edges if scores is None else edges.join(scores, ["kind", "instance"], "left")).withColumn("known", known)
        share = rated.groupBy("kind", "pattern").agg(F.count_if(F.col("known") >= KNOWN).alias("n"), F.avg("known").alias("confidence"))
        sure = materialise(share.where((F.col("n") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)).select("kind", "pattern", "confidence"), "sure")
        score = F.round(1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))), 6)
        scores = materialise(edges.where("not seed").join(sure, ["kind", "pattern"]).groupBy("kind", "instance").agg(score.alias("score")), "scores")
        total = scores.agg(F.coalesce(F.sum(F.round(F.col("score") * 1e6).cast("long")), F.lit(0))).first()[0]
        if total <= before or not total:
            break
        before = total
    new = each.where("not seed").select("row", "kind", "start", "end", F.explode("patterns").alias("pattern"))
    return new.join(sure, ["kind", "pattern"]).groupBy("row", "kind", "start", "end").agg(F.max("confidence").alias("score"))


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every row: ``id_col``, base and spans (arrays of kind, start, end in code points, end exclusive), text_hash.

    Base and spans are sorted by kind (email, ip, card, phone), then start. ``spans`` holds the base and what patterns add. Null
    text is taken as empty and has none. Repeated rows stay and are handled alike. Texts are taken whole, in time about
    linear in their length; other columns play no part, whatever their names.
    """
    found = materialise(find_mentions(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "mentions")
    added = discover(found.where(F.size("mentions") > 0)).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    out = found.select("row", "id", "text_hash", "base").join(added, "row", "left")
    order = F.array(*map(F.lit, KINDS))
    spans = F.transform(
        F.array_sort(F.transform(F.concat("base", F.coalesce("added", F.array())), lambda s: F.struct(F.array_position(order, s["kind"]).alias("nth"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return out.select(F.col("id").alias(id_col), "base", F.array_distinct(spans).alias("spans"), "text_hash")


def mask(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replace the spans of each document by [KIND]; spans that overlap become one. ``spans``: what :func:`personal_data` gave for ``df``.

    Null texts stay null. A row is masked by the spans found in its own text: rows are met by id (null ids are alike) and
    text, so rows that repeat an id with other words keep theirs apart. Other columns pass through as Arrow.
    """
    key = "row key of mask"
    some = spans.where(F.size("spans") > 0).select(row_key(id_col, F.col("text_hash"), hashed=True).alias(key), "spans")
    some = some.groupBy(key).agg(F.first("spans").alias("spans_of_row"))  # rows alike have the same spans
    rows = df.withColumn(key, row_key(id_col, F.col(text_col))).join(some, key, "left")
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (w.slice(first, BATCH_ROWS) for w in batches for first in range(0, w.num_rows, BATCH_ROWS)):
            texts = [_masked(t, s) if t and s else t for t, s in zip(b.column(at).to_pylist(), b.column(len(df_columns)).to_pylist(), strict=True)]
            arrays = [pa.array(texts, b.schema.field(at).type) if i == at else b.column(i) for i in range(len(df_columns))]
            yield pa.RecordBatch.from_arrays(arrays, names=df_columns)

    df_columns = df.columns
    return rows.select(*[F.col(f"`{c}`") for c in df_columns], "spans_of_row").mapInArrow(run, df.schema)


def _masked(text: str, spans: list[dict]) -> str:
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= done:
            out += [text[done : s["start"]], f"[{s['kind'].upper()}]"]
        done = max(done, s["end"])
    return "".join([*out, text[done:]])


def _listed(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = personal_data(documents(spark, sf_dir))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
