"""Operator 13: fill-in-the-middle transformation with memoised content-defined chunks.

A rolling hash cuts a text into chunks at places that depend on the last 32 code points only, so passages that texts share
fall into the same chunks. For each chunk a summary is kept: how many units it has and whether it begins and ends inside a
word. A cache by content (a chunk is compared as a whole, not by its hash) makes the summary of a shared chunk once for
each worker. Counts of chunks add up, less one where a word goes on over a boundary, so the chunk in which a cut lies is
found from the counts, and only that chunk is looked through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm.common import documents

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many stay plain at least, and so many of the others get the suffix first.
PLAIN_FROM, SPM_BELOW = 90, 20
#: Chunks have 256 code points on average, no fewer than 64 and no more than 2,048.
MASK, LEAST, MOST = 0xFF000000, 64, 2048
#: Code points that a worker's cache holds at most; past that it starts anew.
CACHE_CHARS = 8_000_000
#: Rows that are worked on at once.
ROWS = 1_000


def boundaries(text: str) -> list[int]:
    """Ends of the content-defined chunks of a text, the last one at its end."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    for step in (1, 2, 4, 8, 16):  # sum of the last 2 * step values, each shifted by its age
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(step)
        h = h + shifted
    out, last = [], 0
    for at in (np.flatnonzero((h & np.uint32(MASK)) == 0) + 1).tolist():
        while at - last > MOST:
            last += MOST
            out.append(last)
        if at - last >= LEAST:
            out.append(at)
            last = at
    while n - last > MOST:
        last += MOST
        out.append(last)
    if n > last:
        out.append(n)
    return out


def _letter(c: str) -> bool:
    return "A" <= c <= "Z" or "a" <= c <= "z"


class ChunkCache:
    """Summaries of chunks by their content: units, whether the first and the last code point are letters."""

    def __init__(self, limit: int = CACHE_CHARS):
        self.limit, self.chars, self.hits, self.known = limit, 0, 0, {}

    def summary(self, chunk: str) -> tuple[int, bool, bool]:
        found = self.known.get(chunk)
        if found is not None:
            self.hits += 1
            return found
        found = len(UNIT.findall(chunk)), _letter(chunk[0]), _letter(chunk[-1])
        if self.chars + len(chunk) > self.limit:
            self.known.clear()
            self.chars = 0
        self.known[chunk] = found
        self.chars += len(chunk)
        return found


class Units:
    """The units of one text, by its chunks."""

    def __init__(self, text: str, cache: ChunkCache):
        self.text = text
        self.ends = boundaries(text)
        self.starts = [0, *self.ends][:-1]
        summaries = [cache.summary(text[a:b]) for a, b in zip(self.starts, self.ends, strict=True)]
        #: Whether the first unit of a chunk began before it.
        self.goes_on = [i > 0 and summaries[i - 1][2] and s[1] for i, s in enumerate(summaries)]
        self.begun = list(accumulate(s[0] - g for s, g in zip(summaries, self.goes_on, strict=True)))
        self.n = self.begun[-1] if self.begun else 0

    def cut(self, units: int) -> int:
        """Where the first ``units`` units end."""
        if units >= self.n:
            return len(self.text)
        i = int(np.searchsorted(self.begun, units, side="right"))  # the chunk in which unit number ``units`` (from 0) begins
        nth = units - (self.begun[i - 1] if i else 0) + self.goes_on[i]
        for k, m in enumerate(UNIT.finditer(self.text, self.starts[i], self.ends[i])):
            if k == nth:
                return m.start()
        raise AssertionError("counts of chunks don't add up")


def arrange(text: str, h: tuple[int, int, int, int], cache: ChunkCache) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, and the output of a text."""
    units = Units(text, cache)
    if not text or h[2] % 100 >= PLAIN_FROM or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return units.n, "plain", None, None, text
    first, second = sorted((h[0] % (units.n + 1), h[1] % (units.n + 1)))
    a, b = units.cut(first), units.cut(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < SPM_BELOW:
        return units.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return units.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """Each text with its middle moved to the end: ``id_col``, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output.

    A unit is a run of A-Z and a-z or one other code point. The cuts and the form come from the sha256 of ``seed:id``; a
    null id counts as an empty text there. Texts that are empty (or null), hold a mark of the form or are drawn as plain
    stay as they are, with null lengths. Repeated rows stay and are handled alike; an empty table gives an empty one;
    other columns play no part, whatever their names. Texts are taken whole, in time about linear in their length.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.substring(digest, 1, 32).alias("h"))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ChunkCache()
        for b in (w.slice(at, ROWS) for w in batches for at in range(0, w.num_rows, ROWS)):
            out = [
                arrange(text, tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24)), cache)
                for text, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            ]
            n, form, prefix, middle, output = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, b.schema.field(1).type)],
                names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    out = rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(output: str | Column, form: str | Column) -> Column:
    """The text that an output of this form was made of."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def between(a: str, b: str) -> Column:
        start, end = F.locate(a, output) + len(a), F.locate(b, output)
        return F.substring(output, start, end - start)

    middle = F.substring(output, F.locate(MIDDLE, output) + len(MIDDLE), F.char_length(output))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a fill-in-the-middle example, and the text rebuilt from it."""
    found = fill_in_middle(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored("output", "form").cast("binary"), 256).alias("restored_sha256"),
    )


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:n], '') AS z FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE text END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
