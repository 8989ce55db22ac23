"""Operator 5: licence scan by sparse TF-IDF cosine to templates, with inheritance from the nearest directory above.

Each line of a file, each run of 2, 4 and 8 lines (headers are wrapped) and its whole text are compared with the templates. The document frequency of every term is counted
over all files. A unit vector that has none of the words which carry more than 1 - bar^2 of a template's square sum can't
reach the bar, so a line or text without any such word is not compared. Words that no template has only lengthen a vector, so
lines that miss the bar even where these have the least weight are left out too; the rest are joined with the frequencies of
their terms. A licence with versions is reported by its family unless just one of the numbers is there. Files without a licence of their own take
that of the nearest directory above them that holds a licence file. Directories are joined by path, once each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm.common import documents, materialise

#: Whole licence texts, without their copyright lines.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_ENDORSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Fixed value: the header that the GNU licences give, for a name and a version.
GNU_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the
Free Software Foundation, either version {} of the License, or (at your option) any later version."""
GNU_REST = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details. You should have received a copy of the GNU {}
along with this program. If not, see <https://www.gnu.org/licenses/>."""
GPL, LGPL, AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
APACHE_REST = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
MPL_REST = "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."


def gnu(name: str, version: str) -> list[str]:
    """Title, header, and header with its disclaimer."""
    header = GNU_HEADER.format(name, version)
    return [f"GNU {name}, version {version}.", header, f"{header} {GNU_REST.format(name, name)}"]


#: Short texts by which licences are named in headers, and whole ones.
TEMPLATES = {
    "AGPL-3.0": gnu(AGPL, "3"),
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        APACHE, f"{APACHE} {APACHE_REST}", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ],
    "BSD-2-Clause": [f"{BSD_TERMS} {BSD_DISCLAIMER}"],
    "BSD-3-Clause": [f"{BSD_TERMS} {BSD_ENDORSE} {BSD_DISCLAIMER}", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": gnu(GPL, "2"),
    "GPL-3.0": [*gnu(GPL, "3"), "This program is free software: you can redistribute it under the terms of the GNU General Public License, version 3."],
    "ISC": [ISC],
    "LGPL-2.1": gnu(LGPL, "2.1"),
    "LGPL-3.0": gnu(LGPL, "3"),
    "MIT": [MIT, "Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "MPL-2.0": [MPL, f"{MPL} {MPL_REST}"],
}
#: Licences whose versions have the same words: family and how the version is written.
VERSIONS = {"GPL-2.0": ("GPL", ("2", "2.0", "v2")), "GPL-3.0": ("GPL", ("3", "3.0", "v3")), "LGPL-2.1": ("LGPL", ("2.1", "v2.1")), "LGPL-3.0": ("LGPL", ("3", "3.0", "v3"))}
#: Lengths of the runs of lines.
RUNS = (1, 2, 4, 8)
TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
PIECES = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
THRESHOLD = 0.7
FLUSH, PART = 150_000, 20_000
#: Parts of a large directory in a join.
SALTS = 16


def terms_of(text: str) -> Counter:
    return Counter(TERM.findall(text.lower()))


def pieces_of(low: str) -> list[bytes]:
    """Runs of letters and digits of a lower-case text: terms, cut at their points."""
    return low.encode("utf-8", "surrogatepass").translate(PIECES).split()


class Templates:
    """Normalised template vectors. ``df`` has the files of each template word, ``files`` is their number."""

    def __init__(self, df: dict[str, int], files: int, threshold: float):
        self.files, self.needed = files, set()
        self.idf = {t: self.weight(df.get(t, 0)) for t in vocabulary()}
        self.vectors = []
        for name, texts in sorted(TEMPLATES.items()):
            for text in texts:
                w = {t: (1 + math.log(n)) * self.idf[t] for t, n in terms_of(text).items()}
                size = math.sqrt(math.fsum(x * x for x in w.values()))
                unit = {t: x / size for t, x in w.items()}
                self.vectors.append((name, unit))
                left = 1.0
                for t in sorted(unit, key=lambda t: (-unit[t], t)):  # without these words no unit vector reaches the bar
                    if left < (threshold - 1e-9) ** 2:
                        break
                    self.needed.add(t)
                    left -= unit[t] ** 2
        self.pieces = {p.encode() for t in self.needed for p in t.split(".")[:1]}
        self.of: dict[str, list[tuple[int, float]]] = {}
        for i, (_, v) in enumerate(self.vectors):
            for t, x in v.items():
                self.of.setdefault(t, []).append((i, x * x))
        self.least = (threshold - 1e-9) ** 2

    def squares(self, terms: dict[str, int]) -> list[float]:
        """Sum of each template's squares at these terms. The cosine of a unit vector of them is at most its root."""
        shared = [0.0] * len(self.vectors)
        for t in terms:
            for i, x in self.of.get(t, ()):
                shared[i] += x
        return shared

    def runs(self, lines: list[Counter]) -> Iterator[tuple[int, int, Counter]]:
        """First line (from 0), length and terms of the runs of lines that can reach the bar: squares of lines add up to no less than the run's."""
        total = np.zeros((len(lines) + 1, len(self.vectors)))
        for i, terms in enumerate(lines):
            total[i + 1] = total[i] + self.squares(terms)
        for size in RUNS:
            if size > len(lines):
                break
            sums = total[size:] - total[:-size]
            for i in np.flatnonzero(sums.max(axis=1) >= self.least - 1e-9):
                yield int(i), size, sum(lines[i + 1 : i + size], lines[i].copy())

    def weight(self, df: int) -> float:
        return math.log((1 + self.files) / (1 + df)) + 1

    def best(self, terms: dict[str, int], df: dict[str, int] | None = None) -> tuple[float, str | None]:
        """Highest cosine and its licence, the earlier name on a tie. Of a family's versions it is the one whose number is there; the family without one or with several.

        ``df``: files of each word that no template has.
        Without ``df`` these words weigh what a word of every file does, the least there is: no cosine is higher than that.
        """
        if max(self.squares(terms)) < self.least:
            return 0.0, None
        w = {t: (1 + math.log(n)) * (self.idf[t] if t in self.idf else 1.0 if df is None else self.weight(df[t])) for t, n in terms.items()}
        size = math.sqrt(math.fsum(x * x for x in w.values()))
        found = [(math.fsum(x * w.get(t, 0.0) for t, x in v.items()) / size, name) for name, v in self.vectors]
        cosine = max(c for c, _ in found)
        name = next(name for c, name in found if c >= cosine - 1e-12)
        if name not in VERSIONS:
            return cosine, name
        family = VERSIONS[name][0]
        said = [n for n, (f, written) in VERSIONS.items() if f == family and any(v in terms for v in written)]
        return cosine, said[0] if len(said) == 1 else family


def vocabulary() -> list[str]:
    return sorted({t for texts in TEMPLATES.values() for text in texts for t in terms_of(text)})


def document_frequencies(rows: DataFrame) -> DataFrame:
    """term, df: in how many rows (text) each term is that more than one row has, or a template; '' has their number."""
    words = vocabulary()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for b in batches:
            for text in b["text"]:
                n[""] += 1
                n.update(set(TERM.findall((text or "").lower())))
                if len(n) > FLUSH:  # part counts go out early, so memory stays bounded
                    yield from parts(n)
                    n = Counter()
        yield from parts(n)

    def parts(n: Counter) -> Iterator[pd.DataFrame]:
        names = list(n)
        for i in range(0, len(names), PART):
            yield pd.DataFrame({"term": names[i : i + PART], "n": [n[t] for t in names[i : i + PART]]})

    counts = rows.select("text").mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))
    return materialise(counts.where((F.col("df") > 1) | F.col("term").isin("", *words)), "terms")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Licence of each file's own text: path, license (null: none), cosine, line (from 1; 0: whole text), lines (how many) and n_words.

    The best run of lines or the whole text counts, on a tie a run before the whole, the shorter and then the earlier one. Null or empty text has no licence. Repeated rows stay
    and are handled alike; long texts are taken whole; other columns play no part, whatever their names.
    """
    rows = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    frequencies = document_frequencies(rows)
    counts = {r["term"]: r["df"] for r in frequencies.where(F.col("term").isin("", *vocabulary())).collect()}
    templates = Templates(counts, counts.get("", 0), threshold)
    shared = files.sparkSession.sparkContext.broadcast(templates)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = shared.value
        for b in batches:
            out = []
            for path, text in zip(b["path"], b["text"], strict=True):
                found, text = [], text or ""
                low = text.lower()
                if not templates.pieces.isdisjoint(pieces_of(low)):
                    lines = [terms_of(x) for x in low.split("\n")]
                    whole = [(-1, len(lines), terms_of(low))] if len(lines) > 1 else []
                    for i, size, terms in chain(templates.runs(lines), whole):
                        if templates.best(terms)[0] >= threshold - 1e-9:
                            found.append({"line": i + 1, "lines": size, "bag": " ".join(f"{t}:{n}" for t, n in sorted(terms.items()))})
                out.append((path, found, len(text.split())))
            yield pd.DataFrame(out, columns=["path", "found", "n_words"])

    # lines and texts that reach the bar if every other word has the least weight; equal ones are compared once
    given = rows.mapInPandas(find, "path string, found array<struct<line: int, lines: int, bag: string>>, n_words long")
    given = materialise(given.withColumn("row", F.monotonically_increasing_id()), "lines")
    each = given.select("row", F.explode("found").alias("c")).select("row", "c.*")
    terms = each.select("bag").distinct().select("bag", F.explode(F.split("bag", " ")).alias("t")).select("bag", F.split("t", ":")[0].alias("term"))
    known = terms.join(frequencies, "term", "left").groupBy("bag").agg(F.map_from_entries(F.collect_list(F.struct("term", F.coalesce("df", F.lit(1)).alias("df")))).alias("df"))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = shared.value
        for b in batches:
            got = [templates.best({t: int(n) for t, n in (x.split(":") for x in bag.split(" "))}, dict(df)) for bag, df in zip(b["bag"], b["df"], strict=True)]
            yield pd.DataFrame({"bag": b["bag"], "cosine": [g[0] for g in got], "license": [g[1] for g in got]})

    hits = known.mapInPandas(match, "bag string, cosine double, license string").where(F.col("cosine") >= threshold)
    first = F.struct(F.negative("cosine"), F.col("line") == 0, "lines", "line")
    best = each.join(hits, "bag").groupBy("row").agg(F.min_by(F.struct("license", "cosine", "line", "lines"), first).alias("best"))
    return materialise(given.join(best, "row", "left").select("path", "best.license", "best.cosine", "best.line", "best.lines", "n_words"), "scanned")


def inherit(scanned: DataFrame, is_license_file: Column) -> DataFrame:
    """Add origin (own, inherited or null) and from_dir, and fill license from the nearest directory above.

    A directory's licence is that of the licence file in it with the highest cosine, then the smallest path. A path
    without a slash is in the top directory, named by the empty string. Files join the distinct directories by directory and a
    salt, so that one with a great part of all files is the work of many tasks. An empty table gives an empty one.
    """
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    files = scanned.withColumn("dir", F.coalesce(folder, F.lit("")))
    given = files.where(is_license_file & F.col("license").isNotNull()).groupBy("dir").agg(F.min_by("license", F.struct(F.negative("cosine"), "path")).alias("dir_license"))
    steps = F.split("dir", "/")
    above = files.select("dir").distinct().select("dir", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth"))
    above = above.withColumn("at", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/"))
    nearest = above.join(given.withColumnRenamed("dir", "at"), "at").groupBy("dir").agg(F.max_by(F.struct("dir_license", F.col("at").alias("from_dir")), "depth").alias("up"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = files.withColumn("salt", F.pmod(F.xxhash64("path", "n_words"), F.lit(SALTS)).cast("int"))
    out = salted.join(nearest.withColumn("salt", salts), ["dir", "salt"], "left")
    own = F.col("license").isNotNull()
    return out.select(
        "path", F.coalesce("license", "up.dir_license").alias("license"), F.when(own, "own").when(F.col("up").isNotNull(), "inherited").alias("origin"),
        F.when(~own, F.col("up.from_dir")).alias("from_dir"), "cosine", "line",
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, as files named source / language / id; short ones with a licence are licence files."""
    files = documents(spark, sf_dir).select(F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.col("doc_id").cast("string")).alias("path"), "text")
    out = inherit(scan(files), F.col("n_words") <= 60)
    return out.select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), "license", "origin", "from_dir", F.round("cosine", 6).alias("cosine"), "line")
