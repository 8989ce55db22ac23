"""Operator 9: byte-level BPE by a tokenization automaton.

The merges are compiled, in rank order, into a deterministic automaton over tokens: its paths
are exactly the token sequences that the merges can give. Before any merge it has one state with
a loop for each byte. The gadget for a merge (a, b) -> c changes it in three ways:

* the state after ``a`` is split off (copied), so that only ``a`` leads to the copy;
* the copy loses its arc ``b``, because ``a b`` may no longer stand there;
* wherever ``a`` could be followed by ``b``, an arc ``c`` leads to the state after ``b``.

A state is thus named by the last token, and a copy differs from its original by the arcs it
lost and the rank at which it lost them. Copies are kept as those differences: ``lost[a, b]`` is
the rank of the loss; the state of ``c`` starts as the state of ``b`` at the rank of ``c``, and
an arc ``c`` stood or fell with ``a`` when it was added. An arc of the resulting table is worked
out from these on first use and then kept.

Each prefix of a word has exactly one path, so the encoding of a word is found left to right by
following arcs of the vocabulary's trie, one live state at each position. Decoding emits the arc
labels.

Texts that are null are taken as empty. A special token's string in a text becomes its id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm.common import documents

#: The pattern that splits text ahead of the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose encoding a worker keeps; older ones make place.
CACHE_WORDS = 250_000
CACHE_ARCS = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """The compiled automaton. ``labels``: the bytes of each id."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], specials: dict[str, int]):
        self.labels, self.specials = labels, specials
        self.lost: dict[tuple[int, int], int] = {}
        self.born: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        made = {t for _, _, t in merges}
        loops = {t for t in labels if len(labels[t]) == 1 and t not in made}
        for rank, (a, b, c) in enumerate(merges):
            self._gadget(rank, a, b, c)
        plain = [t for t in labels if t in self.born or t in loops]
        #: Trie of the arc labels: each prefix, with the token that ends there or -1.
        self.trie: dict[bytes, int] = {}
        for t in plain:
            for n in range(1, len(labels[t])):
                self.trie.setdefault(labels[t][:n], -1)
        for t in plain:
            self.trie[labels[t]] = t
        self._reset()

    def _reset(self) -> None:
        self.arcs: dict[int, bool] = {}
        self.words: tuple[dict, dict] = ({}, {})
        top = max(self.labels) + 1
        self.label = [self.labels.get(t, b"") for t in range(top)]
        self.packed = [t.to_bytes(4, "little") for t in range(top)]
        self.split = regex.compile(PATTERN)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("labels", "specials", "lost", "born", "parts", "trie")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    def _gadget(self, rank: int, a: int, b: int, c: int) -> None:
        """Split the state after ``a``, drop its arc ``b``, add the arc ``c`` to the state after ``b``."""
        if any(len(self.labels[t]) > 1 and t not in self.born for t in (a, b)) or not self._work_out(a, b):
            return  # the pair can't stand, so this merge never applies
        self.lost[a, b] = rank
        if c not in self.born:
            self.born[c], self.parts[c] = rank, (a, b)

    def arc(self, last: int, token: int) -> bool:
        """Work out whether the state after ``last`` has an arc ``token``, and keep it in the table."""
        found = self._work_out(last, token)
        if len(self.arcs) >= CACHE_ARCS:
            self.arcs.clear()
        self.arcs[last << 20 | token] = found
        return found

    def _work_out(self, last: int, token: int) -> bool:
        lost, parts, born = self.lost, self.parts, self.born
        state, until = last, 1 << 60  # losses of a state before it was copied for the next one
        while True:
            arc, by = token, 1 << 60  # an arc that was lost when it was to be extended
            while True:
                at = lost.get((state, arc))
                if at is not None and at < until and at <= by:
                    return False
                if arc not in parts:
                    break
                by, arc = born[arc], parts[arc][0]
            if state not in parts:
                return True
            until, state = min(until, born[state]), parts[state][1]

    def word(self, text: bytes) -> list[int]:
        """The ids of one pre-split word.

        Follows the longest arc first. A position that a path reaches has one path only, so one that leads nowhere
        is closed for good and the walk is linear in the length.
        """
        trie, arcs, n = self.trie, self.arcs, len(text)
        ids: list[int] = []
        begins: list[int] = []
        closed: set[int] = set()
        at, most = 0, n
        while at < n:
            ends = []
            for j in range(at + 1, most + 1):
                token = trie.get(text[at:j])
                if token is None:
                    break
                if token >= 0 and j not in closed:
                    ends.append((j, token))
            while ends:
                j, token = ends.pop()
                if not ids:
                    break
                known = arcs.get(ids[-1] << 20 | token)
                if known or known is None and self.arc(ids[-1], token):
                    break
            else:
                closed.add(at)
                ids.pop()
                at, most = begins.pop(), at - 1
                continue
            ids.append(token)
            begins.append(at)
            at, most = j, n
        return ids

    def _encoded(self, word: str) -> bytes:
        pack = self.packed
        return b"".join([pack[t] for t in self.word(word.encode())])

    def _remember(self, text: str, packed: bytes) -> None:
        if len(text) <= 48:
            if len(self.words[0]) >= CACHE_WORDS:
                self.words = ({}, self.words[0])
            self.words[0][text] = packed

    def _words(self, text: str) -> bytes:
        """Encode text by the pattern's words. Those that start with a space share their entries with the pieces."""
        out = []
        for w in self.split.findall(text):
            key = w[1:] if w[0] == " " and len(w) > 1 else None
            found = key and (self.words[0].get(key) or self.words[1].get(key))
            if not found:
                found = self._encoded(w)
                if key and not key.isspace():
                    self._remember(key, found)
            out.append(found)
        return b"".join(out)

    def _pieces(self, text: str) -> bytes:
        """Encode text by its pieces between single spaces: a space between two visible characters always starts a word."""
        pieces = text.split(" ")
        out = []
        add, get, first = out.append, self.words[0].get, True
        for p in pieces:
            found = get(p)
            if found is None or first:
                if not p or p[0].isspace() or p[-1].isspace():
                    return self._words(text)
                if first:  # no space ahead of it
                    add(self._words(p))
                    first = False
                    continue
                found = self.words[1].get(p)
                if found is None:
                    found = self._encoded(" " + p) if p.isalpha() else self._words(" " + p)
                self._remember(p, found)
                get = self.words[0].get
            add(found)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not any(s in text for s in self.specials):
            return self._pieces(text)
        out = []
        for piece in self.special_split.split(text):
            if piece in self.specials:
                out.append(self.packed[self.specials[piece]])
            elif piece:
                out.append(self._pieces(piece))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """The text of packed ids."""
        return b"".join(map(self.label.__getitem__, np.frombuffer(packed, dtype="<u4").tolist())).decode("utf-8", errors="replace")


def compile_automaton(vocabulary: str) -> Automaton:
    """Compile the automaton of a byte-level BPE vocabulary file; it holds 50,000 merges, so it can be broadcast."""
    with open(vocabulary, encoding="utf-8") as f:
        given = json.load(f)
    byte_of = byte_alphabet()
    vocab = given["model"]["vocab"]
    labels = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if all(c in byte_of for c in t)}
    merges = []
    for m in given["model"]["merges"]:
        a, b = m if isinstance(m, list) else m.split(" ")
        merges.append((vocab[a], vocab[b], vocab[a + b]))
    specials = {t["content"]: t["id"] for t in given.get("added_tokens", [])}
    return Automaton(labels | {i: s.encode() for s, i in specials.items()}, merges, specials)


def encode_decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Encode every text and decode the ids again.

    Returns ``id_col``, ``ids`` (binary: little-endian unsigned 32-bit ids) and ``decoded`` (string), a row for
    each row of ``df``; repeated rows stay repeated. Null text is taken as empty and gives no ids. With
    ``keep_text`` the text comes too.
    """
    shared = df.sparkSession.sparkContext.broadcast(compile_automaton(vocabulary))
    kept = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = shared.value
        for b in batches:
            ids = [automaton.encode(t or "") for t in b["t"]]
            out = pd.DataFrame({"k": b["k"], "ids": ids, "decoded": [automaton.decode(x) for x in ids]})
            yield out.assign(t=b["t"]) if keep_text else out

    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    out = rows.mapInPandas(run, f"k {kept}, ids binary, decoded string" + ", t string" * keep_text)
    return out.withColumnsRenamed({"k": id_col, "t": text_col})


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every document, as digests."""
    import public_tokenizers

    out = encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
