"""Operator 12: document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

A text is a set of paragraph digests: its lines, long ones cut after a sentence. A sketch has three rows of cells; each
digest is added to one cell of each row, and a cell keeps a count, the exclusive or of its digests and that of their
checksums. Subtracting two sketches cancels what the texts share. A cell that is left with one digest gives it away; taking
it out of its other cells opens more of them (peeling), until nothing is left or nothing opens.

The fingerprint is one small sketch, enough for a few changed paragraphs. Where peeling it fails, larger sketches are made
from the digests: one for each bucket of about two digests, in rows of 16 cells; the digests of buckets that fail again get
rows of 64 and then 512. Cells of buckets are rows that Spark sums up, so work and memory are linear in the length of a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fundtrace.llm.common import documents, materialise, row_key

#: A paragraph: 96 code points of a line, then up to 64 more to the end of a sentence, and the marks and breaks there.
PARAGRAPH = r"[^\n]{1,96}[^\n.!?]{0,64}[.!?\n]*|\n+"
#: Cells in each of the three rows of a fingerprint; of a bucket; of a bucket that failed.
FINGERPRINT, BUCKET, RETRIES = 4, 16, (64, 512)
#: Digests of a bucket, about.
LOAD = 2
#: Rounds of peeling. Each takes out all digests that cells give away, so few are needed.
PEELS = 16


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({PARAGRAPH})"), F.lit(1)), lambda p: F.xxhash64(p)))


def _spot(key: Column, width: int) -> Column:
    """Cell numbers of a digest in the three rows, packed: each row takes bits of its own."""
    return F.xxhash64(key, F.lit(width))


def _hits(spot: Column, shift: Column, place: Column, width: int) -> Column:
    """Whether a digest belongs to the cell at ``place`` of the row that takes the bits from ``shift``."""
    return F.call_function("shiftright", spot, shift).bitwiseAND(F.lit(width - 1).cast("long")) == place


def sketch(keys: Column, width: int) -> Column:
    """Cells (shift, place, n, key, sum) of a sketch of digests, row by row, empty ones too."""
    return _cells(F.transform(keys, lambda k: F.struct(F.lit(1).alias("sign"), k.alias("key"))), width)


def _cells(signed: Column, width: int) -> Column:
    bits = width.bit_length() - 1
    each = F.transform(signed, lambda k: F.struct(k["sign"].alias("sign"), k["key"].alias("key"), F.hash(k["key"]).alias("sum"), _spot(k["key"], width).alias("spot")))
    at = lambda i: (F.shiftright(i, bits) * bits, i.bitwiseAND(F.lit(width - 1)).cast("long"))
    blank = {"n": F.lit(0), "key": F.lit(0).cast("long"), "sum": F.lit(0)}
    empty = F.transform(F.sequence(F.lit(0), F.lit(3 * width - 1)), lambda i: F.struct(at(i)[0].alias("shift"), at(i)[1].alias("place"), *[v.alias(c) for c, v in blank.items()]))
    fill = lambda c, ks: F.aggregate(ks, c, lambda x, k: F.when(_hits(k["spot"], x["shift"], x["place"], width), _added(x, k, 1)).otherwise(x))
    return _let(each, lambda ks: F.transform(empty, lambda c: fill(c, ks)))


def _added(c: Column, k: Column, times: int) -> Column:
    return F.struct(c["shift"].alias("shift"), c["place"].alias("place"), (c["n"] + k["sign"] * times).alias("n"), c["key"].bitwiseXOR(k["key"]).alias("key"), c["sum"].bitwiseXOR(k["sum"]).alias("sum"))


def subtract(a: Column, b: Column) -> Column:
    """Cells of one sketch less those of another of the same width."""
    return F.zip_with(a, b, lambda x, y: F.struct(x["shift"].alias("shift"), x["place"].alias("place"), (x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["sum"].bitwiseXOR(y["sum"]).alias("sum")))


def peel(cells: Column, width: int) -> Column:
    """Digests (sign, key) that the cells of a difference give away; null if some are left that don't come out."""
    found = "array<struct<sign: int, key: bigint, sum: int, spot: bigint>>"
    full = lambda cs: F.filter(cs, lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["sum"] != 0))
    start = F.struct(full(cells).alias("cells"), F.array().cast(found).alias("open"), F.array().cast(found).alias("out"))

    def opened(s: Column) -> Column:
        pure = F.filter(s["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["sum"] == F.hash(c["key"])))
        each = F.transform(pure, lambda c: F.struct(c["n"].alias("sign"), c["key"].alias("key"), c["sum"].alias("sum"), _spot(c["key"], width).alias("spot")))
        return F.struct(s["cells"].alias("cells"), F.array_distinct(each).alias("open"), s["out"].alias("out"))

    def taken(s: Column) -> Column:
        rest = F.transform(
            s["cells"],
            lambda c: F.aggregate(s["open"], c, lambda x, k: F.when(_hits(k["spot"], x["shift"], x["place"], width), _added(x, k, -1)).otherwise(x)),
        )
        return F.struct(full(rest).alias("cells"), s["open"].alias("open"), F.concat(s["out"], s["open"]).alias("out"))

    step = lambda s, t: F.when(F.size(s["cells"]) == 0, s).when(t % 2 == 1, opened(s)).when(F.size(s["open"]) == 0, s).otherwise(taken(s))
    out = lambda s: F.when(F.size(s["cells"]) == 0, F.transform(s["out"], lambda k: F.struct(k["sign"].alias("sign"), k["key"].alias("key"))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * PEELS)), start, step, out)


def as_text(cells: Column) -> Column:
    """A sketch as text: count (4 hex digits, or as many as it takes), digests (16) and checksums (8) of its cells in order."""
    # hex of a negative number has 16 digits; a longer count than four digits keeps all of them
    def cell(c: Column) -> Column:
        count = F.lower(F.hex(c["n"].cast("long")))
        return F.concat(F.when(F.length(count) < 4, F.lpad(count, 4, "0")).otherwise(count), F.lpad(F.lower(F.hex(c["key"])), 16, "0"), F.lpad(F.substring(F.lower(F.hex(c["sum"].cast("long"))), -8, 8), 8, "0"))

    return F.array_join(F.transform(cells, cell), "")


def _opened(cells: Column) -> Column:
    """Digests of a bucket's cells: if each cell of the first row gives one away, those are all; else by peeling."""
    first = F.filter(cells, lambda c: c["shift"] == 0)
    pure = lambda c: (F.abs(c["n"]) == 1) & (c["sum"] == F.hash(c["key"]))
    plain = lambda cs: F.when((F.size(cs) > 0) & F.forall(cs, pure), F.transform(cs, lambda c: F.struct(c["n"].alias("sign"), c["key"].alias("key"))))
    return F.coalesce(_let(first, plain), peel(cells, BUCKET))


def _retried(signed: Column) -> Column:
    """Digests of a difference by ever wider sketches; in the end, by the digests as they are."""
    alone = F.filter(signed, lambda k: F.size(F.filter(signed, lambda o: o["key"] == k["key"])) == 1)
    return F.coalesce(*[peel(_cells(signed, width), width) for width in RETRIES], alone)


def differences(rows: DataFrame, key: str, pairs: dict[str, tuple[str, str]], carry: list[str]) -> DataFrame:
    """What differs between pairs of digest arrays: ``key``, ``carry`` and for each pair ``<name>_lost``, ``<name>_new`` (arrays of digests).

    ``rows`` has a row for each value of ``key``. Rows stay where they are if they are partitioned by ``key``.
    """
    cases = [F.struct(F.lit(i).alias("pair"), F.col(a).alias("a"), F.col(b).alias("b")) for i, (a, b) in enumerate(pairs.values())]
    wide = F.struct(*[F.col(c) for c in carry])
    # outer: nothing is empty here, but a plain explode works its argument out once more in a filter
    each = rows.select(key, wide.alias("wide"), F.explode_outer(F.array(*cases)).alias("c")).select(key, F.when(F.col("c.pair") == 0, F.col("wide")).alias("wide"), "c.*")
    each = each.withColumn("out", peel(subtract(sketch(F.col("a"), FINGERPRINT), sketch(F.col("b"), FINGERPRINT)), FINGERPRINT))
    each = each.withColumn("buckets", F.ceil((F.size("a") + F.size("b")) / F.lit(float(LOAD))))
    bucket = lambda k: F.pmod(F.xxhash64(k), F.col("buckets"))

    def side(column: str, sign: int) -> Column:
        return F.transform(column, lambda k: F.struct(bucket(k).alias("bucket"), F.lit(sign).alias("sign"), k.alias("key")))

    # the first row of each pair has no digest and keeps what the small sketch gave and, if that failed, the digests
    none = F.array(F.struct(F.lit(-1).cast("long").alias("bucket"), F.lit(0).alias("sign"), F.lit(0).cast("long").alias("key")))
    dealt = each.withColumn("e", F.when(F.col("out").isNull(), F.concat(none, side("a", 1), side("b", -1))).otherwise(none))
    dealt = dealt.select(key, "pair", "wide", "out", "buckets", "a", "b", F.explode_outer("e").alias("e"))
    failed = F.col("out").isNull()
    kept = F.struct("wide", "out", "buckets", *[F.when(failed, F.col(c)).alias(c) for c in ("a", "b")])
    dealt = dealt.select(key, "pair", F.when(F.col("e.bucket") < 0, kept).alias("kept"), "e.bucket", "e.sign", F.col("e.key").alias("digest"))
    bits = BUCKET.bit_length() - 1
    cells = [F.struct(F.lit(r * bits).alias("shift"), F.shiftright("spot", r * bits).bitwiseAND(F.lit(BUCKET - 1).cast("long")).alias("place")) for r in range(3)]
    dealt = dealt.withColumn("spot", _spot(F.col("digest"), BUCKET)).withColumn("cell", F.explode_outer(F.array(*cells)))
    dealt = dealt.select(key, "pair", "bucket", "kept", "cell.*", "sign", "digest").where("bucket >= 0 OR shift = 0")
    added = [F.sum("sign").cast("int").alias("n"), F.bit_xor("digest").alias("key"), F.bit_xor(F.hash("digest")).alias("sum")]
    each_cell = dealt.groupBy(key, "pair", "bucket", "kept", "shift", "place").agg(*added).where("bucket < 0 OR n <> 0 OR key <> 0 OR sum <> 0")
    each_cell = each_cell.select(F.col(key), "pair", "bucket", "kept", F.struct("shift", "place", "n", "key", "sum").alias("cell"))
    met = each_cell.groupBy(key, "pair", "bucket", "kept").agg(F.collect_list("cell").alias("cells"))
    met = met.select(key, "pair", "bucket", "kept", F.when(F.col("bucket") >= 0, _opened(F.col("cells"))).alias("out"))
    columns = [F.max(F.when(F.col("pair") == i, F.col("kept"))).alias(f"kept{i}") for i in range(len(pairs))]
    met = met.groupBy(key).agg(*columns, F.collect_list(F.when(F.col("bucket") >= 0, F.struct("pair", "bucket", "out"))).alias("outs"))

    def found(i: int) -> Column:
        own = F.filter("outs", lambda o: o["pair"] == i)
        left = F.transform(F.filter(own, lambda o: o["out"].isNull()), lambda o: o["bucket"])
        come = F.flatten(F.transform(F.filter(own, lambda o: o["out"].isNotNull()), lambda o: o["out"]))
        of = lambda column, sign, which: F.transform(
            F.filter(F.col(f"kept{i}.{column}"), lambda k: F.array_contains(which, F.pmod(F.xxhash64(k), F.col(f"kept{i}.buckets")))), lambda k: F.struct(F.lit(sign).alias("sign"), k.alias("key"))
        )
        again = _let(left, lambda w: F.when(F.size(w) > 0, _let(F.concat(of("a", 1, w), of("b", -1, w)), _retried)).otherwise(F.array().cast("array<struct<sign: int, key: bigint>>")))
        return F.coalesce(F.col(f"kept{i}.out"), F.concat(come, again))

    out = met.select(key, "kept0.wide.*", *[found(i).alias(f"found{i}") for i in range(len(pairs))])

    def of_sign(column: str, sign: int) -> Column:
        return F.array_sort(F.transform(F.filter(column, lambda k: k["sign"] == sign), lambda k: k["key"]))

    ends = [of_sign(f"found{i}", sign).alias(f"{name}_{end}") for i, name in enumerate(pairs) for sign, end in ((1, "lost"), (-1, "new"))]
    return out.select(key, *carry, *ends)


def likeness(size_a: str, size_b: str, lost: str) -> Column:
    """Shared paragraphs of all: 1 for equal sets, two empty ones included."""
    both = F.col(size_a) - F.size(lost)
    return F.when(F.col(size_a) + F.col(size_b) == 0, 1.0).otherwise(both / (F.col(size_a) + F.col(size_b) - both))


def _following(keys: DataFrame) -> DataFrame:
    """k and next_k: the row after each in order of id (null first), then k; after the last comes the first.

    Rows are sorted by range over many tasks; only the first row of each range is compared over all.
    """
    order = [F.col("id").asc_nulls_first(), F.col("k")]
    ranges = materialise(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    inside = ranges.withColumn("next_k", F.lead("k").over(W.partitionBy("part").orderBy(*order)))
    begins = ranges.groupBy("part").agg(F.min_by("k", F.struct(F.col("id").isNotNull(), "id", "k")).alias("first_k"))
    over = W.orderBy("part")  # a row for each range
    begins = begins.withColumn("after", F.coalesce(F.lead("first_k").over(over), F.first("first_k").over(over)))
    return inside.join(begins.select("part", "after"), "part").select("k", "n_chars", F.coalesce("next_k", "after").alias("next_k"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and what differs: by it and by the next text.

    Returns ``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (shared paragraphs of
    all, 0 to 1), edited_lost, edited_new, next_lost, next_new (sorted arrays of paragraph digests). The edited text has its
    last half (rounded down) replaced by as many code points from the start of the next text, or all it has. The next text
    is that of the next id, ascending; after the last comes the first, and a single text is its own next one.

    Null text is taken as empty, which has no paragraphs and a fingerprint of empty cells. A null id comes before all
    others. Rows with one id and several texts are ordered by a hash of the text; rows alike in id and text are one
    document and have one result, once for each row. Repeated paragraphs of a text count once. An empty table gives an empty
    one; other columns play no part, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = df.select(F.col(id_col).alias("id"), text.alias("text"), row_key(id_col, text).alias("k"))
    keys = given.select("id", "k", F.char_length("text").alias("n_chars")).distinct()
    links = materialise(_following(keys), "links")
    own = given.groupBy("k").agg(F.first("id").alias("id"), F.first("text").alias("text"))
    # each text sends its start and its digests to the one before it
    asked = links.select(F.col("next_k").alias("k"), F.col("k").alias("to"), F.floor(F.col("n_chars") / 2).cast("int").alias("half"))
    sent = own.join(asked, "k").select("to", F.substring("text", F.lit(1), F.col("half")).alias("start"), digests(F.col("text")).alias("next"))
    met = own.join(sent, F.col("k") == F.col("to"))
    n = F.char_length("text")
    met = met.select("k", "id", "text", n.alias("n"), F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), "start").alias("edited_text"), "next")
    rows = met.select(
        "k", "id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        digests(F.col("text")).alias("own"), digests(F.col("edited_text")).alias("edited"), "next",
    )
    rows = rows.withColumns({
        "fingerprint": as_text(sketch(F.col("own"), FINGERPRINT)), "edited_fingerprint": as_text(sketch(F.col("edited"), FINGERPRINT)),
        "n_own": F.size("own"), "n_edited": F.size("edited"), "n_next": F.size("next"),
    })
    carry = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "n_own", "n_edited", "n_next"]
    found = differences(rows, "k", {"edited": ("own", "edited"), "next": ("own", "next")}, carry)
    found = found.withColumns({"near_edited": likeness("n_own", "n_edited", "edited_lost"), "near_next": likeness("n_own", "n_next", "next_lost")})
    out = given.select("id", "k").join(found, "k")
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_lost", "edited_new", "next_lost", "next_new"]
    return out.select(F.col("id").alias(id_col), *names)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    found = fingerprints(documents(spark, sf_dir))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
