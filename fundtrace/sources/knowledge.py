"""Documents of a folder of mixed files, with what could not be read."""

from __future__ import annotations

import csv
import re
import sys
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of files that are read, and the fields of a document.
KINDS = ("txt", "md", "json", "csv")
FIELDS = ("text", "content", "body", "title", "source", "date", "evidence_type", "type", "url")
BLANKS = " \t\n\r\x0b\f\x1c\x1d\x1e\x1f\x85\xa0"
ITEM = "struct<" + ", ".join(f"{f}: string" for f in FIELDS) + ">"
ROWS = f"file string, item int, fields {ITEM}, reason string"
ARROW_ROWS = pa.schema({"file": pa.string(), "item": pa.int32(), "fields": pa.struct({f: pa.string() for f in FIELDS}), "reason": pa.string()})
#: Characters of the rows of CSV files that are handed back together, about.
PIECE_CHARS = 1_000_000


def _dicts(text: str) -> Iterator[dict]:
    """Rows of a CSV text by the names of its header; a row with more fields than names is an error."""
    lines = (m[0] for m in re.finditer(r"[^\r\n]*(?:\r\n?|\n)|[^\r\n]+", text.removeprefix("\ufeff")))
    for row in csv.DictReader(lines, strict=True):
        if None in row:
            raise csv.Error("more fields than names")
        yield row


def _csv_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole CSV files; one that the reader can't follow gives a row with a reason.

    A file is first read through without keeping anything, then its rows are handed back in pieces of about ``PIECE_CHARS``,
    so that besides the files that Spark sends, a worker holds one text and one piece.
    """
    csv.field_size_limit(sys.maxsize)
    piece, size = [], 0
    for b in batches:
        for file, content in zip(b.column("file"), b.column("content"), strict=True):
            file, text = file.as_py(), content.as_py()
            try:
                deque(_dicts(text), maxlen=0)
            except csv.Error:
                piece.append({"file": file, "reason": "malformed csv"})
                continue
            for i, row in enumerate(_dicts(text), 1):
                fields = {f: row.get(f) for f in FIELDS}
                piece.append({"file": file, "item": i, "fields": fields})
                size += 100 + sum(len(x) for x in fields.values() if x)
                if size >= PIECE_CHARS:
                    yield pa.RecordBatch.from_pylist(piece, ARROW_ROWS)
                    piece, size = [], 0
    if piece:
        yield pa.RecordBatch.from_pylist(piece, ARROW_ROWS)


def _json_rows(files: DataFrame) -> DataFrame:
    """Items of JSON files: those of an array or of ``documents``, else the one object; what is no object is passed over."""
    parsed = files.withColumn("v", F.try_parse_json("content"))
    shape = F.schema_of_variant("v")
    inner = F.try_variant_get("v", "$.documents", "variant")
    listed = F.when(shape.startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).when(inner.isNotNull(), F.try_variant_get("v", "$.documents", "array<variant>"))
    items = F.coalesce(listed, F.when(shape.startswith("OBJECT") & inner.isNull(), F.array("v")), F.array().cast("array<variant>"))
    field = lambda x, f: F.try_variant_get(x, f"$.{f}", "string")
    each = parsed.where("v is not null").select("file", F.posexplode(items).alias("at", "x"))
    each = each.where(F.schema_of_variant("x").startswith("OBJECT"))
    good = each.select("file", (F.col("at") + 1).alias("item"), F.struct(*[field(F.col("x"), f).alias(f) for f in FIELDS]).cast(ITEM).alias("fields"), F.lit(None).cast("string").alias("reason"))
    bad = parsed.where("v is null").select("file", F.lit(None).cast("int").alias("item"), F.lit(None).cast(ITEM).alias("fields"), F.lit("malformed json").alias("reason"))
    return good.unionByName(bad)


def _filled(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(f"fields.{n}"), F.lit("")) for n in names])


def knowledge_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents of all txt, md, json and csv files below a folder (no readme), and the rejects: file, item (from 1; null: the whole file), reason.

    A text file is one document, a JSON file an array, an object with ``documents`` or one object, a CSV file has a document in
    each row. The text is the first of text, content and body that is filled, trimmed. A missing title is the file's stem and
    the item's number, a missing source the path below the folder, a missing date that of the name or the first 300 characters
    (else null), a missing type local_document. Rejected are whole files that are not UTF-8, malformed JSON and CSV (a quote that
    is not closed, a row with more fields than names) and single items without text. An empty folder gives empty tables. A file is read as a whole by one task.
    """
    from fundtrace.operators.retrieval import dated

    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).getPath().toUri().getPath().rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    plain = F.url_decode(F.replace(F.regexp_replace("path", r"^[a-zA-Z0-9]+:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    files = raw.select(F.substring(plain, len(root) + 2, 100_000).alias("file"), F.try_validate_utf8(F.col("content").cast("string")).alias("content"))
    name = F.element_at(F.split("file", "/"), -1)
    files = files.withColumn("kind", F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))).where(F.col("kind").isin(*KINDS) & ~F.lower(name).startswith("readme"))
    known = files.where("content is not null")
    empty = {f: F.lit(None).cast("string") for f in FIELDS}
    whole = known.where(F.col("kind").isin("txt", "md")).select("file", F.lit(1).alias("item"), F.struct(*[(F.col("content") if f == "text" else c).alias(f) for f, c in empty.items()]).alias("fields"), F.lit(None).cast("string").alias("reason"))
    tables = known.where("kind = 'csv'").select("file", "content").mapInArrow(_csv_rows, ROWS)
    unread = files.where("content is null").select("file", F.lit(None).cast("int").alias("item"), F.lit(None).cast(ITEM).alias("fields"), F.lit("not utf-8").alias("reason"))
    rows = whole.unionByName(_json_rows(known.where("kind = 'json'").select("file", "content"))).unionByName(tables).unionByName(unread)
    rows = rows.withColumn("text", F.btrim(_filled("text", "content", "body"), F.lit(BLANKS)))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.coalesce("text", F.lit("")) == "", F.lit("no text"))))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    found = dated(rows.where("reason is null").withColumn("_name", F.concat(name, F.lit(" "))), "_name", "text")
    documents = found.select(
        "file", "item", F.coalesce(_filled("title"), F.concat(stem, F.lit(" #"), F.col("item").cast("string"))).alias("title"), F.coalesce(_filled("source"), F.col("file")).alias("source"),
        F.coalesce(_filled("date"), F.date_format("found_date", "yyyy-MM-dd")).alias("doc_date"), F.coalesce(_filled("evidence_type", "type"), F.lit("local_document")).alias("type"), _filled("url").alias("url"), "text",
    )
    return documents, rows.where("reason is not null").select("file", "item", "reason")
