"""Documents and landed files as frames."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.ordering import dense_index


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text; bytes that are not UTF-8 are left out."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, '' when there is none."""
    return F.lower(F.regexp_extract(path, r"(?<=[^/])(\.[^./]*)$", 1))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, file_type, file_size, content) of every file below ``path``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(
        "path",
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
        extension(F.col("path")).alias("file_type"),
        F.col("length").alias("file_size"),
        "content",
    )


#: Ends a record in a file of many documents. Inside a record it and the escape mark are written as two characters.
RECORD_END, ESCAPE = "\x1e", "\x1b"


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(RECORD_END), F.lit(ESCAPE + "1"))


def _unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "1"), F.lit(RECORD_END)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def write_records(docs: DataFrame, path: str, name: Column, text: Column) -> None:
    """Write many documents per file: a first line with the name, then the text; a null text has no line end.

    The number of files is that of the frame's partitions, whatever the number of documents. Line
    breaks in names become blanks.
    """
    head = F.translate(_escaped(F.coalesce(name.cast("string"), F.lit(""))), "\r\n", "  ")
    record = F.concat(head, F.coalesce(F.concat(F.lit("\n"), _escaped(text)), F.lit("")))
    docs.select(record.alias("value")).write.option("lineSep", RECORD_END).text(path)


def records(raw: DataFrame) -> DataFrame:
    """(path, filename, file_type, file_size, content) of records as read by their end mark; path is the document's name."""
    at = F.instr("value", "\n")
    name = _unescaped(F.when(at > 0, F.substring("value", F.lit(1), at - 1)).otherwise(F.col("value")))
    content = F.when(at > 0, _unescaped(F.substring("value", at + 1, F.length("value"))))
    rows = raw.select(name.alias("path"), content.alias("content"))
    return rows.select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), extension(F.col("path")).alias("file_type"),
        F.octet_length("content").cast("long").alias("file_size"), "content",
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Documents of :func:`write_records`. Files are split at record marks, so one file is read by many tasks."""
    return records(spark.read.option("lineSep", RECORD_END).option("recursiveFileLookup", "true").text(path))


def text_documents(files: DataFrame) -> DataFrame:
    """(path, text) of text files."""
    return files.select("path", decoded(F.col("content")).alias("text"))


def _sheet_text(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: "".join(", ".join(row) + "\n" for row in csv.reader(io.StringIO(t, newline=""))), na_action="ignore")


def sheet_documents(files: DataFrame) -> DataFrame:
    """(path, text) of CSV files: fields joined by ', ', one line per row.

    A file is one document value, so quoting is resolved per file value in Arrow batches.
    """
    flatten = F.pandas_udf(_sheet_text, "string")
    return files.select("path", flatten(decoded(F.col("content"))).alias("text"))


def ingest(files: DataFrame, kb_id: str, schema_json: str) -> DataFrame:
    """Rows of the file table for a batch of files or records, ready to append. Files are read once."""
    is_sheet = F.col("file_type") == ".csv"
    flatten = F.pandas_udf(_sheet_text, "string")
    content = decoded(F.col("content"))
    rows = files.withColumn("content", F.when(is_sheet, flatten(F.when(is_sheet, content))).otherwise(content))
    kind = F.when(F.col("file_type") == "", ".txt").otherwise(F.col("file_type"))
    return rows.select(
        F.sha2(F.concat_ws(":", F.lit(kb_id), "path"), 256).alias("id"),
        F.lit(kb_id).alias("kb_id"),
        "filename",
        "content",
        kind.alias("file_type"),
        "file_size",
        F.lit(schema_json).alias("schema_json"),
        F.lit(False).alias("has_graph"),
    )


def load_corpus(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """(title, text) documents from JSON; JSON lines by default, so large files split."""
    return spark.read.schema("title string, text string").option("multiLine", str(multiline).lower()).json(path)


def landed_responses(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of landed API responses, one response per file."""
    return text_documents(read_files(spark, path)).withColumnRenamed("text", "body")


def seed_chunks(chunk_ids: DataFrame, docs: DataFrame, corpus: str) -> tuple[DataFrame, DataFrame]:
    """Chunk store of a prebuilt graph: every chunk id stands for the whole text of its corpus.

    Kept as two tables, (chunk_id, corpus) and the corpus rows, so the text is stored once and
    no row holds a corpus. :func:`seeded_sizes` gives the length each joined text would have.
    """
    ids = chunk_ids.where(F.coalesce("chunk_id", F.lit("")) != "").select("chunk_id", corpus).distinct()
    return ids, docs.select(corpus, "doc_id", "text")


def seeded_rows(docs: DataFrame, corpus: str) -> DataFrame:
    """(corpus, position, doc_id, text): the text of a corpus as its rows in order, for readers that join or stream it."""
    return dense_index(docs.select(corpus, "doc_id", "text"), [corpus], ["doc_id"], "position")


def seeded_sizes(ids: DataFrame, docs: DataFrame, corpus: str) -> DataFrame:
    """(chunk_id, documents, characters) of texts joined with a blank line between documents."""
    per = docs.groupBy(corpus).agg(
        F.count(F.lit(1)).alias("documents"), (F.sum(F.length("text")) + 2 * (F.count(F.lit(1)) - 1)).alias("characters")
    )
    return ids.join(per, corpus).select("chunk_id", "documents", "characters")
