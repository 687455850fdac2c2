"""Readers and writers: whole texts, concept JSON, JSON lines, CSV with a byte-order mark, pipe-separated tables."""

from __future__ import annotations

import uuid
import zipfile

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONCEPT = "text string, type string, candidates array<string>, assertions array<string>, position array<int>"
#: Columns of the pipe-separated terminology table (fixed values of its published layout).
CONSO_COLUMNS = (
    "rxcui", "lat", "ts", "lui", "stt", "sui", "ispref", "rxaui", "saui", "scui", "sdui", "sab", "tty", "code", "str", "srl", "suppress", "cvf",
)
CONSO_KEPT = ("rxcui", "tty", "code", "str", "suppress")


def _stem(path):
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(stem, text): one row for each file, line ends as ``\\n``."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(_stem(F.col("_metadata.file_path")).alias("stem"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def natural_order(df: DataFrame, stem: str = "stem") -> DataFrame:
    """By length, then by name: numbers in their order."""
    return df.orderBy(F.length(stem), stem)


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """(stem, idx, text, type, start, end, assertions, candidates) of the ``*.json`` files of a folder."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    rows = F.from_json("value", f"array<struct<{','.join(':'.join(c.split(' ', 1)) for c in CONCEPT.split(', '))}>>")
    flat = raw.select(_stem(F.col("_metadata.file_path")).alias("stem"), F.posexplode_outer(rows).alias("idx", "c")).where("c is not null")
    none = F.array().cast("array<string>")
    return flat.select("stem", "idx", "c.text", "c.type", F.get("c.position", F.lit(0)).alias("start"), F.get("c.position", F.lit(1)).alias("end"), F.coalesce("c.assertions", none).alias("assertions"), F.coalesce("c.candidates", none).alias("candidates"))


def concept_json(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, json): a document's concepts by start, with the keys that each type has, in fixed order."""
    from ..functions.lexicon import ASSERTION_TYPES, CODE_TYPES

    one = F.struct(
        "text",
        "type",
        F.when(F.col("type").isin(*CODE_TYPES), F.col("candidates")).alias("candidates"),
        F.when(F.col("type").isin(*ASSERTION_TYPES), F.col("assertions")).alias("assertions"),
        F.array("start", "end").alias("position"),
    )
    return spans.groupBy(key).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", one.alias("c")))), lambda x: x["c"])).alias("json"))


def write_concepts(spans: DataFrame, path: str, key: str = "doc_id", docs: DataFrame | None = None) -> int:
    """A file ``<key>.json`` in ``path`` for each document, written by the tasks; how many there are.

    With ``docs``, documents without concepts get an empty list.  A file is written beside its place and moved there,
    so a task that runs again leaves the same.  ``path`` is local or of a store that Arrow can open (hdfs, s3, gs).
    """
    told = concept_json(spans, key)
    if docs is not None:
        told = docs.select(key).distinct().join(told, key, "left").fillna("[]", ["json"])

    def write(batches):
        fs, root = FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for stem, json in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place = f"{root}/{stem}.json"
                draft = f"{place}.{uuid.uuid4().hex}"
                with fs.open_output_stream(draft) as f:
                    f.write(json.encode())
                fs.move(draft, place)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return told.select(F.col(key).cast("string"), "json").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object on each line; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header, all strings, cells trimmed, a byte-order mark and doubled quotes understood."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    return raw.select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.lstrip("﻿")) for c in raw.columns])


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """CSV with a header; the first column's name carries the byte-order mark."""
    out = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0]) if bom else df
    out.write.mode("overwrite").csv(path, header=True, quoteAll=False, escape='"')


def read_terminology(spark: SparkSession, path: str, vocabulary: str = "RXNORM") -> DataFrame:
    """The kept columns of a pipe-separated terminology table, of one source vocabulary."""
    schema = ", ".join(f"`{c}` string" for c in (*CONSO_COLUMNS, "rest"))
    raw = spark.read.csv(path, sep="|", quote="", schema=schema)
    return raw.where(F.col("sab") == vocabulary).select(*CONSO_KEPT)


def clean_cells(df: DataFrame) -> DataFrame:
    """Nulls as empty strings, white space collapsed."""
    return df.select(*[F.coalesce(F.trim(F.regexp_replace(F.col(f"`{c}`").cast("string"), r"(?U)\s+", " ")), F.lit("")).alias(c) for c in df.columns])


def table_rows(df: DataFrame) -> DataFrame:
    """Rows of a table read from pages, without repeated header rows: the first cell a number, the second a name."""
    a, b = df.columns[:2]
    return clean_cells(df).where(F.col(a).rlike(r"^\d+$") & (F.col(b) != "") & ~F.col(b).rlike(r"^\d+$"))


def corpus_with_fallback(spark: SparkSession, path: str, other: str) -> DataFrame:
    """The texts of a folder, or of another if that one has none."""
    first = read_texts(spark, path)
    return read_texts(spark, other) if first.isEmpty() else first


def package(df: DataFrame, target: str, stem: str = "stem", json: str = "json") -> int:
    """A ZIP of ``output/<stem>.json`` in natural order, written by the driver one document at a time."""
    n = 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for r in natural_order(df.select(stem, json), stem).toLocalIterator():
            z.writestr(f"output/{r[stem]}.json", r[json])
            n += 1
    return n
