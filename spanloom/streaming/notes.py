"""The rule plan over a stream of texts.

Each document is whole in one row, so the per-line part is stateless: lines are kept in an array and folded
there instead of by a window.  Append mode, file sources, any sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicon import Lexicon
from ..operators.lines import matches


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of files as they come."""
    raw = spark.readStream.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def section_lines(docs: DataFrame, lexicon: Lexicon, key: str = "path") -> DataFrame:
    """(key, start, line, top): lines with the section carried forward, without state or shuffle."""
    rows = matches(F.col("text"), r"[^\n]+")
    with_header = F.transform(rows, lambda r: F.struct(r["start"].alias("start"), r["match"].alias("line"), X.header_of(r["match"], lexicon)["top"].alias("top")))
    empty = F.expr("cast(array() as array<struct<start:int,line:string,top:string>>)")
    carried = F.aggregate(
        with_header,
        F.struct(F.lit(None).cast("string").alias("top"), empty.alias("out")),
        lambda acc, r: F.struct(F.coalesce(r["top"], acc["top"]).alias("top"), F.array_append(acc["out"], F.struct(r["start"].alias("start"), r["line"].alias("line"), F.coalesce(r["top"], acc["top"]).alias("top"))).alias("out")),
    )
    return docs.select(key, F.inline(carried["out"]))


def write_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Appends to Parquet; ``checkpoint`` is a folder that the cluster shares."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()
