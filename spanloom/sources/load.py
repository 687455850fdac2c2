"""Bulk loads: delimited text into good rows and rejects, and tables that are replaced whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hygiene import shared_table


@dataclass(frozen=True)
class Field:
    """A column of a delimited table: its name, its greatest length (for text), and whether it is a whole number."""

    name: str
    most: int | None = None
    number: bool = False


#: The published control file of the terminology table (fixed values).
CONSO = (
    Field("rxcui", 8), Field("lat", 3), Field("ts", 1), Field("lui", 8), Field("stt", 3), Field("sui", 8), Field("ispref", 1), Field("rxaui", 8), Field("saui", 50), Field("scui", 50),
    Field("sdui", 50), Field("sab", 20), Field("tty", 20), Field("code", 50), Field("str", 3000), Field("srl", number=True), Field("suppress", 1), Field("cvf", 50),
)


def parse(spark: SparkSession, path: str, fields: tuple[Field, ...], sep: str = "|") -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejects (file, line, reason), of a delimited text whose lines may end in a separator.

    Short lines are filled with nulls, empty cells are null, blank lines are skipped.  Rejected are lines with more
    cells than fields, with a cell that is too long, or with one that should be a whole number and isn't.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "\r$", "").alias("line")).where(F.trim("line") != "")
    bare = F.when(F.endswith("line", F.lit(sep)), F.substr("line", F.lit(1), F.length("line") - len(sep))).otherwise(F.col("line"))
    cells = F.split(bare, "\\Q" + sep + "\\E", -1)
    told = raw.withColumn("cells", cells)
    cell = lambda k: F.nullif(F.get("cells", F.lit(k)), F.lit(""))
    reason = F.when(F.size("cells") > len(fields), F.lit("too many cells"))
    for k, f in enumerate(fields):
        if f.most is not None:
            reason = reason.when(F.length(cell(k)) > f.most, F.lit(f"{f.name} is too long"))
        if f.number:
            reason = reason.when(cell(k).isNotNull() & F.expr(f"try_cast(nullif(get(cells, {k}), '') as bigint)").isNull(), F.lit(f"{f.name} is not a whole number"))
    told = told.withColumn("reason", reason)
    good = told.where("reason is null").select(*[(cell(k).cast("long") if f.number else cell(k)).alias(f.name) for k, f in enumerate(fields)])
    return good, told.where("reason is not null").select("file", "line", "reason")


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def replace_table(df: DataFrame, path: str, check: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Writes ``df`` beside ``path`` and puts it in its place; a load that fails leaves the old table as it was.

    ``check`` sees the table before it counts and may raise.  ``df`` may read the table that it replaces.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    mark = uuid.uuid4().hex
    fs, target = _fs(spark, path)
    _, fresh = _fs(spark, f"{path}.loading-{mark}")
    _, old = _fs(spark, f"{path}.old-{mark}")
    try:
        df.write.parquet(fresh.toString())
        if check is not None:
            check(spark.read.schema(df.schema).parquet(fresh.toString()))
        had = fs.exists(target)
        if had and not fs.rename(target, old):
            raise OSError(f"{path} can't be moved")
        if not fs.rename(fresh, target):
            if had:
                fs.rename(old, target)
            raise OSError(f"{path} can't be replaced")
        if had:
            fs.delete(old, True)
    except Exception:
        fs.delete(fresh, True)
        raise
    return spark.read.parquet(path)


def bulk_load(spark: SparkSession, source: str, path: str, rejects: str, fields: tuple[Field, ...] = CONSO, sep: str = "|", most_rejects: int = 0) -> DataFrame:
    """Loads delimited text into the table at ``path``; more than ``most_rejects`` bad lines leave the old table in place.

    The rejects are written to ``rejects`` either way, so that a failed load can be looked into.
    """
    good, bad = parse(spark, source, fields, sep)
    told = replace_table(bad, rejects)
    n = told.count()
    if n > most_rejects:
        raise ValueError(f"{n} lines rejected, see {rejects}")
    return replace_table(good, path)


def vectors_for(names: DataFrame, encoder: str, path: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(name, vector) of the distinct ``names(name)``, of which only those not in the cache at ``path`` are built.

    The key is a hash of encoder and name, so a changed name or encoder is built anew and nothing else is.
    ``build`` gets (name) and gives (name, vector).  New vectors are appended; what a failed call has built isn't seen.
    """
    spark = names.sparkSession
    key = F.sha2(F.concat_ws("\x1f", F.lit(encoder), "name"), 256).alias("key")
    asked = names.where("name is not null").select("name").distinct().select(key, "name")
    fs, where = _fs(spark, path)
    held = fs.exists(where)
    lacking = asked.join(spark.read.parquet(path).select("key"), "key", "left_anti") if held else asked
    lacking = shared_table(lacking, "lacking")
    if not lacking.isEmpty():
        built = build(lacking.select("name"))
        lacking.join(built.select("name", F.col("vector").cast("array<double>").alias("vector")), "name").select("key", "name", "vector").write.mode("append").parquet(path)
    elif not held:
        return spark.createDataFrame([], "name string, vector array<double>")
    return asked.join(spark.read.parquet(path).select("key", "vector"), "key").select("name", "vector")
