"""What the operators of this subpackage share: Arrow text slices, vectorised hashing, shared storage.

Texts reach Python as Arrow batches.  A batch may hold 64 MB; every operator works on slices of about
``SLICE_BYTES`` so that its numpy temporaries stay bounded whatever the batch size is (one text longer than
that is a slice of its own: texts are always processed whole).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20

#: Bytes 0x20 and 0x09-0x0D: the only characters that part words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
SPACES = b" \t\n\x0b\x0c\r"

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its files give fewer partitions than there are (one small file is one task)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, offsets) of runs of rows; null texts count as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    n = len(col)
    if n == 0:
        return
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words ``[^\\x20\\x09-\\x0D]+`` of a slice."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~IS_SPACE[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    before[cuts] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> None:
        if len(cls.up) <= n:
            size = 1 << int(n).bit_length()
            cls.up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, _BASE, np.uint64))), dtype=np.uint64)
            cls.down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, _BASE_INV, np.uint64))), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every output bit depends on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over ``values``; see :func:`span_hash`."""
    _Powers.upto(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * _Powers.up[: len(values)], out=out[1:], dtype=np.uint64)
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], the same wherever the span stands and in every process."""
    return mix((prefix[ends] - prefix[starts]) * _Powers.down[starts] + (ends - starts).astype(np.uint64))


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder under the cluster's shared checkpoint folder; a default is set only where none is named."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/spanloom-{label}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Names a checkpoint folder where the session has none; only a local master may use the machine's own."""
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(shared or f"/tmp/spanloom-checkpoints/{uuid.uuid4().hex}")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage by way of a table in the shared folder, which outlives a lost executor."""
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops columns whose names clash, in any letter case, with columns about to be added."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def hash_fraction(column, salt: int):
    """A double in [0, 1) that depends on the column's value alone."""
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def most_frequent(counts: DataFrame, key: str, most: int) -> DataFrame:
    """Of ``counts(key, n)`` (a written table) the ``most`` rows with the largest n, or nearly so many.

    A histogram of counts (some thousand rows, whatever the table's size) gives the bar that at most ``most``
    rows reach; of the class just below the bar, rows are taken by a hash of their key, as many as there is
    room for.  So no task sends more than its part of ``most`` rows.
    """
    level = F.floor(F.log2("n") * 64).cast("int")
    bar, room, share = 0, most, 0.0
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("c")).orderBy(F.desc("level")).collect():
        if r["c"] > room:
            bar, share = r["level"], room / r["c"]
            break
        room -= r["c"]
        bar, share = r["level"], 1.0
    return counts.where((level > bar) | ((level == bar) & (hash_fraction(F.col(key), 23) < share)))


def shielded(docs: DataFrame, needed: tuple[str, ...], use) -> DataFrame:
    """``use`` of ``docs`` with every column but the needed ones under a name that can't clash, and back."""
    names = docs.columns
    inner = [n if n in needed else f"_{k}_of_{len(names)}" for k, n in enumerate(names)]
    out = use(docs.toDF(*inner))
    return out.select(*[F.col(a).alias(b) for a, b in zip(inner, names, strict=True)])
