"""Exact top-k search: exhaustive term-at-a-time accumulation over blocks of rows.

A vector's components are its terms, floor(64 * x) their integer weights.  Rows are packed into blocks of at
most ``BLOCK_ROWS`` as an inverted index: for every term the rows that hold it and their weights.  Queries
(a stated set: ids divisible by ``every``) are packed too, each row as its terms and weights.  Every query
block meets every row block once; a query's terms are taken one at a time, each scattering weight times
posting into a dense array of scores (a term that more than half of a block's rows hold has its postings laid
out densely, zeros included, so that scattering is one multiply-add).  A partition selection leaves the k
best of each block, ties to the smaller id, and a window over those merges the blocks.

Scale: rows are shuffled once, by id, into blocks, which are written to the shared folder; query blocks are
then dealt to every group of row blocks by an equi-join on the group's number (blocks, not rows: its traffic
is the number of groups times the query set, and each pair is a few MB, whatever the table's size).  Between
blocks only k rows of each query travel.

Defined cases: null vectors and vectors with a null or non-finite component take no part, neither as query
nor as candidate, and neither do rows with a null id; an empty vector has no terms and scores 0 with
everything; vectors of different lengths are compared over the terms they share; rows repeated under one id
are one row (of different vectors the smallest in array order counts); weights and scores outside the range
of long saturate; fewer than k candidates give as many rows as there are; an empty table gives no rows; columns
beside vec_id and embedding, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

K = 20
EVERY = 20
SCALE = 64
BLOCK_ROWS = 8192
BLOCK_WEIGHTS = 1 << 20
QUERY_ROWS = 1024
TILE = 64
_LONG = 2**63 - 1


def weights(vectors: DataFrame) -> DataFrame:
    """(vec_id, w): integer weights of the vectors that take part."""
    bad = F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    w = F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad).select(F.col("vec_id").cast("long"), w.alias("w"))


_BLOCK = "query boolean, part int, seq int, n int, bound double, ids binary, terms binary, at binary, weight binary"


def _pack(rows: list[tuple[int, np.ndarray]], query: bool, seq: int) -> tuple:
    """A block: ids; and by term (rows: an inverted index) or by row (queries) positions and weights."""
    ids = np.array([r[0] for r in rows], np.int64)
    lens = np.array([len(r[1]) for r in rows])
    flat = np.concatenate([r[1] for r in rows]) if len(rows) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), lens)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    use = flat != 0
    row, term, flat = row[use], term[use], flat[use]
    major, minor = (row, term) if query else (term, row)
    order = np.lexsort((minor, major))
    n_major = int(lens.max()) if len(lens) and not query else len(rows)
    start = np.zeros(n_major + 1, np.int64)
    np.cumsum(np.bincount(major, minlength=n_major), out=start[1:])
    # The sum of a row's absolute weights bounds a score together with the other side's largest weight.
    bound = np.bincount(row, np.abs(flat.astype(float)), minlength=1).max() if query else np.abs(flat.astype(float)).max(initial=0)
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    return query, part, seq, len(rows), float(bound), ids.tobytes(), start.tobytes(), minor[order].astype(np.int32).tobytes(), flat[order].tobytes()


def blocks(rows: DataFrame, every: int = EVERY) -> DataFrame:
    """Row blocks and query blocks of ``rows(vec_id, w)``, each in order of id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {False: [], True: []}
        seq = 0
        room = {False: BLOCK_ROWS, True: QUERY_ROWS}
        size = {False: 0, True: 0}
        last = None

        def flush(kind: bool) -> pa.RecordBatch:
            nonlocal seq
            packed = _pack(held[kind], kind, seq)
            held[kind], size[kind] = [], 0
            seq += 1
            names = [x.split()[0] for x in _BLOCK.split(", ")]
            types = [pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(packed, types, strict=True)], names=names)

        for batch in batches:
            ids = np.asarray(batch.column(0))
            lists = batch.column(1)
            flat, offs = np.asarray(lists.values), np.asarray(lists.offsets)
            for r, (k, a, b) in enumerate(zip(ids.tolist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                if k == last:  # sorted: the same id again
                    continue
                last = k
                for kind in (False, True):
                    if kind and k % every:
                        continue
                    held[kind].append((k, flat[a:b].copy()))
                    size[kind] += b - a
                    if len(held[kind]) >= room[kind] or size[kind] >= BLOCK_WEIGHTS:
                        yield flush(kind)
        for kind in (False, True):
            if held[kind]:
                yield flush(kind)

    return rows.repartition("vec_id").sortWithinPartitions("vec_id", "w").mapInArrow(run, _BLOCK)


def accumulate(n_rows: int, index: tuple, queries: list[tuple[np.ndarray, np.ndarray]], dtype) -> np.ndarray:
    """Scores of a few queries against a block, term at a time."""
    start, at, weight = index
    scores = np.zeros((len(queries), n_rows), dtype)
    by_term: dict[int, tuple[list[int], list[int]]] = {}
    for q, (terms, ws) in enumerate(queries):
        for t, w in zip(terms.tolist(), ws.tolist(), strict=True):
            own = by_term.setdefault(t, ([], []))
            own[0].append(q)
            own[1].append(w)
    whole = len(queries)
    for t, (qs, ws) in by_term.items():
        if t >= len(start) - 1 or start[t] == start[t + 1]:
            continue
        rows, value = at[start[t] : start[t + 1]], weight[start[t] : start[t + 1]].astype(dtype)
        w = np.array(ws, dtype)[:, None]
        if 2 * len(rows) > n_rows:
            dense = np.zeros(n_rows, dtype)
            dense[rows] = value
            if len(qs) == whole:
                scores += w * dense
            else:
                scores[qs] += w * dense
        else:
            scores[np.ix_(qs, rows)] += w * value
    return scores


def select(scores: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Which entries of each row are among its k best, ties to the left; ``own`` entries are out."""
    n = scores.shape[1]
    if n <= k:
        return ~own
    low = scores.min() - 1 if scores.dtype == object else np.iinfo(scores.dtype).min
    scores = np.where(own, low, scores)
    bar = np.partition(scores, n - k, axis=1)[:, n - k][:, None]
    above = scores > bar
    tie = scores == bar
    need = k - above.sum(1, keepdims=True)
    return (above | (tie & (np.cumsum(tie, 1) <= need))) & ~own


def _score_pairs(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in batch.to_pylist():
            ids = np.frombuffer(p["ids"], np.int64)
            index = np.frombuffer(p["terms"], np.int64), np.frombuffer(p["at"], np.int32), np.frombuffer(p["weight"], np.int64)
            qids = np.frombuffer(p["q_ids"], np.int64)
            qstart, qterm, qweight = np.frombuffer(p["q_terms"], np.int64), np.frombuffer(p["q_at"], np.int32), np.frombuffer(p["q_weight"], np.int64)
            most = p["bound"] * p["q_bound"]
            dtype = np.int32 if most < 2**30 else np.int64 if most < 2**61 else object
            out: list[tuple] = []
            for s in range(0, len(qids), TILE):
                some = range(s, min(s + TILE, len(qids)))
                scores = accumulate(len(ids), index, [(qterm[qstart[q] : qstart[q + 1]], qweight[qstart[q] : qstart[q + 1]]) for q in some], dtype)
                if dtype is object:
                    scores = np.clip(scores, -_LONG - 1, _LONG)
                took = select(scores, qids[some.start : some.stop, None] == ids, k)
                q, r = np.nonzero(took)
                out.append((qids[some.start + q], ids[r], scores[q, r].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], names=["query_id", "vec_id", "score"])


def search(rows: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``rows(vec_id, w)`` for every row whose id ``every`` divides."""
    packed = cut(blocks(rows, every), "blocks")
    base = packed.where("not query").drop("query")
    groups = max(1, base.count())
    names = {"n": "q_n", "bound": "q_bound", "ids": "q_ids", "terms": "q_terms", "at": "q_at", "weight": "q_weight"}
    queries = packed.where("query").select(*[F.col(a).alias(b) for a, b in names.items()], F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    base = base.withColumn("group", F.pmod(F.xxhash64("part", "seq"), F.lit(groups)).cast("int"))
    pairs = base.join(queries, "group").drop("group", "part", "seq")
    found = pairs.mapInArrow(lambda b: _score_pairs(b, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(weights(table(spark, sf_dir, "embeddings")))
