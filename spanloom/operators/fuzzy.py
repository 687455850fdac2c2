"""Exact join of strings by token-set ratio: no pair that reaches the bar is lost.

The ratio of two strings with the common tokens C and the remainders A and B is 100 if one has no remainder,
and otherwise the largest of the indel ratios of C against C A, C against C B, and C A against C B.  Each kind
has its own way to candidates:

* C against one side.  C then holds at least bar / (200 - bar) of that side's letters, so it has a token among
  those of the side that are rarest first, up to where the rest is too short to be C.  These meet all tokens
  of the other side by an equi-join; a frequent token is used only where it is much of a string.
* C A against C B.  Twice the common letters must reach the bar's share of all letters, in whatever order the
  tokens stand.  At a bar of 78 a string may differ in 44 edits a 100 letters, so a segment that has to survive
  is two letters long and prunes nothing; letter counts do.  Strings are packed into blocks by length class;
  a block of queries meets the blocks of the classes that the bar allows, as one sum of minima over letter
  counts, and what passes is scored: without a common token by a bit-parallel subsequence of all pairs at
  once, else by the plain rule.

The first way goes first: where it finds ``most`` names for a query, the second has to beat the worst of them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import _token_set, token_set_ratio
from .hygiene import shared_table

BLOCK = 1024
CLASS = 1.15
BUCKETS = 64
PAIRS = 1 << 16


def token_set(s: Column) -> Column:
    """The distinct tokens of a normalised string, sorted, as one string: what the ratio sees of it."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(s, " "))), " ")


def rare_prefix(tokens: DataFrame, df: DataFrame, share: float) -> DataFrame:
    """Of ``tokens(key, tok, w)`` those of each key, rarest first, that a common part of ``share`` of its letters can't miss."""
    own, w = Window.partitionBy("key"), Window.partitionBy("key").orderBy("df", "tok")
    told = tokens.join(df, "tok", "left").fillna(0, ["df"])
    total, before = F.sum("w").over(own), F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return told.withColumns({"rest": total - before, "need": share * (total - 1) + 1 - 1e-9}).where("rest >= need").select("key", "tok")


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points as a matrix filled with -1, and lengths."""
    lens = np.array([len(s) for s in strings])
    flat = np.frombuffer("".join(strings).encode("utf-32-le"), "<u4").astype(np.int64)
    out = np.full((len(strings), max(1, lens.max(initial=0))), -1, np.int64)
    row = np.repeat(np.arange(len(strings)), lens)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out, lens


def _counts(codes: np.ndarray) -> np.ndarray:
    """How often each bucket of letters occurs in each row."""
    row, col = np.nonzero(codes >= 0)
    kind = np.uint8 if codes.shape[1] < 256 else np.int32
    return np.bincount(row * BUCKETS + codes[row, col] % BUCKETS, minlength=len(codes) * BUCKETS).reshape(len(codes), BUCKETS).astype(kind)


def _masks(strings: list[str]) -> np.ndarray:
    """64 bits, of which each token sets one: strings without a common bit have no common token."""
    out = np.zeros(len(strings), np.uint64)
    for k, s in enumerate(strings):
        for t in s.split(" "):
            out[k] |= np.uint64(1 << (zlib.crc32(t.encode()) & 63))
    return out


def _subsequences(a: np.ndarray, a_lens: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Longest common subsequences of the pairs (a[i], b[j]); rows of ``a`` have at most 64 letters."""
    letters = np.unique(np.concatenate((a[a >= 0], b[b >= 0])))
    at, bt = np.searchsorted(letters, a), np.searchsorted(letters, b)
    where = np.zeros((len(a), len(letters) + 1), np.uint64)
    for k in range(min(64, a.shape[1])):
        rows = np.flatnonzero(a[:, k] >= 0)
        where[rows, at[rows, k]] |= np.uint64(1 << k)
    bt[b < 0] = len(letters)
    full = np.array([(1 << int(n)) - 1 for n in np.minimum(a_lens, 64)], np.uint64)[i]
    state = full.copy()
    for k in range(b.shape[1]):
        hit = state & where[i, bt[j, k]]
        state = ((state + hit) | (state - hit)) & full
    return np.bitwise_count(full ^ state).astype(np.int64)


def compare(queries: list[str], bars: np.ndarray, names: list[str]) -> list[tuple[int, int, float]]:
    """(query, name, score) of all pairs whose token-set ratio reaches the query's bar by whole strings."""
    a, a_lens = _codes(queries)
    b, b_lens = _codes(names)
    ha, hb = _counts(a), _counts(b)
    total = np.zeros((len(a), len(b)), np.int32)
    for k in np.flatnonzero(ha.any(0) & hb.any(0)).tolist():
        total += np.minimum(ha[:, k, None], hb[None, :, k])
    i, j = np.nonzero(200.0 * total >= bars[:, None] * (a_lens[:, None] + b_lens) - 1e-6)
    apart = (_masks(queries)[i] & _masks(names)[j]) == 0
    out: list[tuple[int, int, float]] = []
    for fits, swap in ((a_lens[i] <= 64, False), ((a_lens[i] > 64) & (b_lens[j] <= 64), True)):
        own = np.flatnonzero(apart & fits)
        for s in range(0, len(own), PAIRS):
            x, y = i[own[s : s + PAIRS]], j[own[s : s + PAIRS]]
            common = _subsequences(b, b_lens, a, y, x) if swap else _subsequences(a, a_lens, b, x, y)
            score = 200.0 * common / (a_lens[x] + b_lens[y])
            good = score >= bars[x]
            out += zip(x[good].tolist(), y[good].tolist(), score[good].tolist(), strict=True)
    rest = np.flatnonzero(~apart | ((a_lens[i] > 64) & (b_lens[j] > 64)))
    for x, y in zip(i[rest].tolist(), j[rest].tolist(), strict=True):
        score = _token_set(queries[x], names[y])
        if score >= bars[x]:
            out.append((x, y, score))
    return out


def _length_class(c: Column) -> Column:
    return F.floor(F.log(F.greatest(F.length(c), F.lit(1))) / math.log(CLASS)).cast("int")


def _pack(keys: int, names: list[str]):
    """Arrow batches sorted by their first ``keys`` columns to one row a key, the other columns as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            lists = [pa.array([t.column(c).to_pylist()], pa.list_(t.column(c).type)) for c in range(keys, t.num_columns)]
            return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int32()) for k in key], *lists], names=names)

        for batch in batches:
            where = np.stack([np.asarray(batch.column(c)) for c in range(keys)], 1)
            cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1).tolist(), len(where)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    now = tuple(where[lo].tolist())
                    if held and now != key:
                        yield flush()
                        held = []
                    key = now
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield flush()

    return run


def _blocks(df: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """``df(key, ...)`` with its length class and, of each class, a block by hash, ``BLOCK`` rows each or so."""
    many = F.lit(1)
    for c, n in sizes.items():
        many = F.when(F.col("cls") == c, n).otherwise(many)
    return df.withColumn("cls", _length_class(F.col("key"))).withColumn("blk", F.pmod(F.xxhash64("key"), many).cast("int"))


def _sizes(df: DataFrame) -> dict[int, int]:
    """Blocks of each length class that has rows; there are some hundred classes at most."""
    return {r["cls"]: -(-r["n"] // BLOCK) for r in df.groupBy(_length_class(F.col("key")).alias("cls")).agg(F.count("*").alias("n")).collect()}


def whole_pairs(queries: DataFrame, names: DataFrame, bar: float) -> DataFrame:
    """(query, name, score) of ``queries(key, bar)`` and ``names(key)`` that reach the query's bar as whole strings."""
    share = bar / (200.0 - bar)
    q_sizes, n_sizes = _sizes(queries), _sizes(names)
    meets = {}
    for c in q_sizes:
        low, high = CLASS**c * share, CLASS ** (c + 1) / share if share > 0 else math.inf
        meets[c] = [(d, b) for d, n in n_sizes.items() if CLASS ** (d + 1) >= low * (1 - 1e-9) and CLASS**d <= high * (1 + 1e-9) for b in range(n)]
    packed = lambda df, sizes, cols, names_, kind: _blocks(df, sizes).select("cls", "blk", *cols).repartition("cls", "blk").sortWithinPartitions("cls", "blk").mapInArrow(_pack(2, ["cls", "blk", *names_]), f"cls int, blk int, {kind}")
    q = packed(queries, q_sizes, ["key", "bar"], ["q", "bar"], "q array<string>, bar array<double>")
    n = packed(names, n_sizes, ["key"], ["n"], "n array<string>")
    pairs = [(c, d, b) for c, found in meets.items() for d, b in found]
    spark = queries.sparkSession
    if not pairs:
        return spark.createDataFrame([], "query string, name string, score double")
    table = spark.createDataFrame(pairs, "q_cls int, cls int, blk int")
    dealt = q.withColumnRenamed("cls", "q_cls").drop("blk").join(table, "q_cls").drop("q_cls")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = compare(r["q"], np.array(r["bar"]), r["n"])
                yield pa.RecordBatch.from_arrays([pa.array([r["q"][x] for x, _, _ in found], pa.string()), pa.array([r["n"][y] for _, y, _ in found], pa.string()), pa.array([s for *_, s in found], pa.float64())], names=["query", "name", "score"])

    return dealt.join(n, ["cls", "blk"]).select("q", "bar", "n").mapInArrow(score, "query string, name string, score double")


def token_set_join(queries: DataFrame, names: DataFrame, bar: float, most: int) -> DataFrame:
    """(query_id, row_id, score): each query's ``most`` best names of ratio ``bar`` or more, ties to smaller rows.

    ``queries(query_id, q)`` and ``names(row_id, n)`` are normalised; empty ones match nothing, null ones count as
    empty.  Equal token sets are one string until the end, where of equal names the first ``most`` rows suffice.
    """
    q = shared_table(queries.where("q <> ''").select("query_id", token_set(F.col("q")).alias("query")), "queries")
    n = names.where("n <> ''").select("row_id", token_set(F.col("n")).alias("name"))
    first = Window.partitionBy("name").orderBy("row_id")
    n = shared_table(n.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= most).drop("nth"), "names")
    q_keys, n_keys = q.select(F.col("query").alias("key")).distinct(), n.select(F.col("name").alias("key")).distinct()
    tokens = lambda keys: keys.select("key", F.explode(F.split("key", " ")).alias("tok")).withColumn("w", F.length("tok") + 1)
    q_tok, n_tok = tokens(q_keys), tokens(n_keys)
    df, share = n_tok.groupBy("tok").agg(F.count("*").alias("df")), bar / (200.0 - bar)
    side = lambda x, y: x.select("tok", F.col("key").alias("query")).join(y.select("tok", F.col("key").alias("name")), "tok").select("query", "name")
    met = side(rare_prefix(q_tok, df, share), n_tok).union(side(q_tok, rare_prefix(n_tok, df, share))).distinct()
    by_token = shared_table(met.withColumn("score", token_set_ratio(F.col("query"), F.col("name"))).where(F.col("score") >= bar), "tokens")
    rank = Window.partitionBy("query").orderBy(F.desc("score"), "row_id")
    worst = by_token.join(n, "name").withColumn("nth", F.row_number().over(rank)).where(F.col("nth") == most).select(F.col("query").alias("key"), F.col("score").alias("worst"))
    barred = shared_table(q_keys.join(worst, "key", "left").select("key", F.greatest(F.lit(float(bar)), F.coalesce("worst", F.lit(0.0))).alias("bar")), "bars")
    found = by_token.union(whole_pairs(barred, n_keys, bar)).groupBy("query", "name").agg(F.max("score").alias("score"))
    best = found.join(n, "name").withColumn("nth", F.row_number().over(rank)).where(F.col("nth") <= most)
    return best.join(q, "query").select("query_id", "row_id", "score")
