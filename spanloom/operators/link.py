"""Linking mentions to a terminology: exact, blocked, lexical and vector candidates, fused and gated.

Candidates are rows (query_id, code, name, score); a terminology is (row_id, code, name).  Every retrieval has
an equi-join at its core (name, head token, shared token, or vector block); only what that join leaves is
scored.  A side is broadcast only if it has at most ``BROADCAST_BYTES`` bytes, summed up first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, MapType, StructType

from ..functions import text as X
from ..functions.similarity import token_sort_ratio
from .fuzzy import token_set_join
from .hygiene import shared_table

BROADCAST_BYTES = 8 << 20
VECTOR_BLOCK = 2048
QUERY_SLICE = 256
TERM_BYTES = 128 << 20


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its rows, as written out, are of bounded size; as it is otherwise.

    The size is summed over all rows (strings as UTF-8), so wide rows count for what they are.
    """
    size = sum((F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) for f in df.schema if not isinstance(f.dataType, (ArrayType, MapType, StructType))), F.lit(16))
    size += sum((F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)) for f in df.schema if isinstance(f.dataType, (ArrayType, MapType, StructType))), F.lit(0))
    return F.broadcast(df) if df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= BROADCAST_BYTES else df


def top_k(candidates: DataFrame, k: int, *order) -> DataFrame:
    """The best k codes of each query: the best score of each code, ties to the smaller code (or ``order``)."""
    best = candidates.groupBy("query_id", "code").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *(order or ("code",)))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """Candidates whose normalised name is the query's."""
    t = terms.select("code", "name", X.normalize_for_match(F.col("name")).alias("norm")).distinct()
    q = queries.select("query_id", X.normalize_for_match(F.col("query")).alias("norm"))
    return q.join(small(t), "norm").select("query_id", "code", "name", F.lit(100.0).alias("score"))


def blocked(queries: DataFrame, terms: DataFrame, bar: float = 60.0) -> DataFrame:
    """Candidates with the query's head token whose token-sort ratio is at least ``bar``."""
    t = terms.select("code", "name", X.normalize_for_match(F.col("name")).alias("n"))
    t = t.withColumn("head", X.head_token(F.col("n"))).where("head is not null")
    q = queries.select("query_id", X.normalize_for_match(F.col("query")).alias("q"))
    q = q.withColumn("head", X.head_token(F.col("q"))).where("head is not null")
    scored = q.join(t, "head").withColumn("score", token_sort_ratio(F.col("q"), F.col("n")))
    return scored.where(F.col("score") >= bar).select("query_id", "code", "name", "score")


def fuzzy(queries: DataFrame, terms: DataFrame, bar: float = 78.0, most: int = 30) -> DataFrame:
    """Of all names those whose token-set ratio is at least ``bar``, ``most`` names a query, ties to smaller rows.

    The join is exact (:mod:`spanloom.operators.fuzzy`): it equals scoring every name for every query.
    """
    t = terms.select("row_id", "code", "name", X.normalize_for_match(F.col("name")).alias("n"))
    q = queries.select("query_id", X.normalize_for_match(F.col("query")).alias("q"))
    best = token_set_join(q, t.select("row_id", "n"), bar, most)
    return best.join(t, "row_id").select("query_id", "code", "name", "score")


def bm25(queries: DataFrame, terms: DataFrame, most: int = 50, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """Lexical candidates over white-space tokens; negative idf floored at ``epsilon`` of the mean; score > 0.

    The constants are those of the widespread Okapi implementation.  Ties go to the higher row.
    """
    t = terms.select("row_id", "code", "name", X.words(F.col("name")).alias("ws")).withColumn("dl", F.size("ws"))
    n, avgdl = t.agg(F.count("*"), F.avg("dl")).first()
    tf = t.select("row_id", "dl", F.explode("ws").alias("w")).groupBy("row_id", "dl", "w").agg(F.count("*").alias("tf"))
    df = tf.groupBy("w").agg(F.count("*").alias("df"))
    raw = df.select("w", F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    floor = (raw.agg(F.avg("idf")).first()[0] or 0.0) * epsilon
    idf = raw.select("w", F.when(F.col("idf") < 0, F.lit(floor)).otherwise(F.col("idf")).alias("idf"))
    q = queries.select("query_id", F.explode(X.words(F.col("query"))).alias("w")).groupBy("query_id", "w").agg(F.count("*").alias("qf"))
    part = F.col("qf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl or 1.0)))
    scored = q.join(idf, "w").join(tf, "w").groupBy("query_id", "row_id").agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("row_id"))
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).join(terms.select("row_id", "code", "name"), "row_id").select("query_id", "code", "name", "score", "row_id")


def _merged(row: np.ndarray, col: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of (row, col, score) each row's ``most`` best, by falling score (not a number first, as in Spark), then col; and their places."""
    order = np.lexsort((col, -np.where(np.isnan(score), np.inf, score), row))
    row, col, score = row[order], col[order], score[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    best = place < most
    return row[best], col[best], score[best], place[best]


class _Best:
    """The best rows so far of a block of queries: scores (none: minus infinity) and rows, in order."""

    def __init__(self, ids: np.ndarray, mat: np.ndarray, most: int):
        self.ids, self.mat, self.most = ids, mat, most
        self.size = np.linalg.norm(mat.astype(np.float64), axis=1)
        self.score, self.row = np.full((len(ids), most), -np.inf), np.zeros((len(ids), most), np.int64)
        self.count = np.zeros(len(ids), np.int64)

    def meet(self, t: np.ndarray, of_t: np.ndarray) -> None:
        """Few queries at a time bound the temporaries; only what may reach a query's last place is worked out in doubles, rounded and sorted.

        The product of all has the vectors' own precision; its error is bounded by their lengths.
        """
        unit = np.finfo(np.result_type(self.mat, of_t)).eps * (of_t.shape[1] + 2) * np.linalg.norm(of_t.astype(np.float64), axis=1).max(initial=0)
        for s in range(0, len(self.ids), QUERY_SLICE):
            own = slice(s, min(s + QUERY_SLICE, len(self.ids)))
            raw = self.mat[own] @ of_t.T
            full, error = self.count[own] >= self.most, self.size[own] * unit
            last = np.where(full, self.score[own, -1], -np.inf)
            if not full.all() and len(t) > self.most:
                last = np.fmax(last, -np.partition(-raw, self.most - 1, 1)[:, self.most - 1] - error)
            last = last - error - 1e-8 - np.abs(np.where(np.isfinite(last), last, 0)) * 1e-6
            row, col = np.nonzero(~(raw < last.astype(raw.dtype)[:, None]))
            if not len(row):
                continue
            fresh = np.unique(row)
            held = np.arange(self.most) < self.count[own][fresh, None]
            at, nth = np.nonzero(held)
            rows = np.concatenate([row, fresh[at]])
            cols = np.concatenate([t[col], self.row[own][fresh[at], nth]])
            exact = np.einsum("ij,ij->i", self.mat[own][row], of_t[col], dtype=np.float64)
            scores = np.concatenate([np.round(exact, 9), self.score[own][fresh[at], nth]])
            rows, cols, scores, place = _merged(rows, cols, scores, self.most)
            self.score[own][rows, place], self.row[own][rows, place] = scores, cols
            self.count[own] = np.maximum(self.count[own], np.bincount(rows, minlength=own.stop - own.start))

    def told(self) -> pa.RecordBatch:
        held = np.arange(self.most) < self.count[:, None]
        ends = pa.array(np.concatenate(([0], np.cumsum(self.count))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x[held])) for x in (self.row, self.score)]
        return pa.RecordBatch.from_arrays([pa.array(self.ids), *lists], names=["query_id", "rows", "scores"])


#: Blocks of queries whose best rows a task holds at a time.
HELD = 16


def nearest(queries: DataFrame, terms: DataFrame, most: int, bar: float = -2.0) -> DataFrame:
    """(query_id, found): of each query (query_id, vector) the ``most`` nearest terms (row_id, vector), an array of (score, row_id) in order.

    Terms are packed into blocks of vectors, kept once as a table.  Every block of queries meets all of them (a cartesian
    product, which shuffles nothing), one matrix product each, and holds its best rows as it goes; so what is written
    grows with the queries, and with the square only by a row a query for each ``TERM_BYTES`` of terms.
    """
    spark = terms.sparkSession
    kind = lambda df: np.float32 if isinstance(df.schema["vector"].dataType.elementType, FloatType) else np.float64

    def pack(dtype):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in range(0, batch.num_rows, VECTOR_BLOCK):
                    own = batch.slice(s, VECTOR_BLOCK)
                    ids = np.asarray(own.column(0).cast(pa.int64()))
                    mat = np.array(own.column(1).to_pylist(), np.float64).astype(dtype).reshape(len(ids), -1)
                    yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([mat.tobytes()], pa.binary())], names=["ids", "mat"])

        return run

    q_kind, t_kind = kind(queries), kind(terms)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, _Best] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                q_ids, q_mat, t_ids, t_mat = (batch.column(c)[k].as_buffer() for c in ("q_ids", "q_mat", "t_ids", "t_mat"))
                key = q_ids.to_pybytes()
                if key not in held:
                    if len(held) >= HELD:
                        yield from (x.told() for x in held.values())
                        held = {}
                    ids = np.frombuffer(key, np.int64)
                    held[key] = _Best(ids, np.frombuffer(q_mat.to_pybytes(), q_kind).reshape(len(ids), -1), most)
                t = np.frombuffer(t_ids, np.int64)
                held[key].meet(t, np.frombuffer(t_mat, t_kind).reshape(len(t), -1))
        yield from (x.told() for x in held.values())

    blocks = lambda df, key, dtype: df.select(key, "vector").where("vector is not null").mapInArrow(pack(dtype), "ids binary, mat binary")
    t = shared_table(blocks(terms, "row_id", t_kind).select(F.col("ids").alias("t_ids"), F.col("mat").alias("t_mat")), "vectors")
    size = t.agg(F.coalesce(F.sum(F.octet_length("t_mat") + F.octet_length("t_ids")), F.lit(0))).first()[0]
    cores = spark.sparkContext.defaultParallelism
    queries = queries.select("query_id", "vector")
    queries = queries.repartition(cores) if queries.rdd.getNumPartitions() < cores else queries
    q = blocks(queries, "query_id", q_kind).select(F.col("ids").alias("q_ids"), F.col("mat").alias("q_mat"))
    parts = max(1, -(-size // TERM_BYTES))
    pairs = q.crossJoin(F.broadcast(t) if size <= BROADCAST_BYTES else t.coalesce(parts).hint("shuffle_replicate_nl"))
    found = pairs.mapInArrow(score, "query_id long, rows array<long>, scores array<double>")
    zipped = F.transform(F.arrays_zip("scores", "rows"), lambda x: F.struct(x["scores"].alias("score"), x["rows"].alias("row_id")))
    found = found.select("query_id", F.filter(zipped, lambda x: x["score"] >= bar).alias("found"))
    if parts > 1:
        order = F.array_sort(F.transform(F.flatten(F.collect_list("found")), lambda x: F.struct((-x["score"]).alias("s"), x["row_id"].alias("row_id"), x["score"].alias("score"))))
        best = F.transform(F.slice(order, 1, most), lambda x: F.struct(x["score"].alias("score"), x["row_id"].alias("row_id")))
        found = found.groupBy("query_id").agg(best.alias("found"))
    return found


def dense(queries: DataFrame, terms: DataFrame, most: int = 50, bar: float = -2.0) -> DataFrame:
    """The ``most`` terms (row_id, code, vector) nearest to each query (query_id, vector) by inner product, at least ``bar``; see :func:`nearest`."""
    found = nearest(queries, terms.select("row_id", "vector"), most, bar)
    return found.select("query_id", F.inline("found")).join(terms.drop("vector"), "row_id").select("row_id", "query_id", "score", *[c for c in terms.columns if c not in ("row_id", "vector")])


def hard_negatives(vectors: DataFrame, k: int = 10, spare: int = 6) -> DataFrame:
    """(vec_id, k-th, negative): the nearest other rows of another label, from the nearest k + spare."""
    near = nearest(vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), vectors.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector")), k + spare)
    # Places stand for scores from here on.
    told = near.select("query_id", F.posexplode(F.transform("found", lambda x: x["row_id"])).alias("place", "row_id")).where("row_id <> query_id")
    labels = vectors.where("label is not null").select(F.col("vec_id").alias("row_id"), "label")
    own = vectors.where("label is not null").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    other = told.join(labels, "row_id").join(own, "query_id").where("label <> own")
    w = Window.partitionBy("query_id").orderBy("place", "row_id")
    return other.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).select(F.col("query_id").alias("vec_id"), "nth", F.col("row_id").alias("negative"))


def fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """``first`` for the queries that it has candidates for, ``second`` for the others."""
    return first.unionByName(second.join(first.select("query_id").distinct(), "query_id", "left_anti"))


def abstain(candidates: DataFrame, bar: float) -> DataFrame:
    """Only queries whose best score reaches ``bar``."""
    good = candidates.groupBy("query_id").agg(F.max("score").alias("best")).where(F.col("best") >= bar).select("query_id")
    return candidates.join(good, "query_id", "left_semi")


def fuse(*lists: DataFrame, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of candidate lists: the sum of 1 / (constant + rank), rank from 0; the best-ranked name."""
    ranked = []
    for one in lists:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "code")
        ranked.append(one.select("query_id", "code", "name", (F.row_number().over(w) - 1).alias("rank")))
    both = ranked[0]
    for more in ranked[1:]:
        both = both.union(more)
    return both.groupBy("query_id", "code").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"), F.min(F.struct("rank", "name"))["name"].alias("name"))


def rerank(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates in the order of ``scores(query_id, code, score)``; a single candidate passes as it is."""
    w = Window.partitionBy("query_id")
    n = candidates.withColumn("n", F.count("*").over(w))
    s = scores.select("query_id", "code", F.col("score").alias("pair_score"))
    j = n.join(s, ["query_id", "code"], "left").withColumn("score", F.when(F.col("n") == 1, F.col("score")).otherwise(F.coalesce("pair_score", F.lit(float("-inf")))))
    return j.select("query_id", "code", "name", "score")


def token_jaccard_scores(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """A stand-in for a pair model: the Jaccard overlap of query and name words."""
    q = queries.select("query_id", X.words(F.col("query")).alias("qw"))
    return candidates.join(q, "query_id").select("query_id", "code", X.jaccard(F.col("qw"), X.words(F.col("name"))).alias("score"))


def match_terminology(queries: DataFrame, terms: DataFrame, k: int = 3, bar: float = 78.0) -> DataFrame:
    """Exact names, else fuzzy ones: the fuzzy join sees only queries without an exact hit."""
    hit = exact(queries, terms)
    rest = queries.join(hit.select("query_id").distinct(), "query_id", "left_anti")
    return top_k(hit.unionByName(fuzzy(rest, terms, bar)), k)


def match_drugs(queries: DataFrame, terms: DataFrame, k: int = 1, bar: float = 60.0) -> DataFrame:
    """Exact names, else those that share the head token."""
    hit = exact(queries, terms)
    rest = queries.join(hit.select("query_id").distinct(), "query_id", "left_anti")
    return top_k(hit.unionByName(blocked(rest, terms, bar)), k)


def retrieve_and_rerank(queries: DataFrame, terms: DataFrame, gate: float = 0.7, k: int = 1, scores=token_jaccard_scores) -> DataFrame:
    """Vector candidates, gated by their best score, reordered by a pair score."""
    found = abstain(dense(queries, terms).select("query_id", "code", "name", "score"), gate)
    return top_k(rerank(found, scores(found, queries)), k)


def hybrid(queries: DataFrame, terms: DataFrame, gate: float = 0.7, k: int = 1, scores=token_jaccard_scores) -> DataFrame:
    """As :func:`retrieve_and_rerank`, with lexical candidates fused in once the vectors pass the gate."""
    vectors = abstain(dense(queries, terms).select("query_id", "code", "name", "score"), gate)
    lexical = bm25(queries, terms).drop("row_id").join(vectors.select("query_id").distinct(), "query_id", "left_semi")
    pool = fuse(vectors, lexical).select("query_id", "code", "name", "score")
    return top_k(rerank(pool, scores(pool, queries)), k)


def best_of(lexical: DataFrame, vectors: DataFrame, lexical_score: float = 0.75, weight: float = 1.0, k: int = 3) -> DataFrame:
    """The larger of a fixed score for lexical hits and weighted vector scores, by code."""
    a = lexical.select("query_id", "code", F.lit(lexical_score).alias("score"))
    return top_k(a.union(vectors.select("query_id", "code", (F.col("score") * weight).alias("score"))), k)


def synonym_pairs(names: DataFrame, most: int = 3, seed: int = 1) -> DataFrame:
    """(code, a, b): neighbours among a code's distinct names in hash order, at most ``most`` pairs a code."""
    n = names.select("code", X.normalize_for_match(F.col("name")).alias("name")).distinct()
    w = Window.partitionBy("code").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "name")), "name")
    pairs = n.select("code", F.col("name").alias("a"), F.lead("name").over(w).alias("b"), F.row_number().over(w).alias("nth"))
    return pairs.where(F.col("b").isNotNull() & (F.col("nth") <= most)).select("code", "a", "b")


def bilingual_pairs(terms: DataFrame) -> DataFrame:
    """(code, a, b) where a term's two names (name, other_name) differ once normalised."""
    a, b = X.normalize_for_match(F.col("name")), X.normalize_for_match(F.col("other_name"))
    return terms.select("code", a.alias("a"), b.alias("b")).where("a <> '' and b <> '' and a <> b")


def describe(terms: DataFrame, most: int = 3) -> DataFrame:
    """(code, description): a code's first distinct names by row, the first followed by others in brackets."""
    first = terms.groupBy("code", "name").agg(F.min("row_id").alias("row_id"))
    names = first.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "name"))), lambda x: x["name"]).alias("names"))
    rest = F.array_join(F.slice("names", 2, most - 1), ", ")
    return names.select("code", F.concat(F.element_at("names", 1), F.when(F.size("names") > 1, F.concat(F.lit(" (also: "), rest, F.lit(")"))).otherwise("")).alias("description"))
