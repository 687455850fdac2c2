"""Hard-negative mining over k-means inverted lists with stored radii.

Rows are (vec_id, label, w) with integer weights; a score is an integer inner product.  An anchor's positives
are its best rows of the same label, its hard negatives for a positive the best rows of other labels whose
score lies in a window below the positive's: ``WINDOW`` per cent of it up to the score itself.

Index: k-means is fitted on a bounded sample (``FIT_ROWS`` rows, ``FIT_WEIGHTS`` numbers; of copies, one), up
to ``CENTROIDS`` centroids, rounded to integers so that all bounds are the same whenever they are computed.
Every row is then listed with its nearest centroid; a list is dealt by hash into blocks of about ``BLOCK_ROWS``
rows, so that a list with a third of all rows is many blocks.  Each list stores its radius, the largest
distance of a row from the centroid.

Search: by Cauchy-Schwarz a row of a list scores at least q.c - |q| r and at most q.c + |q| r.  An anchor
visits lists in falling order of the upper bound, in rounds (``ROUNDS`` lists, then all that are left); it
skips lists that lie outside its window, and stops where the upper bound falls strictly below the k-th score
that the rounds before have found (a list that could tie is still visited, as ties go to smaller ids).  So
nothing is lost, whatever the sample was like; the sample decides only how many lists are read.

Scale: the driver and every task hold centroids, radii and the number of blocks of each list, bounded by
``CENTROIDS``.  Anchors that visit a list travel to its blocks by an equi-join on (list, block), in packs;
only k rows an anchor, positive and block come back.  Where no list can be skipped, that is every anchor
against every row, in blocks.

Defined cases: rows with a null id, label or vector or with a null or non-finite component take no part; an
empty vector scores 0 with all; vectors of different lengths are compared over the places they share; rows
repeated under one id are one row (of different ones the smallest by label, then weights); where sums could
leave what doubles hold exactly, all lists are visited and whole numbers of any size are used, saturated to
long; fewer than k rows give as many as there are; an anchor without positives gives none; an empty table
gives no rows.  Columns beside the three are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, hash_fraction, table
from .topk import select

SCALE = 256
EVERY = 100
POSITIVES = 5
NEGATIVES = 5
WINDOW = 80
CENTROIDS = 1024
FIT_ROWS = 20_000
FIT_WEIGHTS = 1 << 22
FIT_STEPS = 10
BLOCK_ROWS = 8192
BLOCK_WEIGHTS = 1 << 20
PACK_ROWS = 1024
TILE = 32
ROUNDS = (2, 16)
_LONG = 2**63 - 1
_EXACT = float(2**53)


def weights(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, w), one row an id, of the rows that take part."""
    bad = F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    w = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    own = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    one = own.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct("label", w.alias("w"))).alias("r"))
    return one.select("vec_id", F.col("r.label").cast("long").alias("label"), F.col("r.w").alias("w"))


def matrix(lists: pa.Array, width: int, kind=np.float64) -> np.ndarray:
    """A list column as rows of ``width`` numbers, short ones filled with zeros."""
    lens = np.asarray(lists.value_lengths())
    out = np.zeros((len(lists), width), kind)
    row = np.repeat(np.arange(len(lists)), lens)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)] = np.asarray(lists.flatten())
    return out


def fit(sample: np.ndarray, k: int, steps: int = FIT_STEPS) -> np.ndarray:
    """Up to ``k`` integer centroids of a sample, by Lloyd's rounds from evenly spaced rows."""
    rows = np.unique(sample, axis=0)
    if not len(rows):
        return np.zeros((1, sample.shape[1]))
    k = min(k, len(rows))
    mid = rows[np.random.default_rng(7).permutation(len(rows))[:k]].astype(np.float64)
    for _ in range(steps):
        near = nearest(rows, mid)[0]
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(mid)
        np.add.at(total, near, rows)
        mid[count > 0] = total[count > 0] / count[count > 0, None]
    return np.unique(np.rint(mid), axis=0)


def nearest(rows: np.ndarray, mid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and the distance from it."""
    best = np.empty(len(rows), np.int64)
    for s in range(0, len(rows), 4096):
        best[s : s + 4096] = np.argmin((mid * mid).sum(1) - 2 * (rows[s : s + 4096] @ mid.T), axis=1)
    return best, np.sqrt(((rows - mid[best]) ** 2).sum(1))


class Index:
    """Inverted lists: blocks as a written table, and what bounds need of each list."""

    def __init__(self, rows: DataFrame) -> None:
        rows = cut(rows, "vectors")
        most = F.coalesce(F.greatest(F.array_max("w").cast("double"), -F.array_min("w").cast("double")), F.lit(0.0))
        n, width, top = rows.agg(F.count("*"), F.coalesce(F.max(F.size("w")), F.lit(0)), F.coalesce(F.max(most), F.lit(0.0))).first()
        self.width = max(1, int(width))
        #: Sums of products, and of squares for distances, stay whole numbers that doubles hold.
        self.exact = 4.0 * self.width * (top + 1) ** 2 < _EXACT
        self.mid, width = np.zeros((1, self.width)), self.width
        if n and self.exact:
            most_rows = max(1, min(FIT_ROWS, FIT_WEIGHTS // width))
            picked = rows.where(hash_fraction(F.col("vec_id"), 31) < most_rows / n).orderBy("vec_id").limit(2 * most_rows).select("w").toArrow()
            sample = matrix(picked.column("w").combine_chunks(), width) if picked.num_rows else self.mid
            self.mid = fit(sample, max(1, min(CENTROIDS, FIT_WEIGHTS // width, int(n**0.5))))
        mid, exact = self.mid, self.exact

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near, far = (nearest(matrix(batch.column(2), width), mid)) if exact else (np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(far)], names=[*batch.schema.names, "list", "far"])

        self.rows = cut(rows.mapInArrow(assign, "vec_id long, label long, w array<long>, list int, far double"), "lists")
        told = self.rows.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # a row a centroid
        room = max(1, min(BLOCK_ROWS, BLOCK_WEIGHTS // width))
        self.radius, self.blocks_of = np.zeros(len(mid)), np.zeros(len(mid), np.int64)
        for r in told:
            self.radius[r["list"]], self.blocks_of[r["list"]] = r["far"] * (1 + 1e-9) + 1e-6, -(-r["n"] // room)
        deal = F.element_at(F.lit(self.blocks_of.tolist() or [1]), F.col("list") + 1)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, key = [], None

            def flush() -> pa.RecordBatch:
                t = pa.Table.from_batches(held)
                ids, labels = t.column("vec_id").to_numpy(), t.column("label").to_numpy()
                flat = matrix(t.column("w").combine_chunks(), width, np.int64)
                cells = [[key[0]], [key[1]], [ids.tobytes()], [labels.tobytes()], [flat.tobytes()]]
                return pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(cells, (pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=["list", "block", "ids", "labels", "w"])

            for batch in batches:
                where = np.stack([np.asarray(batch.column("list")), np.asarray(batch.column("block"))], 1)
                starts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1).tolist(), len(where)]
                for a, b in zip(starts[:-1], starts[1:], strict=True):
                    if b > a:
                        now = tuple(where[a].tolist())
                        if held and now != key:
                            yield flush()
                            held = []
                        key = now
                        held.append(batch.slice(a, b - a))
            if held:
                yield flush()

        dealt = self.rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(5)), deal).cast("int")).drop("far")
        packed = dealt.repartition("list", "block").sortWithinPartitions("list", "block", "vec_id").mapInArrow(pack, "list int, block int, ids binary, labels binary, w binary")
        self.blocks = cut(packed, "blocks")

    def search(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor_id, target_id, rank, vec_id, score): for each target of each query its k best rows.

        ``queries(vec_id, label, w, targets array<struct<id, high>>)``: with ``same``, rows of the same label but
        the query itself; without, rows of other labels that score at most ``high`` and at least ``WINDOW`` per
        cent of it.
        """
        queries = cut(queries.select("vec_id", "label", "w", F.col("targets.id").alias("target"), F.col("targets.high").alias("high")), "queries")
        found, skip = None, 0
        order = Window.partitionBy("anchor_id", "target_id").orderBy(F.desc("score"), "vec_id")
        for take in (*ROUNDS, None) if self.exact else (None,):
            now = queries.withColumn("kth", F.expr("transform(target, x -> cast(null as bigint))"))
            if found is not None:
                worst = found.groupBy("anchor_id", "target_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth")).where("kth is not null")
                by = worst.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("target_id", "kth"))).alias("known"))
                now = queries.join(by, "vec_id", "left").withColumn("kth", F.transform("target", lambda t: F.try_element_at("known", t))).drop("known")
            got = self._visit(now, same, k, skip, take)
            both = got if found is None else found.drop("rank").union(got)
            best = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            found = cut(best.select("anchor_id", "target_id", "vec_id", "score", "rank"), "found")
            skip += take or 0
        return found.select("anchor_id", "target_id", "rank", "vec_id", "score")

    def _visit(self, queries: DataFrame, same: bool, k: int, skip: int, take: int | None) -> DataFrame:
        mid, radius, width, exact, blocks_of = self.mid, self.radius, self.width, self.exact, self.blocks_of

        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for s in range(0, whole.num_rows, PACK_ROWS):
                    batch = whole.slice(s, PACK_ROWS)
                    ids, labels, w = np.asarray(batch.column(0)), np.asarray(batch.column(1)), matrix(batch.column(2), width, np.int64)
                    targets, highs, kths = (batch.column(c).to_pylist() for c in (3, 4, 5))
                    go = visits(w, highs, kths, mid, radius, skip, take) if exact else np.ones((len(w), 1), bool)
                    rows = []
                    for c in np.flatnonzero(go.any(0) & (blocks_of > 0)).tolist():
                        i = np.flatnonzero(go[:, c])
                        rows.append((c, ids[i].tobytes(), labels[i].tobytes(), w[i].tobytes(), [targets[x] for x in i], [highs[x] for x in i]))
                    kinds = (pa.int32(), *[pa.binary()] * 3, *[pa.list_(pa.list_(pa.int64()))] * 2)
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], y) for c, y in enumerate(kinds)], names=["list", "q_ids", "q_labels", "q_w", "target", "high"])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = np.float64 if exact else object
            for batch in batches:
                for p in batch.to_pylist():
                    ids, labels = np.frombuffer(p["ids"], np.int64), np.frombuffer(p["labels"], np.int64)
                    w = np.frombuffer(p["w"], np.int64).reshape(len(ids), width).astype(kind)
                    q_ids, q_labels = np.frombuffer(p["q_ids"], np.int64), np.frombuffer(p["q_labels"], np.int64)
                    q_w = np.frombuffer(p["q_w"], np.int64).reshape(len(q_ids), width).astype(kind)
                    out: list[tuple] = []
                    for s in range(0, len(q_ids), TILE):
                        some = slice(s, s + TILE)
                        scores = q_w[some] @ w.T
                        scores = scores.astype(np.int64) if exact else np.clip(scores, -_LONG - 1, _LONG)
                        target, high = p["target"][some], p["high"][some]
                        row = np.repeat(np.arange(len(target)), [len(t) for t in target])
                        flat, top = np.array([x for t in target for x in t], np.int64), [x for h in high for x in h]
                        mine = scores[row]
                        ok = (q_labels[some][row][:, None] == labels) == same
                        if same:
                            ok &= q_ids[some][row][:, None] != ids
                        else:
                            bar = np.array(top, mine.dtype)[:, None]
                            ok &= ((mine <= bar) & (100 * mine >= WINDOW * bar)).astype(bool)
                        t, r = np.nonzero(select(mine, ~ok, k))
                        out.append((q_ids[some][row[t]], flat[t], ids[r], mine[t, r].astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(4)], names=["anchor_id", "target_id", "vec_id", "score"])

        planned = queries.select("vec_id", "label", "w", "target", "high", "kth").mapInArrow(plan, "list int, q_ids binary, q_labels binary, q_w binary, target array<array<long>>, high array<array<long>>")
        last = F.element_at(F.lit(blocks_of.tolist()), F.col("list") + 1) - 1
        dealt = planned.withColumn("block", F.explode(F.sequence(F.lit(0), last.cast("int"))))
        # A block is megabytes and compresses well: Spark would take the table for small and broadcast all of it.
        return dealt.join(self.blocks.hint("merge"), ["list", "block"]).drop("list", "block").mapInArrow(score, "anchor_id long, target_id long, vec_id long, score long")


def visits(w: np.ndarray, highs: list, kths: list, mid: np.ndarray, radius: np.ndarray, skip: int, take: int | None) -> np.ndarray:
    """Which lists each query visits now: from place ``skip`` on by upper bound, those that can still matter to a target."""
    q = w.astype(np.float64)
    centre = q @ mid.T
    reach = np.sqrt((q * q).sum(1))[:, None] * radius
    slack = 1e-9 * (np.abs(centre) + reach) + 1e-6
    high, low = centre + reach + slack, centre - reach - slack
    place = np.empty(high.shape, np.int64)
    np.put_along_axis(place, np.argsort(-high, axis=1, kind="stable"), np.arange(high.shape[1])[None, :], 1)
    go = np.zeros(high.shape, bool)
    for i, (tops, bars) in enumerate(zip(highs, kths, strict=True)):
        for top, bar in zip(tops, bars, strict=True):
            least = max(-np.inf if top is None else WINDOW * top / 100, -np.inf if bar is None else bar)
            go[i] |= (high[i] >= least) & (low[i] <= (np.inf if top is None else top))
    return go & (place >= skip) & (place < (np.inf if take is None else skip + take))


def mine(rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows(vec_id, label, w)``."""
    index = Index(rows)
    anchors = index.rows.where(F.col("vec_id") % every == 0).repartition("list").sortWithinPartitions("list", "vec_id").drop("list", "far")
    anchors = cut(anchors, "anchors")
    nothing = F.array(F.struct(F.lit(-1).cast("long").alias("id"), F.lit(None).cast("long").alias("high")))
    best = index.search(anchors.withColumn("targets", nothing), True, positives)
    best = best.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    targets = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("high")))).alias("targets"))
    found = index.search(anchors.join(targets, "vec_id"), False, negatives)
    found = found.select("anchor_id", F.col("target_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(best, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh row are moved on first, so that some near rows differ in label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(weights(table(spark, sf_dir, "embeddings").withColumn("label", moved)))
