"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by BK-trees over block shards.

1. ``fingerprints`` lower-cases A-Z, takes the words ``[^\\x20\\x09-\\x0D]+`` and their ``shingle``-word
   shingles (repeats included; a shorter text is one shingle), hashes each with XXH64 (seed 42) and sets a
   bit where more than half of the hashes have it.  No words: fingerprint zero, linked like any other.
2. Equal fingerprints are one node: everything below works on distinct fingerprints, so copies cost nothing.
3. ``links`` deals each fingerprint to six shards, one for each pair of its four 16-bit blocks: two
   fingerprints within two bits differ in at most two blocks and so meet in at least one shard (the
   pigeonhole principle; nothing is lost).  A wider radius takes that many blocks and two more.  Each shard's fingerprints go into a BK-tree, children keyed by
   their integer Hamming distance to the parent; a lookup follows only edges within the radius.  The trees
   are shipped to where their shard's fingerprints are dealt, not broadcast whole: their total size grows
   with the corpus, a shard's does not.  A shard with more than ``HOT`` fingerprints is dealt again by
   parts of its other two blocks (the same argument, with radius bits over three parts).
4. Within a shard, links are kept as a spanning forest (union-find), never as all pairs; ``components``
   joins the forests by large-star and small-star rounds over tables in the shared checkpoint folder.

A fingerprint has at most 2,080 others within two bits, so a shard's work is bounded by its nodes.
Skew: a fingerprint held by a third of all documents is one node; the joins back to documents are plain
sort-merge joins, whose large partitions Spark splits at run time.

Defined cases: null text is empty (fingerprint zero); repeated rows get a row each and share a component;
rows with a null doc_id get a fingerprint and a component but never name one (if a component has no other
rows its id is null); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shielded, spread, table, text_slices, words

SHINGLE = 3
RADIUS = 2
HOT = 20_000
_RUN = 4096  # shingles whose hash bits are counted at once


def fingerprint_of(text: bytes, starts: np.ndarray, ends: np.ndarray, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, given the bounds of its words in ``text`` (single spaces between them)."""
    n = len(starts)
    if n == 0:
        return 0
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(text[starts[0] : ends[-1]], 42)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(text[a:b], 42) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    value = np.array(hashes, "<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(value), _RUN):
        counts += np.unpackbits(value[k : k + _RUN].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = 2 * counts > len(value)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row for each document, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps: list[int] = []
            for i, j, data, offs in text_slices(batch):
                starts, ends, row = words(data, offs)
                bounds = np.searchsorted(row, np.arange(j - i + 1))
                raw = data.tobytes().lower()
                for r in range(j - i):
                    lo, hi = bounds[r], bounds[r + 1]
                    own = [raw[a:b] for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)]
                    lens = ends[lo:hi] - starts[lo:hi]
                    stops = np.cumsum(lens + 1) - 1
                    fps.append(fingerprint_of(b" ".join(own), stops - lens, stops, shingle))
            value = np.array(fps, np.uint64).view(np.int64) if fps else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Integers under Hamming distance; ``near`` walks only the edges within the radius."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return
        at = 0
        while True:
            d = (self.values[at] ^ value).bit_count()
            down = self.children[at].get(d)
            if down is None:
                self.children[at][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return
            at = down

    def near(self, value: int, radius: int, most: int | None = None) -> list[int]:
        """Nodes (by number of insertion) within the radius of ``value``: all, or the first ``most`` that are met."""
        if not self.values:
            return []
        found, todo = [], [0]
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
                if len(found) == most:
                    break
            kids = self.children[at]
            if len(kids) <= 2 * radius + 1:
                todo += [k for e, k in kids.items() if d - radius <= e <= d + radius]
            else:
                todo += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
        return found


def shard_forest(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(value, root) for every value of a shard that links to a smaller one; roots are their tree's smallest."""
    values = sorted(set(values))
    tree, parent = BKTree(), list(range(len(values)))

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k, v in enumerate(values):
        for m in tree.near(v, radius):
            a, b = top(m), top(k)
            parent[max(a, b)] = min(a, b)
        tree.add(v)
    return [(v, values[top(k)]) for k, v in enumerate(values) if top(k) != k]


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(value, smaller value within the radius): one for every value of a shard that has any, so dense shards stay cheap."""
    tree, out = BKTree(), []
    for v in sorted(set(values)):
        m = tree.near(v, radius, 1)
        out += [(v, tree.values[k]) for k in m]
        tree.add(v)
    return out


def _cuts(width: int, n: int) -> list[tuple[int, int]]:
    """(first bit, bits) of ``n`` parts of ``width`` bits, as even as can be."""
    ends = [-(-width * k // n) for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _bits(value, parts: list[tuple[int, int]]):
    """The parts' bits side by side, as a long of its own (together they are fewer than 64)."""
    out = None
    for at, n in parts:
        own = F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
        out = own if out is None else F.shiftleft(out, n).bitwiseOR(own)
    return out


def _pairs(radius: int) -> list[tuple[list, list]]:
    """For any two of ``radius + 2`` blocks of a fingerprint: the two, and the others."""
    blocks = _cuts(64, radius + 2)
    return [([blocks[a], blocks[b]], [x for k, x in enumerate(blocks) if k not in (a, b)]) for a in range(len(blocks)) for b in range(a)]


def _shards(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, k, shard): a shard for any two blocks of each fingerprint."""
    keys = [F.struct(F.lit(n).alias("k"), _bits(F.col("fp"), own).alias("shard")) for n, (own, _) in enumerate(_pairs(radius))]
    return nodes.select("fp", F.inline(F.array(*keys)))


def _parts(hot: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprints of hot shards dealt again by ``radius + 1`` parts of the bits that their shard leaves open."""
    rest, width = None, []
    for n, (_, others) in enumerate(_pairs(radius)):
        both = _bits(F.col("fp"), others)
        rest = F.when(F.col("k") == n, both) if rest is None else rest.when(F.col("k") == n, both)
        width.append(sum(w for _, w in others))
    keys = [F.struct(F.lit(n).alias("part"), _bits(rest, [c]).alias("bits")) for n, c in enumerate(_cuts(max(width), radius + 1))]
    return hot.select("fp", "k", "shard", F.inline(F.array(*keys)))


def _link_shards(batches: Iterator[pa.RecordBatch], link) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard: gathers each shard's run of fingerprints, which may cross batches, and links it."""
    held: list[int] = []
    last: tuple | None = None
    out: list[tuple[int, int]] = []

    def pack() -> pa.RecordBatch:
        cols = [np.array([e[n] for e in out], np.uint64).view(np.int64) for n in (0, 1)]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        fps = np.asarray(batch.column(0)).view(np.uint64)
        key = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns[1:]])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        bounds = [0, *cuts.tolist(), len(fps)]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            own = tuple(key[:, lo].tolist())
            if own != last:
                if len(held) > 1:
                    out += link(held)
                held, last = [], own
            held += fps[lo:hi].tolist()
            if len(out) > 50_000:
                yield pack()
    if len(held) > 1:
        out += link(held)
    yield pack()


def links(nodes: DataFrame, hot: int = HOT, radius: int = RADIUS, forest=shard_forest) -> DataFrame:
    """(a, b): a spanning set of links between distinct fingerprints ``nodes(fp)`` within the radius.

    With :func:`shard_links` as ``forest`` every row is a link itself, one for each value and shard; not all that is connected then is.
    """
    spread = _shards(nodes, radius)
    sizes = spread.groupBy("k", "shard").agg(F.count("*").alias("n")).where("n > 1")
    spread = spread.join(sizes, ["k", "shard"])
    plain = spread.where(F.col("n") <= hot).select("fp", "k", "shard", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("bits"))
    again = _parts(spread.where(F.col("n") > hot), radius)
    both = plain.union(again.select("fp", "k", "shard", "part", F.col("bits").cast("long")))
    keys = ["k", "shard", "part", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _link_shards(batches, lambda held: forest(held, radius))

    return both.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): for every node of ``edges(a, b)`` the smallest node that it can reach.

    Large-star then small-star in each round; both only relink nodes to the smallest known neighbour, so the
    number of edges never grows.  Stops when a round changes nothing.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        new = cut(small.where("a <> b").distinct(), "edges")
        # Both are sets of (a, b); equal sizes and no new edge: nothing changed.
        same = new.count() == edges.count() and new.join(edges, ["a", "b"], "left_anti").isEmpty()
        edges = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs(doc_id, text)``."""
    prints = cut(fingerprints(docs, shingle), "prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    roots = components(links(nodes.select("fp")))
    labelled = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    best = labelled.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return prints.join(labelled.select("fp", "root").join(best, "root").select("fp", "component_id"), "fp")


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document left of each component: the one with the smallest doc_id.

    Of rows repeated under that doc_id one stays.  Rows with a null doc_id can't be told apart: they stay.
    """
    return shielded(docs, ("doc_id", "text"), _keep_one)


def _keep_one(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    stay = found.where("doc_id = component_id").select(F.col("doc_id").alias("_kept_id")).distinct()
    kept = docs.join(stay, docs.doc_id.cast("long") == stay._kept_id, "left_semi").dropDuplicates(["doc_id"])
    return kept.union(docs.where("doc_id is null"))
