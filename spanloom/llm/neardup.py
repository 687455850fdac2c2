"""Near-duplicate texts for the pipeline: SimHash fingerprints in BK-trees, and exact Jaccard similarity of word shingles.

Two texts are near copies if their words (A-Z lower-cased) are the same, or if the Jaccard similarity of their
sets of ``SHINGLE``-word shingles is at least ``NEAR`` (a shorter text is one shingle).

1. Texts with the same words are one node (a 64-bit hash): copies cost nothing below.  A node's fingerprint has
   a bit where more than half of its shingles' hashes have it.  Fingerprints within ``RADIUS`` bits are found by
   the BK-trees of :func:`simhash.links`; links whose sets are as near as ``NEAR`` make the first components.
   At a similarity of 0.8 fingerprints differ in about ten bits, more than any blocks can deal, so steps 2 to 4
   are the exact way for what the trees leave apart; pairs within a first component aren't looked at again.
2. Prefix filter: in any one order of all shingles, two sets of similarity t share a shingle among the first
   n - ceil(t n) + 1 of each.  The order puts common shingles last.  Which are common is told by a sample of
   nodes, at most ``COMMON`` of them; a wrong guess there costs time, never a pair.
3. Nodes meet on prefix shingles.  Up to ``BIG`` nodes on a shingle are paired all with all.  More are first
   paired with the smallest and with their neighbours in size; when these pairs are checked, only nodes that are
   still in different components are compared, in blocks of at most about ``BLOCK`` nodes and ``BLOCK_SHINGLES``
   shingles, so that no task holds a group.  A block makes a spanning forest of its links, never all pairs.
4. A node's parity map has a bit for each residue of a shingle's hash, set if an odd number of its shingles have
   it.  Maps differ in no more bits than sets in shingles, so a pair whose maps differ in more than a ninth of
   both sizes can't be alike: such pairs go before any set is read (nothing is lost).  Half-alike texts with a
   shingle in common are compared by maps alone and make no rows.
5. Every pair left is checked on whole sets, which are read for its nodes only.  Components are those of
   :func:`simhash.components`, over links that were all checked.

Comparing the maps of many half-alike texts stays quadratic in their number, in blocks.

Defined cases: null text is empty, empty texts are copies of each other; a null doc_id joins a component but
never names it; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, most_frequent, prefix_hash, shielded, span_hash, text_slices, words
from .simhash import components, links, shard_links

SHINGLE = 5
NEAR = (4, 5)  # as a fraction: all comparisons are of whole numbers
RADIUS = 4
BIG = 32
COMMON = 1 << 18
SAMPLE = 8
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
MAP_BITS = 512  # at least; a power of two
_RUN = 1 << 16  # shingles whose hash bits are counted at once

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of a slice's texts; rows and hashes of their distinct shingles, in this order."""
    low = _LOWER[data]
    starts, ends, row = words(low, offs)
    h = span_hash(prefix_hash(low), starts, ends)
    sums = prefix_hash(h)
    rows = np.arange(len(offs) - 1)
    lo, hi = np.searchsorted(row, rows), np.searchsorted(row, rows, "right")
    k = np.arange(len(h))
    k = k[(k + SHINGLE <= hi[row]) | (k == lo[row])]
    sh, own = span_hash(sums, k, np.minimum(k + SHINGLE, hi[row[k]])), row[k]
    order = np.lexsort((sh, own))
    sh, own = sh[order], own[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (own[1:] != own[:-1])
    return span_hash(sums, lo, hi), own[new], sh[new]


def _slices(batches: Iterator[pa.RecordBatch], once: bool = True) -> Iterator[tuple]:
    """(batch, first row, end row, nodes, rows, shingles); with ``once`` a task gives a node's shingles one time."""
    seen: set[int] = set()
    for batch in batches:
        for i, j, data, offs in text_slices(batch):
            node, own, sh = shingle_sets(data, offs)
            if once:
                fresh = np.zeros(len(node), bool)
                for r, v in enumerate(node.tolist()):
                    if v not in seen:
                        seen.add(v)
                        fresh[r] = True
                own, sh = own[fresh[own]], sh[fresh[own]]
            yield batch, i, j, node, own, sh


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def prints(n_rows: int, own: np.ndarray, sh: np.ndarray) -> np.ndarray:
    """The fingerprint of each row's shingles (``own`` ascends): bits that more than half of their hashes have."""
    counts = np.zeros((n_rows, 64), np.int64)
    for k in range(0, len(sh), _RUN):
        row = own[k : k + _RUN]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        bits = np.unpackbits(np.ascontiguousarray(sh[k : k + _RUN], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts[row[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    size = np.bincount(own, minlength=n_rows)
    return np.packbits(2 * counts > size[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def parity_maps(n_rows: int, own: np.ndarray, sh: np.ndarray) -> pa.Array:
    """The parity map of each row's shingles: as many bits as shingles, rounded up to a power of two."""
    size = np.maximum(MAP_BITS, np.bincount(own, minlength=n_rows))
    width = 1 << np.ceil(np.log2(size)).astype(np.int64)
    ends = np.r_[0, np.cumsum(width)]
    flat = ends[own] + (sh & (width[own] - 1).astype(np.uint64)).astype(np.int64)
    bits = np.packbits((np.bincount(flat, minlength=ends[-1]) & 1).astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), n_rows, [None, pa.py_buffer((ends // 8).astype(np.int32)), pa.py_buffer(bits)])


def _folded(x: bytes, n: int) -> int:
    """A map as a number of ``n`` bytes: folding halves keeps parities."""
    v, have = int.from_bytes(x, "little"), len(x)
    while have > n:
        have //= 2
        v = (v >> (8 * have)) ^ (v & ((1 << (8 * have)) - 1))
    return v


def may_be_alike(x: bytes, y: bytes, n: int) -> bool:
    """False only if sets of ``n`` shingles together, with these maps, are less alike than ``NEAR``."""
    width = min(len(x), len(y))
    return sum(NEAR) * (_folded(x, width) ^ _folded(y, width)).bit_count() <= (NEAR[1] - NEAR[0]) * n


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, node, size, map, fp) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, j, node, own, sh in _slices(batches, once=False):
            size = np.bincount(own, minlength=j - i).astype(np.int32)
            columns = [batch.column("doc_id").slice(i, j - i), _long(node), pa.array(size), parity_maps(j - i, own, sh), _long(prints(j - i, own, sh))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "size", "map", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, node long, size int, map binary, fp long")


def close_prints(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between ``nodes(node, fp)`` whose fingerprints are equal or, by the BK-trees, within the radius."""
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    equal = nodes.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    one, two = (first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node")) for c in ("a", "b"))
    apart = links(first.select("fp"), radius=radius, forest=shard_links).join(one, "a").join(two, "b")
    return equal.union(apart.select(F.least("a_node", "b_node"), F.greatest("a_node", "b_node")))


def common_shingles(docs: DataFrame, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of shingles that many nodes of a sample hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, node, own, sh in _slices(batches):
            yield pa.RecordBatch.from_arrays([_long(sh[node[own] % np.uint64(SAMPLE) == 0])], names=["sh"])

    counts = docs.select("text").mapInArrow(run, "sh long").groupBy("sh").agg(F.count("*").alias("n")).where("n >= 3")
    found = most_frequent(cut(counts, "common"), "sh", most).toArrow()
    sh, n = np.asarray(found["sh"]).astype(np.int64).view(np.uint64), np.asarray(found["n"]).astype(np.int64)
    order = np.argsort(sh)
    return sh[order], n[order]


def prefixes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(sh, node, size): the shingles by which nodes meet."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for _, _, _, node, own, sh in _slices(batches):
            rank = np.zeros(len(sh), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, sh), len(known) - 1)
                rank = np.where(known[at] == sh, counts[at], 0)
            size = np.bincount(own, minlength=len(node))
            order = np.lexsort((sh, rank, own))
            place = np.arange(len(sh)) - (np.cumsum(size) - size)[own]
            need = size - (NEAR[0] * size + NEAR[1] - 1) // NEAR[1] + 1
            pick = order[place < need[own]]
            yield pa.RecordBatch.from_arrays([_long(sh[pick]), _long(node[own[pick]]), pa.array(size[own[pick]].astype(np.int32))], names=["sh", "node", "size"])

    return docs.select("text").mapInArrow(run, "sh long, node long, size int")


def sets(docs: DataFrame) -> DataFrame:
    """(node, sh): the shingles of each node, an array; a node may come from several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, node, own, sh in _slices(batches):
            size = np.bincount(own, minlength=len(node))
            ends = np.r_[0, np.cumsum(size)].astype(np.int32)
            full = np.flatnonzero(size)
            lists = pa.ListArray.from_arrays(pa.array(ends), _long(sh)).take(pa.array(full))
            yield pa.RecordBatch.from_arrays([_long(node[full]), lists], names=["node", "sh"])

    return docs.select("text").mapInArrow(run, "node long, sh array<long>")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Columns of rows sorted by the first: whole groups only, however batches cut them, and each node once."""
    held: list[np.ndarray] = []  # batches since the last group began; joined once, when it ends
    for batch in batches:
        rows = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns])
        if not rows.shape[1]:
            continue
        if held and held[0][0, 0] == rows[0, -1]:
            held.append(rows)
            continue
        tail = int(np.searchsorted(rows[0], rows[0, -1]))
        done = [*held, rows[:, :tail]]
        if sum(x.shape[1] for x in done):
            yield _once(np.concatenate(done, axis=1))
        held = [rows[:, tail:]]
    if held:
        yield _once(np.concatenate(held, axis=1))


def _once(rows: np.ndarray) -> np.ndarray:
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(0)
    return rows[:, new]


def _meet(postings: DataFrame, big: int) -> DataFrame:
    """(big, a, b, size): pairs of nodes; and, with ``big``, shingle, node and size of what is only paired in part."""

    def pack(is_big: bool, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), is_big)), pa.array(a), pa.array(b), pa.array(size.astype(np.int32))], names=["big", "a", "b", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sh, node, size in _groups(batches):
            first = np.flatnonzero(np.r_[True, sh[1:] != sh[:-1]])
            n = np.diff(np.r_[first, len(sh)])
            lead, many = np.repeat(first, n), np.repeat(n, n)
            at = np.arange(len(sh))
            for d in range(1, big):
                i = at[: len(sh) - d] if d < len(sh) else at[:0]
                i = i[(lead[i] == lead[i + d]) & ((many[i] <= big) | (d == 1)) & (NEAR[1] * size[i] >= NEAR[0] * size[i + d])]
                if not len(i):
                    if d > 1:
                        break
                    continue
                yield pack(False, np.minimum(node[i], node[i + d]), np.maximum(node[i], node[i + d]), size[i])
            i = at[(many > big) & (lead != at)]
            i = i[NEAR[1] * size[lead[i]] >= NEAR[0] * size[i]]
            yield pack(False, np.minimum(node[lead[i]], node[i]), np.maximum(node[lead[i]], node[i]), size[i])
            i = at[many > big]
            yield pack(True, sh[i], node[i], size[i])

    return postings.repartition("sh").sortWithinPartitions("sh", "size", "node").mapInArrow(run, "big boolean, a long, b long, size int")


def _near(members: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of a block pair's nodes, sorted by size, those after it that the least maps allow to be alike, and by how much they differ."""
    node, size, side = (members[c].to_numpy() for c in ("node", "size", "side"))
    within = bool((members["lo"] == members["hi"]).iloc[0])
    least = np.array([np.frombuffer(_folded(m, MAP_BITS // 8).to_bytes(MAP_BITS // 8, "little"), np.uint64) for m in members["map"]])
    for i in range(len(node) - 1):
        j = np.arange(i + 1, int(np.searchsorted(size, NEAR[1] * size[i] // NEAR[0], "right")))
        j = j[within | (side[j] != side[i])]
        apart = np.bitwise_count(least[j] ^ least[i]).sum(1, dtype=np.int64)
        near = sum(NEAR) * apart <= (NEAR[1] - NEAR[0]) * (size[j] + size[i])
        yield i, j[near], apart[near]


def _wanted(members: pd.DataFrame) -> pd.DataFrame:
    """Of a block pair's rows those nodes that some other of another root may be alike to, by maps alone."""
    members = members.drop_duplicates("node").sort_values(["size", "node"])
    root, maps, size = members["root"].to_numpy(), members["map"].tolist(), members["size"].to_numpy()
    take = np.zeros(len(members), bool)
    for i, j, _ in _near(members):
        for k in j[root[j] != root[i]].tolist():
            if not (take[i] and take[k]) and may_be_alike(maps[i], maps[k], int(size[i] + size[k])):
                take[i] = take[k] = True
    return members.loc[take, ["sh", "lo", "hi", "node"]]


def _compare(members: pd.DataFrame) -> pd.DataFrame:
    """Of a block pair's rows a spanning forest of the links between different roots."""
    members = members.drop_duplicates("node").sort_values(["size", "node"])
    node, size = members["node"].to_numpy(), members["size"].to_numpy()
    maps, whole = members["map"].tolist(), members["set"].tolist()
    root, out = np.unique(members["root"].to_numpy(), return_inverse=True)[1], []
    for i, j, apart in _near(members):
        other = root[j] != root[i]
        j = j[other][np.argsort(apart[other], kind="stable")]
        while len(j):
            k, j, both = int(j[0]), j[1:], int(size[i] + size[j[0]])
            if may_be_alike(maps[i], maps[k], both) and sum(NEAR) * len(np.intersect1d(whole[i], whole[k], True)) >= NEAR[0] * both:
                out.append((min(node[i], node[k]), max(node[i], node[k])))
                root[root == root[k]] = root[i]
                j = j[root[j] != root[i]]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _links_apart(members: DataFrame, docs: DataFrame, block: int = BLOCK) -> DataFrame | None:
    """(a, b): links between nodes of ``members(sh, node, size, root, map)`` of different roots; None if there can be none.

    A shingle's nodes are dealt to blocks by a hash; every two blocks, and every block with itself, are a group.
    Groups are gone through by sizes and maps first; sets travel only to groups, and for nodes, that these leave.
    """
    blocks = F.greatest(F.count("*") / block, F.sum("size") / BLOCK_SHINGLES)
    blocks = members.groupBy("sh").agg(F.ceil(blocks).cast("int").alias("blocks"), F.countDistinct("root").alias("roots")).where("roots > 1")
    told = members.join(blocks, "sh").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    told = cut(told.select("sh", "node", "size", "root", "map", "own", "blocks"), "members")
    if told.isEmpty():
        return None
    met = told.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("sh", "node", "size", "root", "map", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") < F.col("other")).alias("side"))
    keys = ["sh", "lo", "hi"]
    left = cut(met.groupBy(*keys).applyInPandas(_wanted, "sh long, lo int, hi int, node long"), "wanted")
    if left.isEmpty():
        return None
    whole = cut(sets(docs).join(left.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "sets")
    full = left.join(met, [*keys, "node"]).join(whole.select("node", F.col("sh").alias("set")), "node")
    return cut(full.groupBy(*keys).applyInPandas(_compare, "a long, b long").distinct(), "alike")


def _allowed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` of different roots that the maps of ``nodes(node, size, map, root)`` allow to be alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n = (batch.column(c).to_pylist() for c in ("x", "y", "n"))
            yield batch.select(["a", "b"]).filter(pa.array([may_be_alike(*row) for row in zip(x, y, n, strict=True)], pa.bool_()))

    one = nodes.select(F.col("node").alias("a"), F.col("map").alias("x"), F.col("size").alias("n1"), F.col("root").alias("r1"))
    two = nodes.select(F.col("node").alias("b"), F.col("map").alias("y"), F.col("size").alias("n2"), F.col("root").alias("r2"))
    both = pairs.join(one, "a").join(two, "b").where("r1 <> r2").select("a", "b", "x", "y", (F.col("n1") + F.col("n2")).alias("n"))
    return both.mapInArrow(run, "a long, b long")


def _alike(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` (a written table) whose sets, read from ``docs``, are as near as ``NEAR``."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    whole = cut(sets(docs).join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")
    x, y = whole.select(F.col("node").alias("a"), F.col("sh").alias("x")), whole.select(F.col("node").alias("b"), F.col("sh").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "a").join(y, "b").where(sum(NEAR) * both >= NEAR[0] * (F.size("x") + F.size("y"))).select("a", "b")


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` with the root of each one's component."""
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def close_texts(docs: DataFrame, nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links of :func:`close_prints` whose sets are as near as ``NEAR``."""
    pairs = cut(_allowed(close_prints(nodes, radius), nodes.withColumn("root", F.col("node"))), "close")
    return cut(_alike(pairs, docs), "alike")


def near_texts(docs: DataFrame, big: int = BIG, block: int = BLOCK, radius: int = RADIUS) -> DataFrame:
    """(component_id): the smallest doc_id of each component of near copies among ``docs(doc_id, text)``."""
    firsts = [F.first(c).alias(c) for c in ("size", "map", "fp")]
    nodes = cut(marks(docs).groupBy("node").agg(F.min("doc_id").alias("first_doc"), *firsts), "nodes")
    close = close_texts(docs, nodes, radius)
    rooted = cut(_rooted(nodes.select("node", "size", "map"), components(close)), "rooted")
    met = cut(_meet(prefixes(docs, common_shingles(docs)), big), "met")
    pairs = cut(_allowed(met.where("not big").select("a", "b").distinct(), rooted), "pairs")
    edges = close.union(cut(_alike(pairs, docs), "alike"))
    roots = components(edges)
    members = met.where("big").select(F.col("a").alias("sh"), F.col("b").alias("node"))
    told = members.join(_rooted(nodes.select("node", "size", "map"), roots), "node")
    more = _links_apart(told, docs, block)
    if more is not None and not more.isEmpty():
        roots = components(edges.union(more))
    return _rooted(nodes.select("node", "first_doc"), roots).groupBy("root").agg(F.min("first_doc").alias("component_id")).select("component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document left of each component: the one with the smallest doc_id.

    Of rows repeated under that doc_id one stays.  Rows with a null doc_id can't be told apart: they stay.
    """
    return shielded(docs, ("doc_id", "text"), _keep_one)


def _keep_one(docs: DataFrame) -> DataFrame:
    stay = near_texts(docs).select(F.col("component_id").alias("_kept_id")).where("_kept_id is not null")
    kept = docs.join(stay, docs.doc_id.cast("long") == stay._kept_id, "left_semi").dropDuplicates(["doc_id"])
    return kept.union(docs.where("doc_id is null"))
