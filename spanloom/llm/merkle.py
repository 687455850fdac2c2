"""Merkle manifest of a table: a leaf a document, a subtree a source, one root, and every leaf's proof.

Leaves are hashes of a document's fields; those of a source ascend by doc_id and are joined by runs of
``WIDTH`` into their hash until one is left, the source's subroot; subroots, in order of source, are joined
alike into the root.

Places come without a window over a whole source: leaves are range-partitioned by (source, doc_id), numbered
inside each partition, and moved on by the counts of the partitions before (a row a source and partition).
Leaves then meet in aligned blocks of ``WIDTH ** LEVELS``.  A first pass streams a block through a treehash
stack, which holds at most ``WIDTH`` nodes a level, and leaves the block's root; the block roots are the
leaves of the next stage, and so on up to the subroots and the root.  On the way down, stage by stage, each
block gets the path above its root and walks its leaves by the schedule of Merkle traversal: a level keeps
the run that authenticates the present leaf, and a treehash stack that takes in one leaf a step and so has the
next run ready just when the walk enters it.  Nodes in memory are logarithmic in the block; the shared upper
path is appended to every leaf's own.

Scale: texts are read once, by a projection; what is shuffled is a hundred bytes a document.  A source with a
third of all rows is many partitions and many blocks, and a stage has a ``WIDTH ** LEVELS``-th of the rows of
the one below.

Defined cases: a null field is ``-``; null ids come first in their source and are never tampered with; repeated
rows are leaves each (equal ids in order of their leaf); a lone leaf is its source's subroot, a lone subroot
the root, with an empty proof; an empty table gives no rows; columns beside the five are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, spread, table

WIDTH = 16
LEVELS = 2
BLOCK = WIDTH**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
_PATH = "array<struct<left:string,right:string>>"


def _h(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """The hash of some fields: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    one = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c), F.lit(":"), c))
    return F.sha2(F.concat(*[one(v.cast("string")) for v in values]), 256)


class Treehash:
    """A stack that turns leaves, one at a time, into the nodes of one level."""

    def __init__(self, level: int) -> None:
        self.level, self.open = level, [[] for _ in range(level + 1)]

    def feed(self, digest: str) -> None:
        self.open[0].append(digest)
        for k in range(self.level):
            if len(self.open[k]) < WIDTH:
                break
            self._close(k)

    def _close(self, k: int) -> None:
        self.open[k + 1].append(_h(self.open[k]))
        self.open[k] = []

    def take(self) -> list[str]:
        """The nodes so far; a run that isn't full is closed as it is."""
        for k in range(self.level):
            if self.open[k]:
                self._close(k)
        out, self.open[self.level] = self.open[self.level], []
        return out


def height(n: int) -> int:
    """Levels that ``n`` nodes of one tree climb within one block."""
    k = 0
    while n > 1 and k < LEVELS:
        n, k = -(-n // WIDTH), k + 1
    return k


def walk(leaves: list[str], levels: int) -> Iterator[list[list[str]]]:
    """For each leaf of a block in turn, the run that holds its node on each level."""
    spans = [WIDTH ** (k + 1) for k in range(levels)]
    stacks = [Treehash(k) for k in range(levels)]
    runs = []
    for stack, span in zip(stacks, spans, strict=True):
        for d in leaves[:span]:
            stack.feed(d)
        runs.append(stack.take())
    for i in range(len(leaves)):
        yield runs
        for k, (stack, span) in enumerate(zip(stacks, spans, strict=True)):
            if i + span < len(leaves):
                stack.feed(leaves[i + span])
            if (i + 1) % span == 0:
                runs[k] = stack.take()


def ranked(nodes: DataFrame, group: str, *order: str) -> DataFrame:
    """``nodes`` with ``pos``, the place in its group, and ``n``, the group's size."""
    at = nodes.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    at = cut(at, "ordered").withColumn("_part", F.shiftright("_at", 33))
    counts = at.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_own"), (before - F.col("_first")).alias("_move"), F.sum("_n").over(whole).alias("n"))
    met = at.join(counts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_own")))
    return met.withColumn("pos", F.col("_at") + F.col("_move")).drop("_at", "_part", "_own", "_group", "_move")


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, block, n, digest) of nodes sorted by group and place: each block's root."""
    key, stack, out = None, None, []
    for batch in batches:
        for grp, block, n, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key is None or key[:2] != (grp, block):
                if key is not None:
                    out.append((*key, stack.take()[0]))
                key, stack = (grp, block, n), Treehash(height(n))
            stack.feed(digest)
        if len(out) > 4096:
            yield _rows(out)
            out = []
    if key is not None:
        out.append((*key, stack.take()[0]))
    yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], y) for c, y in enumerate(kinds)], names=["grp", "block", "n", "digest"])


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tag, path, sub, root) of nodes sorted by block, each block led by a row with the path above it."""
    key, upper, leaves, tags = None, None, [], []

    def flush() -> pa.RecordBatch:
        levels = height(upper["n"])
        left, right, paths = [], [], [0]
        above = upper["path"] or []
        for i, runs in enumerate(walk(leaves, levels)):
            for k in range(levels):
                mine = i // WIDTH**k % WIDTH
                left.append("".join(runs[k][:mine]))
                right.append("".join(runs[k][mine + 1 :]))
            left += [s["left"] for s in above]
            right += [s["right"] for s in above]
            paths.append(len(left))
        steps = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], fields=list(_STEP))
        path = pa.ListArray.from_arrays(pa.array(paths, pa.int32()), steps)
        n = len(leaves)
        return pa.RecordBatch.from_arrays([pa.array(tags, pa.string()), path, pa.array([upper["sub"]] * n, pa.string()), pa.array([upper["root"]] * n, pa.string())], names=["tag", "path", "sub", "root"])

    for batch in batches:
        for r in batch.to_pylist():
            if r["lead"]:
                if leaves:
                    yield flush()
                upper, leaves, tags = r, [], []
            else:
                leaves.append(r["digest"])
                tags.append(r["tag"])
    if leaves:
        yield flush()


def authenticate(nodes: DataFrame, above) -> DataFrame:
    """(tag, path, sub, root) of ``nodes(grp, pos, n, digest, tag)``, the trees of all groups.

    ``above`` gets the groups' roots (grp, digest) and gives (grp, path, sub, root): what stands above them.
    """
    block = F.floor(F.col("pos") / BLOCK).cast("long")
    dealt = nodes.withColumn("block", block)
    seen = dealt.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos").select("grp", "block", "n", "digest")
    roots = cut(seen.mapInArrow(_roots, "grp string, block long, n long, digest string"), "roots")
    if roots.where(F.col("n") > BLOCK).isEmpty():
        upper = above(roots.select("grp", "digest")).select("grp", F.lit(0).cast("long").alias("block"), "path", "sub", "root")
    else:
        tag = F.to_json(F.struct("grp", "block"))
        rise = roots.select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), "digest", tag.alias("tag"))
        key = F.from_json("tag", "grp string, block long")
        upper = authenticate(rise, above).select(key["grp"].alias("grp"), key["block"].alias("block"), "path", "sub", "root")
    own = roots.select(F.col("grp").alias("_grp"), F.col("block").alias("_block"), "n")
    lead = upper.join(own, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("block") == F.col("_block"))).select("grp", "block", F.lit(-1).cast("long").alias("pos"), F.lit(True).alias("lead"), "n", "path", "sub", "root")
    both = lead.unionByName(dealt.select("grp", "block", "pos", F.lit(False).alias("lead"), "digest", "tag"), allowMissingColumns=True)
    return cut(both.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos").mapInArrow(_descend, f"tag string, path {_PATH}, sub string, root string"), "paths")


def manifest(docs: DataFrame, keep: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, *keep) of ``docs``.

    ``proof`` lists, level by level from the leaf, the digests to the left and to the right of one's own node in
    its run, each as one string.  ``keep`` are more columns of strings, from the columns of ``docs``.
    """
    keep = keep or {}
    fields = [F.col(c) for c in FIELDS]
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("grp"), leaf(*fields).alias("digest"), *[c.cast("string").alias(f"k_{x}") for x, c in keep.items()])
    names = ["doc_id", "digest", *[f"k_{x}" for x in keep]]
    nodes = ranked(cut(told, "leaves"), "grp", "doc_id", "digest")
    nodes = cut(nodes.select("grp", "pos", "n", "digest", F.to_json(F.struct(*names)).alias("tag")), "nodes")

    def sources(roots: DataFrame) -> DataFrame:
        one = ranked(roots.withColumnRenamed("grp", "own").withColumn("grp", F.lit("")), "grp", "own")
        tag = F.to_json(F.struct("own", "digest"))
        key = F.from_json("tag", "own string, digest string")
        top = lambda r: r.select("grp", F.lit(None).cast(_PATH).alias("path"), F.lit(None).cast("string").alias("sub"), F.col("digest").alias("root"))
        return authenticate(one.select("grp", "pos", "n", "digest", tag.alias("tag")), top).select(key["own"].alias("grp"), "path", key["digest"].alias("sub"), "root")

    key = F.from_json("tag", "doc_id long, digest string" + "".join(f", k_{x} string" for x in keep))
    out = authenticate(nodes, sources).select(key.alias("k"), "sub", "root", "path")
    return out.select("k.doc_id", F.col("k.digest").alias("leaf"), F.col("sub").alias("subroot"), "root", F.col("path").alias("proof"), *[F.col(f"k.k_{x}").alias(x) for x in keep])


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def tampered(docs: DataFrame) -> Column:
    """The leaf of a document after some change: the text's A-Z lower-cased where ``TAMPER_EVERY`` divides the id's crc32."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % TAMPER_EVERY == 0, F.lit(False))
    return leaf(*[F.col(c) for c in FIELDS[:-1]], F.when(hit, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text")))


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    out = manifest(docs, {"now": tampered(docs)})
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    told = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.col("now"), F.col("proof")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
