"""Line dedup that can be undone: exact reference tables of line keys, fronted by sharded cuckoo filters.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; keys of at least
``MIN_CHARS`` code points count.  The state of a corpus is

* ``refs(hi, lo, first_doc, n_docs)``: for every key (its 128-bit XXH3) the exact number of documents holding
  it and the smallest of them, counted from the postings, and
* ``filters(shard, filter)``: for every shard of keys a cuckoo filter of the keys that two or more
  documents hold.

``LineStore`` keeps that state under a path: postings (which document holds which key) and taken-out documents
are deltas, written once and merged now and then; a log names the deltas of each version.  A change writes its
deltas under fresh names and then adds its version to the log, so a failed change leaves the old version whole,
can be tried again, and a store can be opened again by its path.  A change reads the postings and keeps those of
the keys it touches, and patches only the filters of shards whose keys crossed the bar of two documents; a deletion restores a key's
next smallest holder.  The number of shards grows with the keys held.

``dedup`` takes a table into a new store and probes the filters with each document's keys: the keys are dealt to
where their shard's filter is, and only those that it may hold go on to the exact table, which decides.  A
filter has no false negatives and its false positives fall to the exact join, so results don't depend on it.

Scale: documents are scanned twice and shuffled once, by doc_id, to meet their dropped keys.  Keys are distinct
per document before they are shuffled.  No filter is broadcast or held by the driver: a shard has about
``SHARD_KEYS`` keys, and a shard with more than ``PROBE_ROWS`` rows (of a key that a third of all documents
hold, say) is probed in that many parts, each with its copy of the filter.  The joins to the exact table and
back to the documents are sort-merge joins whose hot partitions Spark splits.

Defined cases: null or empty text is one empty line; texts may be of any length; a doc_id repeated in the
table counts as one document and each of its rows is cut alike; rows with a null doc_id keep all their
lines and hold no keys; an empty table gives no rows; extra columns are kept by ``apply``, and by ``dedup`` but
for those named as its own (n_lines, n_dropped, kept_text), which it replaces.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, cut, mix, shielded, table, text_slices, without, work_dir

MIN_CHARS = 10
SHARD_KEYS = 1 << 16
PROBE_ROWS = 1 << 17
DELTAS = 8  # a store with more is merged
SLOTS = 4


def line_key(line: bytes) -> bytes | None:
    """The key of a line, or None if it is too short to count."""
    key = line.strip(SPACES).lower()
    if len(key) < MIN_CHARS:
        return None
    if not key.isascii() and len(key.decode()) < MIN_CHARS:
        return None
    return key


class CuckooFilter:
    """16-bit fingerprints, four to a bucket, in numpy; takes insertions and deletions of 64-bit hashes."""

    def __init__(self, capacity: int) -> None:
        self.n_buckets = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / SLOTS / 0.8 + 1))))
        self.slots = np.zeros((self.n_buckets, SLOTS), np.uint16)

    def _place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(np.asarray(h, np.uint64))
        print_ = (h >> np.uint64(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        return print_, (h & np.uint64(self.n_buckets - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(print_.astype(np.uint64)) & np.uint64(self.n_buckets - 1)).astype(np.int64)

    def insert(self, h: np.ndarray) -> None:
        """Adds hashes in rounds: each places what finds a free slot and moves one resident per full bucket."""
        print_, bucket = self._place(h)
        turn = np.zeros(len(print_), bool)
        for round_ in range(500):
            if not len(print_):
                return
            order = np.argsort(bucket, kind="stable")
            print_, bucket, turn = print_[order], bucket[order], turn[order]
            first = np.r_[True, bucket[1:] != bucket[:-1]]
            rank = np.arange(len(bucket)) - np.maximum.accumulate(np.where(first, np.arange(len(bucket)), 0))
            free = self.slots[bucket] == 0
            fits = rank < free.sum(1)
            at = np.argsort(~free[fits], axis=1, kind="stable")[np.arange(int(fits.sum())), rank[fits]]
            self.slots[bucket[fits], at] = print_[fits]
            rest_p, rest_b, rest_t = print_[~fits], bucket[~fits], turn[~fits]
            if not len(rest_p):
                return
            # Of those that have tried both buckets one per bucket evicts a resident; all others try their other bucket.
            rest_first = np.r_[True, rest_b[1:] != rest_b[:-1]]
            evict = rest_t & rest_first
            where = (rest_p[evict].astype(np.int64) + round_) % SLOTS
            out = self.slots[rest_b[evict], where].copy()
            self.slots[rest_b[evict], where] = rest_p[evict]
            print_ = np.concatenate((rest_p[~evict], out))
            bucket = np.concatenate((self._other(rest_b[~evict], rest_p[~evict]), self._other(rest_b[evict], out)))
            turn = np.ones(len(print_), bool)
        raise OverflowError("the cuckoo filter is full")

    def contains(self, h: np.ndarray) -> np.ndarray:
        print_, bucket = self._place(h)
        hit = (self.slots[bucket] == print_[:, None]).any(1)
        return hit | (self.slots[self._other(bucket, print_)] == print_[:, None]).any(1)

    def delete(self, h: np.ndarray) -> None:
        """Takes out one fingerprint for each hash; only hashes that were inserted may be given."""
        print_, bucket = self._place(h)
        for p, b, o in zip(print_.tolist(), bucket.tolist(), self._other(bucket, print_).tolist(), strict=True):
            for k in (b, o):
                at = np.flatnonzero(self.slots[k] == p)
                if len(at):
                    self.slots[k, at[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        self = cls.__new__(cls)
        self.slots = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy()
        self.n_buckets = len(self.slots)
        return self

    @classmethod
    def of(cls, h: np.ndarray) -> CuckooFilter:
        """A filter of all of ``h``, doubled until they fit."""
        room = len(h)
        while True:
            self = cls(room)
            try:
                self.insert(h)
                return self
            except OverflowError:
                room = max(64, 2 * room)


def _emit(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = np.array(rows, np.uint64).reshape(-1, 3).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(cols[:, k])) for k in range(3)], names=["hi", "lo", "doc_id"])


_MASK = (1 << 64) - 1


def line_keys(docs: DataFrame) -> DataFrame:
    """(hi, lo, doc_id): the keys of every document, distinct per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, j, data, offs in text_slices(batch):
                raw = data.tobytes()
                rows: list[tuple[int, int, int]] = []
                for r in range(i, j):
                    if ids[r] is None:
                        continue
                    keys = {k for line in set(raw[offs[r - i] : offs[r - i + 1]].split(b"\n")) if (k := line_key(line)) is not None}
                    doc = ids[r] & _MASK
                    for k in keys:
                        d = xxhash.xxh3_128_intdigest(k)
                        rows.append((d >> 64, d & _MASK, doc))
                yield _emit(rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "hi long, lo long, doc_id long")


def reference_counts(postings: DataFrame) -> DataFrame:
    """(hi, lo, first_doc, n_docs): of every key of distinct ``postings(hi, lo, doc_id)`` its smallest holder and their number."""
    return postings.groupBy("hi", "lo").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs"))


def _shard(n: int):
    # Unsigned modulo of the signed column; n is a power of two.
    return F.col("hi").bitwiseAND(F.lit(n - 1).cast("long")).cast("int").alias("shard")


def _shards_for(n_keys: int) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1, n_keys) / SHARD_KEYS))))


def _runs(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal columns."""
    cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
    bounds = [0, *cuts.tolist(), key.shape[1]]
    return zip(bounds, bounds[1:], strict=False)


_FILTERS = "shard int, filter binary"


def _filter_row(shard: int, raw: bytes | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([raw], pa.binary())], names=["shard", "filter"])


def build_filters(held: DataFrame, n_shards: int) -> DataFrame:
    """(shard, filter): the cuckoo filters of the keys ``held(hi, lo)``, one row for each shard that has keys."""
    none = F.lit(None).cast("binary").alias("filter")
    return _patched(held.select(_shard(n_shards), F.lit(2).alias("op"), "lo", none))


def _patched(rows: DataFrame) -> DataFrame:
    """(shard, filter): of ``rows(shard, op, lo, filter)`` each shard's filter (op 0, if there) less op 1 and with op 2.

    Null for a filter without room: it is to be built anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, new = None, None, []

        def done() -> Iterator[pa.RecordBatch]:
            if at is not None:
                f = CuckooFilter.of(np.concatenate(new)) if own is None else grown(own, np.concatenate(new)) if new else own
                yield _filter_row(at, None if f is None else f.to_bytes())

        for batch in batches:
            if not batch.num_rows:
                continue
            shard, op = (np.asarray(batch.column(k)).astype(np.int64) for k in (0, 1))
            lo = np.asarray(batch.column(2).fill_null(0)).astype(np.int64).view(np.uint64)
            for x, y in _runs(np.stack((shard, op))):
                if shard[x] != at:
                    yield from done()
                    at, own, new = int(shard[x]), None, []
                if op[x] == 0:
                    own = CuckooFilter.from_bytes(batch.column(3)[x].as_py())
                elif op[x] == 1:
                    own.delete(lo[x:y])
                else:
                    new.append(lo[x:y])
        yield from done()

    return rows.repartition("shard").sortWithinPartitions("shard", "op", "lo").mapInArrow(run, _FILTERS)


def probe(keys: DataFrame, filters: DataFrame, n_shards: int) -> DataFrame:
    """Those of ``keys(hi, lo, doc_id)`` that the filter of their shard may hold; keys meet filters by shard."""
    keys = keys.withColumn("shard", _shard(n_shards))
    parts = keys.groupBy("shard").agg(F.ceil(F.count("*") / PROBE_ROWS).cast("int").alias("parts"))
    parts = cut(parts, "parts")  # a few bytes for each PROBE_ROWS rows
    none = F.lit(None).cast("binary")
    dealt = keys.join(parts, "shard").select("shard", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "hi", "lo", "doc_id", none.alias("filter"))
    no = F.lit(None).cast("long")
    copies = filters.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), no.alias("hi"), no.alias("lo"), no.alias("doc_id"), "filter")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in (0, 1, 2)])
            lo = np.asarray(batch.column(4).fill_null(0)).astype(np.int64).view(np.uint64)
            may = np.zeros(batch.num_rows, bool)
            for x, y in _runs(place):
                if (int(place[0, x]), int(place[1, x])) != at:
                    at, own = (int(place[0, x]), int(place[1, x])), None
                if place[2, x] == 0:
                    own = CuckooFilter.from_bytes(batch.column(6)[x].as_py())
                elif own is not None:
                    may[x:y] = own.contains(lo[x:y])
            yield batch.select(["hi", "lo", "doc_id"]).filter(pa.array(may))

    met = dealt.unionByName(copies).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")
    return met.mapInArrow(run, "hi long, lo long, doc_id long")


def dropped_keys(may: DataFrame, held: DataFrame) -> DataFrame:
    """(doc_id, keys): for each document the keys whose lines it loses, packed as 16-byte digests."""
    lost = may.join(held.select("hi", "lo", "first_doc"), ["hi", "lo"]).where("doc_id <> first_doc")
    packed = F.unhex(F.concat(F.lpad(F.hex("hi"), 16, "0"), F.lpad(F.hex("lo"), 16, "0")))
    return lost.groupBy("doc_id").agg(F.collect_set(packed).alias("keys"))


_OUT = "n_lines long, n_dropped long, kept_text string"


def _cut_lines(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lost = batch.column(batch.schema.get_field_index("_lost_keys"))
        rest = [n for n in batch.schema.names if n != "_lost_keys"]
        for i, j, data, offs in text_slices(batch, text):
            raw = data.tobytes()
            n_lines, n_dropped, kept = [], [], []
            keys = lost.slice(i, j - i).to_pylist()
            for r in range(j - i):
                lines = raw[offs[r] : offs[r + 1]].split(b"\n")
                n_lines.append(len(lines))
                if keys[r]:
                    gone = set(keys[r])
                    lines = [x for x in lines if (k := line_key(x)) is None or xxhash.xxh3_128_digest(k) not in gone]
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append(b"\n".join(lines))
            cols = [batch.column(batch.schema.get_field_index(n)).slice(i, j - i) for n in rest]
            cols += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*rest, "n_lines", "n_dropped", "kept_text"])


def rewrite(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text, given the keys that each document loses."""
    docs = without(docs, "n_lines", "n_dropped", "kept_text", "_lost_keys", "_lost_id")
    lost = lost.select(F.col("doc_id").alias("_lost_id"), F.col("keys").alias("_lost_keys"))
    joined = docs.join(lost, docs.doc_id.cast("long") == lost._lost_id, "left").drop("_lost_id")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(lambda b: _cut_lines(b, "text"), f"{fields}, {_OUT}")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text: the whole table taken into a new store."""
    store = LineStore(docs.sparkSession)
    keys = store.insert(docs)
    return store.dedup(docs, keys)


_LOG = "version int, seq int, kind string, name string, shards int, held long, token string"


class LineStore:
    """The state of a corpus that documents are added to and deleted from, in tables under ``path``.

    Opening a path that holds a store continues it at its newest version.  One writer at a time: of two changes
    to one version, the later to be seen raises.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or work_dir(spark, "lines")
        self.version, self.shards, self.n_held, self.entries = 0, 1, 0, []
        self._held: DataFrame | None = None
        log = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        if log.getFileSystem(spark._jsc.hadoopConfiguration()).exists(log):
            rows = spark.read.schema(_LOG).parquet(f"{self.path}/log")
            newest = rows.agg(F.max("version")).first()[0] or 0
            rows = rows.where(F.col("version") == newest).orderBy("seq").collect()
            if len({r["token"] for r in rows}) > 1:
                raise RuntimeError(f"two changes made version {newest} of {self.path}")
            if rows:
                self.version, self.shards, self.n_held = newest, rows[0]["shards"], rows[0]["held"]
                self.entries = [(r["seq"], r["kind"], r["name"]) for r in rows if r["kind"] != "none"]

    def _new(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _commit(self, entries: list[tuple[int, str, str]], shards: int, n_held: int) -> None:
        token, version = uuid.uuid4().hex, self.version + 1
        rows = [(version, seq, kind, name, shards, n_held, token) for seq, kind, name in entries or [(0, "none", "")]]
        self.spark.createDataFrame(rows, _LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        self.version, self.entries, self.shards, self.n_held, self._held = version, entries, shards, n_held, None

    def _read(self, kind: str, schema: str, entries=None) -> DataFrame:
        """The rows of all deltas of a kind, each with its ``seq``."""
        out = self.spark.createDataFrame([], f"{schema}, seq int")
        for n, (seq, name) in enumerate((s, x) for s, k, x in (entries or self.entries) if k == kind):
            df = self.spark.read.schema(schema).parquet(f"{self.path}/{name}").withColumn("seq", F.lit(seq))
            out = df if n == 0 else out.unionByName(df)
        return out

    def _postings(self, entries: list | None = None) -> DataFrame:
        entries = self.entries if entries is None else entries
        rows = self._read("postings", "hi long, lo long, doc_id long", entries)
        kinds = [k for _, k, _ in entries]
        if "gone" in kinds:
            gone = self._read("gone", "doc_id long", entries).groupBy("doc_id").agg(F.max("seq").alias("gone"))
            rows = rows.join(gone, "doc_id", "left").where("gone is null or gone < seq")
        rows = rows.select("hi", "lo", "doc_id")
        return rows if kinds.count("postings") <= 1 else rows.distinct()

    @property
    def postings(self) -> DataFrame:
        return self._postings()

    @property
    def refs(self) -> DataFrame:
        return reference_counts(self.postings)

    @property
    def filters(self) -> DataFrame:
        return self._read("filters", _FILTERS).groupBy("shard").agg(F.max_by("filter", "seq").alias("filter"))

    def _held_keys(self) -> DataFrame:
        if self._held is None:
            self._held = cut(self.refs.where("n_docs >= 2"), "held")
        return self._held

    def _change(self, kind: str, name: str, touched: DataFrame) -> None:
        """Takes the written delta into the log, with the filters that follow from the keys ``touched(hi, lo)``."""
        seq = 1 + max([0, *(s for s, _, _ in self.entries)])
        entries = [*self.entries, (seq, kind, name)]
        if not self.entries:
            held = cut(reference_counts(self._postings(entries)).where("n_docs >= 2"), "held")
            n_held = held.count()
            shards = _shards_for(n_held)
            filters = self._new(build_filters(held, shards), "filters")
            self._commit([*entries, (seq, "filters", filters)], shards, n_held)
            self._held = held
            return
        touched = cut(touched.select("hi", "lo").distinct(), "touched")
        was, now = (reference_counts(self._postings(e).join(touched, ["hi", "lo"], "left_semi")).where("n_docs >= 2").select("hi", "lo") for e in (None, entries))
        was, now = cut(was, "was"), cut(now, "now")
        up, down = now.join(was, ["hi", "lo"], "left_anti"), was.join(now, ["hi", "lo"], "left_anti")
        n_held = self.n_held + up.count() - down.count()
        if len(entries) > DELTAS or _shards_for(n_held) > self.shards:
            self._merge(entries, seq)
            return
        none = F.lit(None).cast("binary").alias("filter")
        ops = up.select(_shard(self.shards), F.lit(2).alias("op"), "lo", none).union(down.select(_shard(self.shards), F.lit(1).alias("op"), "lo", none))
        old = self.filters.join(ops.select("shard").distinct(), "shard", "left_semi").select("shard", F.lit(0).alias("op"), F.lit(None).cast("long").alias("lo"), "filter")
        patched = cut(_patched(old.union(ops)), "filters")
        full = patched.where("filter is null").select("shard")
        again = reference_counts(self._postings(entries)).where("n_docs >= 2").select("hi", "lo", _shard(self.shards)).join(full, "shard", "left_semi")
        filters = patched.where("filter is not null")
        filters = self._new(filters if full.isEmpty() else filters.union(build_filters(again, self.shards)), "filters")
        self._commit([*entries, (seq, "filters", filters)], self.shards, n_held)

    def _merge(self, entries: list[tuple[int, str, str]], seq: int) -> None:
        """One delta in place of many, and all filters anew."""
        name = self._new(self._postings(entries), "postings")
        held = cut(reference_counts(self._postings([(seq, "postings", name)])).where("n_docs >= 2"), "held")
        n_held = held.count()
        shards = _shards_for(n_held)
        self._commit([(seq, "postings", name), (seq, "filters", self._new(build_filters(held, shards), "filters"))], shards, n_held)
        self._held = held

    def insert(self, docs: DataFrame) -> DataFrame:
        """Takes in documents and returns their keys; a doc_id that is there already gains the new lines' keys."""
        name = self._new(line_keys(docs).distinct(), "postings")
        keys = self.spark.read.schema("hi long, lo long, doc_id long").parquet(f"{self.path}/{name}")
        self._change("postings", name, keys)
        return keys

    def delete(self, doc_ids: DataFrame) -> None:
        """Takes out the documents of ``doc_ids(doc_id)``; keys fall back to their next smallest holder."""
        name = self._new(doc_ids.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct(), "gone")
        gone = self.spark.read.schema("doc_id long").parquet(f"{self.path}/{name}")
        self._change("gone", name, self.postings.join(gone, "doc_id", "left_semi"))

    def dedup(self, docs: DataFrame, keys: DataFrame | None = None) -> DataFrame:
        """``docs`` (taken in before) with n_lines, n_dropped and kept_text as the current version has it.

        ``keys`` are those that :meth:`insert` returned for the same documents, if they are still at hand.
        """
        if keys is None:
            keys = cut(line_keys(docs).distinct(), "keys")
        return rewrite(docs, dropped_keys(probe(keys, self.filters, self.shards), self._held_keys()))


def grown(f: CuckooFilter, add: np.ndarray) -> CuckooFilter | None:
    """``f`` with more hashes, or None if it has no room: the shard is then rebuilt from the exact table."""
    try:
        f.insert(add)
        return f
    except OverflowError:
        return None


def apply(docs: DataFrame) -> DataFrame:
    """``docs`` with each text cut to its kept lines."""
    return shielded(docs, ("doc_id", "text"), lambda d: dedup(d).withColumn("text", F.col("kept_text")))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
