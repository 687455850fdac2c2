"""Language-model scores by masked pseudo-likelihood.

A small network predicts every word of a text from the ``SIDE`` words on either side of it (never from the
word itself): position-wise embeddings, one hidden layer, and a two-step softmax (a class of slots, then the
slot within it).  A text's score is the sum of its words' conditional log-probabilities.

1. ``statistics`` counts all words and all pairs of bytes of all documents (map-side combined, one shuffle).
   The network has ``side`` x ``side`` slots, and ``side`` grows with the number of different words
   (``GROWTH`` times its fourth root).  Three quarters of the slots are the most frequent words' own; all other
   words are dealt to the rest by their hash.  So the network predicts every word in its context.  Which word of
   a shared slot it is, is told by its spelling: the corpus's byte pairs, of which a slot has an equal share.
2. ``windows`` reads all documents and keeps one word in ``MASK`` with its neighbours; ``fit`` trains in numpy: a
   start on a bounded sample of them, then one pass over all of them in shards of about ``SHARD_WINDOWS``, from
   the common start; the shards' weights are averaged, weighted by their windows, in a tree of ``FAN`` at a time.
   Shards go by a hash of the text, and a shard's windows are in order of it: the result doesn't depend on
   how the documents are partitioned.
3. ``score`` reads whole texts in Arrow batches; no shuffle.

Only the words with slots of their own, the byte pairs and the averaged model reach the driver (some megabytes
at a thousand million different words).

Defined cases: null and empty texts have no words: 0 words, log_prob 0, mean_log_prob and perplexity null; a
one-word text is predicted from padding alone; texts of any length are scored whole; repeated rows are scored
each; an empty table gives no rows; extra columns are kept by ``score``, but for those named as its own
(n_tokens, log_prob, mean_log_prob, perplexity), which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, cut, hash_fraction, mix, most_frequent, prefix_hash, span_hash, spread, table, text_slices, without, words

SIDE = 2
LEAST, GROWTH = 32, 1.25
EMBED = 16
HIDDEN = 24
MASK = 8
BATCH = 1024
SHARD_WINDOWS = 250_000
PIECE = 4096  # windows in a row at most
START_ROWS = 1500
START_EPOCHS = 4
FAN = 16
SEED = 13

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLAIN = np.where(IS_SPACE, 32, _LOWER).astype(np.int64)


def byte_pairs(data: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of a slice its pair with the byte before it (a space at a text's start), and each word's end pair."""
    plain = _PLAIN[data]
    before = np.empty_like(plain)
    before[1:] = plain[:-1]
    before[offs[:-1][offs[:-1] < len(plain)]] = 32
    return 256 * before + plain, 256 * plain[ends - 1] + 32


@dataclass
class Corpus:
    """Words with slots of their own (sorted hashes and their slots), the network's side, and byte-pair log-probabilities."""

    hashes: np.ndarray
    slots: np.ndarray
    side: int
    spell: np.ndarray

    @property
    def own(self) -> int:
        return own_slots(self.side)

    @property
    def pad(self) -> int:
        return self.side * self.side

    def read(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Slots in a row with ``SIDE`` paddings around each text; places and rows of the words; spelling costs."""
        low = _LOWER[data]
        starts, ends, row = words(low, offs)
        h = span_hash(prefix_hash(low), starts, ends)
        shared = self.pad - self.own
        ids = self.own + (mix(h ^ np.uint64(SEED)) % np.uint64(shared)).astype(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            ids = np.where(self.hashes[at] == h, self.slots[at], ids)
        run = np.zeros(len(low) + 1)
        pairs, last = byte_pairs(data, offs, starts, ends)
        np.cumsum(self.spell[pairs], out=run[1:])
        cost = np.where(ids >= self.own, np.minimum(0.0, run[ends] - run[starts] + self.spell[last] + np.log(shared)), 0.0)
        place = np.arange(len(ids)) + SIDE * (row + 1)
        seq = np.full(len(ids) + SIDE * (len(offs) + 1), self.pad, np.int64)
        seq[place] = ids
        return seq, place, row, cost


def own_slots(side: int) -> int:
    return side * (3 * side // 4)


def statistics(docs: DataFrame) -> Corpus:
    """Counts over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in text_slices(batch):
                low = _LOWER[data]
                starts, ends, _ = words(low, offs)
                h, n = np.unique(span_hash(prefix_hash(low), starts, ends), return_counts=True)
                inside, last = byte_pairs(data, offs, starts, ends)
                pairs = np.bincount(inside[~IS_SPACE[data]], minlength=1 << 16) + np.bincount(last, minlength=1 << 16)
                seen = np.flatnonzero(pairs)
                kind = np.r_[np.zeros(len(h), np.int32), np.ones(len(seen), np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.r_[h.view(np.int64), seen]), pa.array(np.r_[n, pairs[seen]].astype(np.int64))], names=["kind", "key", "n"])

    counts = docs.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = cut(counts, "words")
    different = counts.where("kind = 0").count()
    side = max(LEAST, int(np.ceil(GROWTH * different**0.25)))
    own = own_slots(side)
    top = most_frequent(counts.where("kind = 0"), "key", own).orderBy(F.desc("n"), "key").limit(own).collect()
    h = np.array([r["key"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(h)
    pairs = np.full((256, 256), 0.01)
    for r in counts.where("kind = 1").collect():
        pairs[r["key"] >> 8, r["key"] & 255] += r["n"]
    return Corpus(h[order], np.arange(len(h))[order], side, np.log(pairs / pairs.sum(1, keepdims=True)).ravel())


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


def _classes(cls: np.ndarray, side: int) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each class that has any."""
    order = np.argsort(cls, kind="stable")
    cuts = np.searchsorted(cls[order], np.arange(side + 1))
    for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        yield k, order[cuts[k] : cuts[k + 1]]


class WindowNet:
    """The network; ``p`` holds its float32 weights by name."""

    def __init__(self, side: int = LEAST, p: dict[str, np.ndarray] | None = None) -> None:
        rng = np.random.default_rng(SEED)
        self.side = side
        self.p = p or {k: (rng.normal(0, 0.1, s) if not k.endswith("_b") else np.zeros(s)).astype(np.float32) for k, s in self.shapes(side).items()}
        self.g2 = {k: np.full(v.shape, 1e-4, np.float32) for k, v in self.p.items()}

    @staticmethod
    def shapes(side: int) -> dict[str, tuple[int, ...]]:
        return {
            "embed": (side * side + 1, EMBED), "hidden": (2 * SIDE * EMBED, HIDDEN), "hidden_b": (HIDDEN,),
            "cls": (HIDDEN, side), "cls_b": (side,), "word": (side, HIDDEN, side), "word_b": (side, side),
        }

    @classmethod
    def unpack(cls, side: int, flat: np.ndarray) -> WindowNet:
        p, at = {}, 0
        for k, s in cls.shapes(side).items():
            n = int(np.prod(s))
            p[k] = flat[at : at + n].reshape(s).astype(np.float32)
            at += n
        return cls(side, p)

    def pack(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    @staticmethod
    def context(seq: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.stack([seq[place + d] for d in range(-SIDE, SIDE + 1) if d], 1)

    def log_probs(self, ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target given its context; some ten thousand at a time."""
        out = np.empty(len(target))
        # What each place adds to the hidden layer, by slot: one product for the whole vocabulary.
        parts = self.p["hidden"].reshape(2 * SIDE, EMBED, HIDDEN)
        added = [self.p["embed"] @ m for m in parts] if len(target) > 4 * len(self.p["embed"]) else None
        for s in range(0, len(target), 32768):
            c, t = ctx[s : s + 32768], target[s : s + 32768]
            inner = sum(a[c[:, k]] for k, a in enumerate(added)) if added else self.p["embed"][c].reshape(len(c), -1) @ self.p["hidden"]
            h = np.tanh(inner + self.p["hidden_b"])
            z = h @ self.p["cls"] + self.p["cls_b"]
            cls, inner = t // self.side, t % self.side
            top = z.max(1)
            lp = z[np.arange(len(t)), cls] - top - np.log(np.exp(z - top[:, None]).sum(1))
            for k, own in _classes(cls, self.side):
                w = h[own] @ self.p["word"][k] + self.p["word_b"][k]
                top = w.max(1)
                lp[own] += w[np.arange(len(own)), inner[own]] - top - np.log(np.exp(w - top[:, None]).sum(1))
            out[s : s + 32768] = lp
        return out

    def step(self, ctx: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One AdaGrad step on a batch of masked words."""
        n = len(target)
        e = self.p["embed"][ctx].reshape(n, -1)
        h = np.tanh(e @ self.p["hidden"] + self.p["hidden_b"])
        cls, inner = target // self.side, target % self.side
        dz = _softmax(h @ self.p["cls"] + self.p["cls_b"])
        dz[np.arange(n), cls] -= 1
        dz /= n
        dh = dz @ self.p["cls"].T
        g = {"word": np.zeros_like(self.p["word"]), "word_b": np.zeros_like(self.p["word_b"])}
        for k, at in _classes(cls, self.side):
            dw = _softmax(h[at] @ self.p["word"][k] + self.p["word_b"][k])
            dw[np.arange(len(at)), inner[at]] -= 1
            dw /= n
            g["word"][k] = h[at].T @ dw
            g["word_b"][k] = dw.sum(0)
            dh[at] += dw @ self.p["word"][k].T
        dh *= 1 - h * h
        g |= {"cls": h.T @ dz, "cls_b": dz.sum(0), "hidden": e.T @ dh, "hidden_b": dh.sum(0)}
        de = (dh @ self.p["hidden"].T).reshape(-1, EMBED)
        flat = ctx.ravel()
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.r_[True, flat[order][1:] != flat[order][:-1]])
        ids, de = flat[order[first]], np.add.reduceat(de[order], first, axis=0)
        self.g2["embed"][ids] += de * de
        self.p["embed"][ids] -= rate * de / np.sqrt(self.g2["embed"][ids])
        for k, v in g.items():
            self.g2[k] += v * v
            self.p[k] -= rate * v / np.sqrt(self.g2[k])

    def train(self, own: np.ndarray, rate: float, salt: int = 0) -> None:
        """Steps over windows (context and target in a row), in an order that depends on their number alone."""
        own = own[np.argsort(mix(np.arange(len(own), dtype=np.uint64) + np.uint64(salt)), kind="stable")].astype(np.int64)
        for s in range(0, len(own), BATCH):
            self.step(own[s : s + BATCH, :-1], own[s : s + BATCH, -1], rate)


def _kind(corpus: Corpus) -> str:
    return "<u2" if corpus.pad < 1 << 16 else "<u4"


def windows(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """(key, w): one word in ``MASK`` of every text, by its place, with its neighbours; at most ``PIECE`` in a row."""
    shared = docs.sparkSession.sparkContext.broadcast(corpus)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        wide = (2 * SIDE + 1) * np.dtype(_kind(own)).itemsize
        for batch in batches:
            for i, j, data, offs in text_slices(batch):
                seq, place, row, _ = own.read(data, offs)
                inside = np.arange(len(row)) - np.searchsorted(row, row)
                pick = np.flatnonzero(mix(inside.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(MASK) == 0)
                w = np.concatenate((WindowNet.context(seq, place[pick]), seq[place[pick]][:, None]), 1).astype(_kind(own))
                n = np.bincount(row[pick], minlength=j - i)
                pieces = -(-n // PIECE)
                of = np.repeat(np.arange(j - i), pieces)
                number = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                starts = (np.cumsum(n) - n)[of] + PIECE * number
                text = span_hash(prefix_hash(data), offs[:-1], offs[1:])[of]
                key = mix(text + number.astype(np.uint64)).view(np.int64)
                bounds = pa.py_buffer((np.r_[starts, len(w)] * wide).astype(np.int32))
                rows = pa.Array.from_buffers(pa.binary(), len(of), [None, bounds, pa.py_buffer(np.ascontiguousarray(w))])
                yield pa.RecordBatch.from_arrays([pa.array(key), rows], names=["key", "w"])

    return docs.select("text").mapInArrow(run, "key long, w binary")


def _average(models: DataFrame) -> tuple[np.ndarray, int] | None:
    """The mean of ``models(k, n, flat)`` weighted by n, in a tree of ``FAN`` at a time."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, total = None, 0, 0.0

        def pack() -> pa.RecordBatch:
            flat = (total / n).astype("<f4").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([n], pa.int64()), pa.array([flat], pa.binary())], names=["k", "n", "flat"])

        for batch in batches:
            for to, _, own, flat in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if to != at and at is not None:
                    yield pack()
                if to != at:
                    at, n, total = to, 0, 0.0
                n, total = n + own, total + own * np.frombuffer(flat, "<f4").astype(np.float64)
        if at is not None:
            yield pack()

    models = models.where("n > 0")
    most = models.agg(F.max("k")).first()[0]
    if most is None:
        return None
    while most > 0:
        to = F.floor(F.col("k") / FAN).cast("long").alias("to")
        models = cut(models.select(to, "k", "n", "flat").repartition("to").sortWithinPartitions("to", "k").mapInArrow(merge, "k long, n long, flat binary"), "models")
        most //= FAN
    r = models.first()
    return np.frombuffer(r["flat"], "<f4"), r["n"]


def _rows(raw: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(-1, 2 * SIDE + 1)


def fit(docs: DataFrame, corpus: Corpus, start_rows: int = START_ROWS, shard_windows: int = SHARD_WINDOWS) -> WindowNet:
    """A start on about ``start_rows`` rows of windows, then one pass over all windows in shards, averaged."""
    kind, side = _kind(corpus), corpus.side
    found = cut(windows(docs, corpus), "windows")
    net = WindowNet(side)
    size = found.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("w")), F.lit(0)).alias("bytes")).first()
    # At most 40 KB a row, whatever the texts' lengths; about twice start_rows rows come from all tasks together.
    some = found.where(hash_fraction(F.col("key"), SEED) < min(1.0, 2 * start_rows / max(1, size["rows"])))
    start = [bytes(r["w"]) for r in some.orderBy(F.xxhash64("key"), "w").limit(start_rows).collect()]
    if start:
        for epoch in range(START_EPOCHS):
            net.train(_rows(start, kind), 0.1 / (1 + epoch), salt=epoch)
    total = size["bytes"] // ((2 * SIDE + 1) * np.dtype(kind).itemsize)
    shards = max(1, -(-total // shard_windows))
    shared = docs.sparkSession.sparkContext.broadcast(net.pack())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, seen, held, n = None, None, 0, [], 0

        def descend() -> None:
            nonlocal seen, n
            if held:
                w = _rows(held, kind)
                own.train(w, 0.03, salt=99)
                seen += len(w)
            held.clear()
            n = 0

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([seen], pa.int64()), pa.array([own.pack().tobytes()], pa.binary())], names=["k", "n", "flat"])

        for batch in batches:
            for shard, w in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if shard != at:
                    if at is not None:
                        descend()
                        yield pack()
                    at, own, seen = shard, WindowNet.unpack(side, shared.value), 0
                held.append(w)
                n += len(w)
                if n >= 1 << 20:
                    descend()
        if at is not None:
            descend()
            yield pack()

    dealt = found.select(F.pmod("key", F.lit(shards)).cast("long").alias("shard"), "key", "w")
    dealt = dealt.repartitionByRange(min(shards, 10_000), "shard").sortWithinPartitions("shard", "key", "w")
    averaged = _average(cut(dealt.mapInArrow(run, "k long, n long, flat binary"), "models"))
    return net if averaged is None else WindowNet.unpack(side, averaged[0])


def score(docs: DataFrame, corpus: Corpus, net: WindowNet) -> DataFrame:
    """``docs`` with n_tokens, log_prob (the sum), mean_log_prob and perplexity."""
    names = ["n_tokens", "log_prob", "mean_log_prob", "perplexity"]
    docs = without(docs, *names)
    shared = docs.sparkSession.sparkContext.broadcast((corpus, net.pack()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_corpus, flat = shared.value
        own = WindowNet.unpack(own_corpus.side, flat)
        for batch in batches:
            for i, j, data, offs in text_slices(batch):
                seq, place, row, cost = own_corpus.read(data, offs)
                lp = own.log_probs(WindowNet.context(seq, place), seq[place]) + cost
                n = np.bincount(row, minlength=j - i)
                total = np.bincount(row, lp, minlength=j - i)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(n, pa.int64()), pa.array(total)], names=[*batch.schema.names, *names[:2]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs.mapInArrow(run, f"{fields}, n_tokens long, log_prob double")
    # Single precision inside: what the last digits are depends on how rows are batched.
    mean = F.when(F.col("n_tokens") > 0, F.round(F.col("log_prob") / F.col("n_tokens"), 3))
    return out.withColumns({"mean_log_prob": mean, "log_prob": F.round("log_prob", 1)}).withColumn("perplexity", F.exp(-F.col("mean_log_prob")))


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    corpus = statistics(docs)
    return score(docs, corpus, fit(docs, corpus)).drop("text")
