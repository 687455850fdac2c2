"""Quality rules: base counts of a text, and a calibrated logistic regression over hashed n-grams.

``base_counts`` counts words, symbols, repeated lines and repeated eight-word windows of whole texts.
``fit`` trains a logistic regression on labelled rows: hashed word unigrams and bigrams and hashed character
n-grams (3 and 4 code points), each family as relative frequencies, so that a text's length plays no part.  It is then
calibrated (Platt scaling on a held-out fold, weighted back to the labels' class shares).  ``score`` runs
both in Arrow batches and decides by a fixed threshold.

Cost and scale: one scan of the documents, no shuffle, memory bounded by ``SLICE_BYTES``.  Fitting reads a
bounded sample: of each class at most ``fit_rows`` labelled doc_ids, by a hash; of these the texts of at most
``FIT_CHARS`` code points, one for each doc_id, up to ``FIT_TOTAL`` code points in sum.  The sample's ids are the
only broadcast, and the model's two tables (0.5 MB) travel with the tasks.

Defined cases: a null text counts as empty; an empty or blank text has no words and fails the base rule
(``n_words < 20``); a document whose doc_id is null is scored as any other; repeated rows are scored each;
an empty table gives no rows; with no usable labels (none, or one class only) the model's verdict is "keep"
for every text that passes the base rule, with probability null.  Labels with a null quality or doc_id, or
a quality other than 0 and 1, are not used; a doc_id with several labels counts once, by the smallest, and one
with several texts by the smallest of them.  Extra columns are kept, but for those named as the operator's own
(``_OUT``), which ``score`` replaces and ``apply`` leaves as they were.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, cut, hash_fraction, mix, prefix_hash, shielded, span_hash, spread, table, text_slices, without, words

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_SHARE = 30
KEEP_AT = 0.5
BITS = 15
FIT_ROWS = 1000
FIT_CHARS = 20_000
FIT_TOTAL = 8_000_000

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_HEAD = (np.arange(256) & 0xC0) != 0x80  # the first byte of a code point


def _row_sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[offs[1:]] - run[offs[:-1]]


def _repeated_windows(hashes: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Words of each row that lie in an eight-word window occurring twice or more in that row."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(n_rows, np.int64)
    acc = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        acc = acc * np.uint64(0x100000001B3) + hashes[k : k + n]
    whole = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    key = mix(acc[whole] ^ (row[whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.zeros(len(ranked) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    twice = whole[order[same[1:] | same[:-1]]]
    step = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + WINDOW, -1)
    covered = np.cumsum(step[:-1]) > 0
    return np.bincount(row[covered], minlength=n_rows)


def _repeated_lines(data: np.ndarray, offs: np.ndarray, prefix: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    n_rows = len(offs) - 1
    breaks = np.flatnonzero(data == 10)
    ends = np.sort(np.concatenate((breaks, offs[1:])), kind="stable")  # a text's end closes its last line
    at_break = np.zeros(len(data) + 1, bool)
    at_break[breaks] = True
    starts = np.zeros_like(ends)
    starts[1:] = ends[:-1] + at_break[ends[:-1]]
    has_word = np.searchsorted(word_starts, ends, "left") > np.searchsorted(word_starts, starts, "left")
    starts, ends = starts[has_word & (starts < ends)], ends[has_word & (starts < ends)]
    row = np.searchsorted(offs, starts, "right") - 1
    lines = mix(span_hash(prefix, starts, ends) ^ (row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    order = np.argsort(lines, kind="stable")
    again = np.zeros(len(lines), bool)
    again[1:] = lines[order][1:] == lines[order][:-1]
    return np.bincount(row[order[again]], minlength=n_rows)


@dataclass
class Slice:
    """Counts of a slice's rows, and what the model needs of them."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    hashes: np.ndarray
    row: np.ndarray

    @property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT_SHARE * self.n_words)


def read_slice(data: np.ndarray, offs: np.ndarray) -> Slice:
    starts, ends, row = words(data, offs)
    n_rows = len(offs) - 1
    prefix = prefix_hash(data)
    hashes = span_hash(prefix, starts, ends)
    return Slice(
        np.bincount(row, minlength=n_rows),
        _row_sums(_IS_HEAD[data] & ~IS_SPACE[data], offs),
        _row_sums(_IS_SYMBOL[data], offs),
        _repeated_lines(data, offs, prefix, starts),
        _repeated_windows(hashes, row, n_rows),
        hashes,
        row,
    )


def _word_features(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of word unigrams and bigrams, and their rows."""
    top = np.uint64(64 - BITS)
    pair = np.flatnonzero(s.row[1:] == s.row[:-1]) if len(s.row) else np.zeros(0, np.int64)
    two = mix(s.hashes[pair] * np.uint64(3) + s.hashes[pair + 1]) >> top
    return np.concatenate((s.hashes >> top, two)).astype(np.int32), np.concatenate((s.row, s.row[pair]))


def _code_points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each code point of a slice (its bytes), and the rows' offsets in them."""
    heads = np.flatnonzero(_IS_HEAD[data])
    value = data[heads].astype(np.uint32)
    if len(heads) < len(data):
        length = np.diff(np.r_[heads, len(data)])
        for k in (1, 2, 3):
            more = np.flatnonzero(length > k)
            value[more] |= data[heads[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return value, np.searchsorted(heads, offs)


def _char_features(chars: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For n = 3 and 4: n and the buckets of the n-grams of code points, one for each place."""
    if len(chars) < 4:
        return
    h = chars * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    three = (h[:-2] * np.uint32(31) + h[1:-1]) * np.uint32(31) + h[2:]
    four = three[:-1] * np.uint32(31) + h[3:]
    for n, gram in ((3, three), (4, four)):
        yield n, ((gram * np.uint32(0x9E3779B1)) ^ ((gram * np.uint32(0x85EBCA6B)) >> np.uint32(15))) >> np.uint32(32 - BITS)


def _sums(values: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    run = np.zeros(len(values) + 1)
    np.cumsum(values, out=run[1:])
    return run[highs] - run[lows]


@dataclass
class Model:
    """Weights by bucket (two families), and the calibration p = sigmoid(a * z + b)."""

    word_w: np.ndarray
    char_w: np.ndarray
    bias: float
    a: float
    b: float

    def probability(self, s: Slice, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n_rows = len(offs) - 1
        bucket, row = _word_features(s)
        n = np.maximum(1, np.bincount(row, minlength=n_rows))
        z = np.bincount(row, self.word_w[bucket], minlength=n_rows) / n + self.bias
        total, count = np.zeros(n_rows), np.zeros(n_rows)
        chars, at = _code_points(data, offs)
        for n_gram, bucket in _char_features(chars):
            lows = np.minimum(at[:-1], len(bucket))
            highs = np.maximum(np.minimum(at[1:] - n_gram + 1, len(bucket)), lows)
            total += _sums(self.char_w[bucket], lows, highs)
            count += highs - lows
        z = z + total / np.maximum(1, count)
        return 1 / (1 + np.exp(-np.clip(self.a * z + self.b, -40, 40)))


_FEATURES = "doc_id long, quality int, buckets binary, counts binary"


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each labelled text as distinct buckets with relative frequencies (words first, then characters)."""
    for batch in batches:
        ids, quality = batch.column("doc_id").to_pylist(), batch.column("quality").to_pylist()
        out: list[tuple] = []
        for i, j, data, offs in text_slices(batch):
            for r in range(i, j):
                d = data[offs[r - i] : offs[r - i + 1]]
                o = np.array([0, len(d)])
                s = read_slice(d, o)
                word, _ = _word_features(s)
                parts = [b.astype(np.int64) for _, b in _char_features(_code_points(d, o)[0])]
                char = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                ub, cb = np.unique(word, return_counts=True)
                uc, cc = np.unique(char, return_counts=True)
                bucket = np.concatenate((ub, uc + (1 << BITS))).astype("<u4")
                value = np.concatenate((cb / max(1, len(word)), cc / max(1, len(char)))).astype("<f4")
                out.append((ids[r], quality[r], bucket.tobytes(), value.tobytes()))
        names = ("doc_id", "quality", "buckets", "counts")
        types = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=list(names))


def labelled_sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, total: int = FIT_TOTAL) -> DataFrame:
    """(doc_id, quality, text): at most ``fit_rows`` labelled documents of each class, and ``total`` code points."""
    good = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    order = hash_fraction(F.col("doc_id"), 3)
    ids = [good.where(F.col("quality") == k).orderBy(order, "doc_id").limit(fit_rows) for k in (0, 1)]
    # At most 2 * fit_rows rows of 12 bytes.
    found = docs.select("doc_id", "text").where(F.length("text") <= FIT_CHARS).join(F.broadcast(ids[0].union(ids[1])), "doc_id")
    found = cut(found.groupBy("doc_id", "quality").agg(F.min("text").alias("text")), "sample")
    left, some = {0: total // 2, 1: total // 2}, []
    for r in found.select("doc_id", "quality", F.length("text").alias("n")).orderBy(order, "doc_id").collect():
        if r["n"] <= left[r["quality"]]:
            left[r["quality"]] -= r["n"]
            some.append((r["doc_id"],))
    return found.join(F.broadcast(docs.sparkSession.createDataFrame(some, "doc_id long")), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, epochs: int = 120, rate: float = 0.5) -> Model | None:
    """Trains on the driver; None when the labels don't hold two classes."""
    sample = labelled_sample(docs, labels, fit_rows).mapInArrow(_featurise, _FEATURES)
    rows = sorted(sample.collect(), key=lambda r: (r["doc_id"], r["quality"], bytes(r["buckets"])))
    if len({r["quality"] for r in rows}) < 2:
        return None
    totals = {r["quality"]: r["n"] for r in labels.where("quality in (0, 1)").groupBy("quality").agg(F.count("*").alias("n")).collect()}
    return fit_rows_to_model(rows, totals, epochs, rate)


def fit_rows_to_model(rows: list, totals: dict[int, int], epochs: int, rate: float) -> Model:
    """Full-batch AdaGrad (the result depends on no order), then Platt scaling by damped Newton steps."""
    y = np.array([r["quality"] for r in rows], np.float32)
    lens = np.array([len(r["buckets"]) // 4 for r in rows])
    b = np.frombuffer(b"".join(r["buckets"] for r in rows), "<u4")
    v = np.frombuffer(b"".join(r["counts"] for r in rows), "<f4")
    rows.clear()
    upto = np.concatenate(([0], np.cumsum(lens)))
    size = 2 << BITS
    # Runs of rows with about a million entries: temporaries stay small whatever the sample holds.
    cuts = np.unique(np.searchsorted(upto, np.arange(0, upto[-1] + 1, 1 << 20))).tolist()
    parts = [(lo, hi, slice(int(upto[lo]), int(upto[hi]))) for lo, hi in zip(cuts, [*cuts[1:], len(lens)], strict=True)]
    held = np.arange(len(y)) % 5 == 0
    for k in (0, 1):
        if not ((y == k) & ~held).any() or not ((y == k) & held).any():
            held[:] = False

    def balanced(of: np.ndarray, share: dict[int, float]) -> np.ndarray:
        """Weights of the rows ``of``: each class has its share of 1."""
        n = {k: max(1, int((of & (y == k)).sum())) for k in (0, 1)}
        return np.where(of, np.where(y == 1, share[1] / n[1], share[0] / n[0]), 0.0)

    def scores(w: np.ndarray, bias: float) -> np.ndarray:
        w, out = w.astype(np.float32), []
        for lo, hi, part in parts:
            run = np.concatenate(([0.0], np.cumsum(v[part] * w[b[part]], dtype=np.float64)))
            at = upto[lo : hi + 1] - upto[lo]
            out.append(run[at[1:]] - run[at[:-1]])
        return np.concatenate(out) + bias

    weight = balanced(~held, {0: 0.5, 1: 0.5})
    w, bias, grad2, bias2 = np.zeros(size), 0.0, np.full(size, 1e-12), 1e-8
    for _ in range(epochs):
        g = (1 / (1 + np.exp(-np.clip(scores(w, bias), -40, 40))) - y) * weight
        gw = 1e-7 * w
        for lo, hi, part in parts:
            gw += np.bincount(b[part], v[part] * np.repeat(g[lo:hi].astype(np.float32), lens[lo:hi]), minlength=size)
        grad2 += gw * gw
        w -= rate * gw / np.sqrt(grad2)
        bias2 += g.sum() ** 2
        bias -= rate * 0.1 * g.sum() / np.sqrt(bias2)
    use = held if held.any() else ~held
    z = scores(w, bias)
    share = {k: totals.get(k, 1) / max(1, sum(totals.values())) for k in (0, 1)}
    weight = balanced(use, share)
    n1, n0 = int((use & (y == 1)).sum()), int((use & (y == 0)).sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    pa_, pb_ = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(pa_ * z + pb_, -40, 40)))
        d = (p - target) * weight
        h = np.maximum(p * (1 - p), 1e-9) * weight
        grad = np.array([(d * z).sum() + 1e-6 * (pa_ - 1), d.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-6, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess + 1e-9 * np.eye(2), grad)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        pa_, pb_ = pa_ - step[0], pb_ - step[1]
    half = 1 << BITS
    return Model(w[:half].astype(np.float32), w[half:].astype(np.float32), float(bias), float(pa_), float(pb_))


_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, prob double, kept boolean"


def score(docs: DataFrame, model: Model | None, keep_at: float = KEEP_AT) -> DataFrame:
    """``docs`` with the counts, the calibrated probability of good quality and the verdict ``kept``."""
    added = [x.split()[0] for x in _OUT.split(", ")]
    docs = without(docs, *added)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 0.3 MB, fixed by BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i, j, data, offs in text_slices(batch):
                s = read_slice(data, offs)
                prob = m.probability(s, data, offs) if m is not None else None
                failed = s.base_failed
                kept = ~failed & (prob >= keep_at if prob is not None else True)
                new = [pa.array(x, pa.int64()) for x in (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words)]
                new += [pa.array(failed), pa.array(prob, pa.float64()) if prob is not None else pa.nulls(j - i, pa.float64()), pa.array(kept)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *new], names=[*batch.schema.names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, {_OUT}")


def apply(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    return shielded(docs, ("doc_id", "text"), lambda d: score(d, model).where("kept"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).drop("text")
