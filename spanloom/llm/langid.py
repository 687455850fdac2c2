"""Language identification by hyperdimensional profiles.

Every letter has a random vector of ``DIM`` signs, drawn from a generator seeded by its code point, so any
script is covered and every process draws alike.  A trigram binds its letters, each permuted by its place
(rolled by two, one and no positions), by multiplying them; a text bundles (sums) the vectors of its
trigrams, runs of non-letters counting as one gap.  A language's prototype bundles its training texts, each
scaled to unit length; what all languages share (the prototypes' mean) is taken off both sides before texts
and prototypes are compared by cosine.

Cost and scale: one scan, no shuffle of documents.  Training reads a bounded sample, about ``FIT_ROWS``
documents of each language chosen by a hash of doc_id, and shuffles one vector per task and language.  The
prototypes (languages times 4 KB; at most ``MAX_LANGS`` languages are allowed) travel with the tasks.  A
worker keeps the vectors of ``CACHE`` trigrams; others are made anew when met.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so is everything if nothing
could be learned; rows with null doc_id are predicted, with ``held_out`` false, and never learned from;
repeated rows count each; ties go to the first language by code point; a very long text is read whole, as a
slice of its own; an empty table gives no rows; extra columns are kept, but for those named ``lang_pred`` or
``score`` in any letter case, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_fraction, spread, table, text_slices, without

DIM = 512
FIT_ROWS = 1500
MAX_LANGS = 1000
CACHE = 1 << 14
LETTERS = 1 << 14
SEED = 7
GAP = 0

_LETTER: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)
    return _LETTER


def letter_vector(code: int) -> np.ndarray:
    """The signs of a letter (or of the gap)."""
    return np.random.default_rng([SEED, code]).integers(0, 2, DIM).astype(np.int8) * np.int8(2) - np.int8(1)


class Trigrams:
    """Vectors of trigrams by code, kept for the first ``CACHE`` met."""

    def __init__(self) -> None:
        self.letters = np.zeros(0, np.uint64)
        self.rolled = np.zeros((3, 0, DIM), np.int8)  # each letter's signs, rolled by 0, 1 and 2
        self.codes = np.zeros(0, np.uint64)
        self.vectors = np.zeros((0, DIM), np.float32)

    def _places(self, letters: np.ndarray) -> np.ndarray:
        """Where the letters' vectors are; those not met before are drawn."""
        new = np.setdiff1d(letters, self.letters)
        if len(new):
            if len(self.letters) > LETTERS:
                self.letters, self.rolled = np.zeros(0, np.uint64), np.zeros((3, 0, DIM), np.int8)
                new = np.unique(letters)
            drawn = np.stack([letter_vector(int(c)) for c in new])
            both = np.concatenate((self.letters, new))
            order = np.argsort(both)
            self.letters = both[order]
            self.rolled = np.concatenate((self.rolled, np.stack([np.roll(drawn, k, axis=1) for k in range(3)])), axis=1)[:, order]
        return np.searchsorted(self.letters, letters)

    def make(self, codes: np.ndarray) -> np.ndarray:
        low = np.uint64(0x1FFFFF)
        at = self._places(np.concatenate((codes >> np.uint64(42), (codes >> np.uint64(21)) & low, codes & low)))
        n = len(codes)
        return (self.rolled[2, at[:n]] * self.rolled[1, at[n : 2 * n]] * self.rolled[0, at[2 * n :]]).astype(np.float32)

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the trigrams' vectors."""
        at = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        known = self.codes[at] == codes if len(self.codes) else np.zeros(len(codes), bool)
        total = counts[known].astype(np.float32) @ self.vectors[at[known]]
        if not known.all():
            new = codes[~known]
            for k in range(0, len(new), 4096):
                made = self.make(new[k : k + 4096])
                total = total + counts[~known][k : k + 4096].astype(np.float32) @ made
                room = CACHE - len(self.codes)
                if room > 0:
                    all_codes = np.concatenate((self.codes, new[k : k + 4096][:room]))
                    order = np.argsort(all_codes)
                    self.codes, self.vectors = all_codes[order], np.concatenate((self.vectors, made[:room]))[order]
        return total


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Codes and counts of a text's trigrams, or None if it has no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[code]
    if not letter.any():
        return None
    # One gap for each run of other characters, and one at either end.
    code = np.where(letter, code, GAP)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code = np.concatenate(([GAP], code[keep], [GAP])).astype(np.uint64)
    if code[1] == GAP:
        code = code[1:]
    if code[-2] == GAP:
        code = code[:-1]
    gram = (code[:-2] << np.uint64(42)) | (code[1:-1] << np.uint64(21)) | code[2:]
    return np.unique(gram, return_counts=True)


_TRIGRAMS: list[Trigrams] = []


def _trigrams() -> Trigrams:
    if not _TRIGRAMS:
        _TRIGRAMS.append(Trigrams())
    return _TRIGRAMS[0]


def profile(text: str, grams: Trigrams) -> np.ndarray | None:
    """A text's bundled vector at unit length; None if it has no letter."""
    found = trigram_counts(text)
    if found is None:
        return None
    v = grams.bundle(*found)
    return v / max(1e-12, float(np.linalg.norm(v)))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    for i, j, data, offs in text_slices(batch):
        raw = data.tobytes()
        for r in range(i, j):
            yield r, raw[offs[r - i] : offs[r - i + 1]].decode()


def is_held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(text, lang) of about ``fit_rows`` documents of each language; none of those held out."""
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    counts = own.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return own.select("text", "lang")
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, fit_rows / r["n"])))])
    return own.where(hash_fraction(F.col("doc_id"), 5) < F.element_at(share, F.col("lang"))).select("text", "lang")


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> dict[str, np.ndarray]:
    """The prototypes: for every language the mean of its texts' unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for r, text in _texts(batch):
                v = profile(text, _trigrams())
                if v is not None:
                    t = total.setdefault(langs[r], [np.zeros(DIM), 0])
                    # Rounded to 2**-30 so that sums don't depend on the order of rows.
                    t[0] += np.round(v.astype(float) * 2**30)
                    t[1] += 1
        names = sorted(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([total[k][1] for k in names], pa.int64()), pa.array([total[k][0].astype(np.int64).tolist() for k in names], pa.list_(pa.int64()))],
            names=["lang", "n", "v"],
        )

    parts = training_sample(docs, fit_rows).mapInArrow(run, "lang string, n long, v array<long>")
    out: dict[str, list] = {}
    for r in parts.collect():  # one row for each task and language of a bounded sample
        t = out.setdefault(r["lang"], [np.zeros(DIM, np.int64), 0])
        t[0] += np.array(r["v"], np.int64)
        t[1] += r["n"]
    return {k: out[k][0] / 2**30 / max(1, out[k][1]) for k in sorted(out)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` with lang_pred and score (the cosine, 0 if negative)."""
    docs = without(docs, "lang_pred", "score")
    names = sorted(prototypes)
    mean = np.mean([prototypes[k] for k in names], axis=0) if len(names) > 1 else np.zeros(DIM)
    rows = np.array([prototypes[k] - mean for k in names]).reshape(len(names), DIM)
    rows = rows / np.maximum(1e-12, np.linalg.norm(rows, axis=1, keepdims=True))
    shared = docs.sparkSession.sparkContext.broadcast((names, mean, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, centre, table_ = shared.value
        for batch in batches:
            langs, scores = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            for r, text in _texts(batch) if own else ():
                v = profile(text, _trigrams())
                if v is not None:
                    v = v - centre
                    cos = table_ @ v / max(1e-12, float(np.linalg.norm(v)))
                    best = int(np.argmax(cos))
                    langs[r], scores[r] = own[best], float(min(1.0, max(0.0, cos[best])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs), pa.array(scores)], names=[*batch.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
