"""Dictionary sweep: every whole-word hit of a vocabulary table in whole texts, longest first, off occupied places.

Hits are found by Aho-Corasick automata, one pass over the texts for each shard of the vocabulary.  A shard is
dealt by hash and bounded by ``SHARD_BYTES`` of phrases, counted first, so that its phrases may be broadcast;
each worker builds its automaton once.  Which hits stay is decided per document over hits sorted by length,
phrase and place: a stream that holds the places taken in one document and finds by halving whether a hit is
free of them.  Hits never meet spans by all pairs of a document.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hygiene import shared_table

SHARD_BYTES = 8 << 20
#: Single words that the second vocabulary is asked for: Latin letters and hyphens, five or more (a fixed pattern).
WORD = re.compile(r"[A-Za-z][A-Za-z\-]{4,}")

_HITS = "doc_id long, stage int, shorter int, phrase string, start long, end long, type string, text string"


def folded(text: str) -> str:
    """Lower-cased letter by letter, so that places stay what they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def inside_word(c: str) -> bool:
    return c.isalnum() or c == "_" or "À" <= c <= "ỹ"


class Finder:
    """The hits of one shard of phrases, and of one shard of single words, in a text."""

    def __init__(self, phrases: dict[str, str | None], words: dict[str, str | None]) -> None:
        import ahocorasick

        self.words, self.machine = words, ahocorasick.Automaton()
        for p, kind in phrases.items():
            self.machine.add_word(p, (p, kind))
        if phrases:
            self.machine.make_automaton()

    def find(self, text: str) -> Iterator[tuple]:
        """(stage, -length, phrase, start, end, type, text); hits of one phrase don't overlap, taken from the left."""
        if len(self.machine):
            low, far = folded(text), {}
            for last, (phrase, kind) in self.machine.iter(low):
                start, end = last + 1 - len(phrase), last + 1
                if start < far.get(phrase, 0) or (start and inside_word(text[start - 1])) or (end < len(text) and inside_word(text[end])):
                    continue
                far[phrase] = end
                yield 1, -len(phrase), phrase, start, end, kind, text[start:end]
        if self.words:
            for m in WORD.finditer(text):
                word = m.group().lower()
                if word in self.words:
                    yield 2, 0, word, m.start(), m.end(), self.words[word], m.group()


class Places:
    """Places taken in one document."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k == 0 or self.ends[k - 1] <= start

    def take(self, start: int, end: int) -> None:
        """Adds a place; places that it overlaps become one with it."""
        hi = bisect_left(self.starts, end)
        lo = hi
        while lo and self.ends[lo - 1] > start:
            lo -= 1
        if lo < hi:
            start, end = min(start, self.starts[lo]), max(end, self.ends[hi - 1])
        self.starts[lo:hi], self.ends[lo:hi] = [start], [end]


_FINDERS: dict[str, Finder] = {}


def _finder(mark: str, shared) -> Finder:
    """This worker's automaton, kept from task to task."""
    if mark not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[mark] = Finder(*shared.value)
    return _FINDERS[mark]


def _shards(vocabulary: DataFrame, shard_bytes: int) -> Iterator[dict[str, str | None]]:
    """The vocabulary by shard, of which none is more than it may be; one shard is on the driver at a time."""
    total = vocabulary.agg(F.coalesce(F.sum(F.octet_length("phrase") + 16), F.lit(0))).first()[0]
    many = max(1, -(-2 * total // shard_bytes)) if total > shard_bytes else 1
    for k in range(many):
        own = vocabulary.where(F.pmod(F.xxhash64("phrase"), F.lit(many)) == k).collect()
        yield {r["phrase"]: r["type"] for r in own}


def hits(docs: DataFrame, vocabulary: DataFrame, words: DataFrame | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """All whole-word hits of ``vocabulary(phrase, type)``, and of single ``words(phrase, type)``, in any letter case."""
    spark = docs.sparkSession
    clean = lambda v: shared_table(v.where("phrase <> ''").select(F.lower("phrase").alias("phrase"), F.col("type").cast("string").alias("type")).groupBy("phrase").agg(F.min("type").alias("type")), "phrases")
    runs = chain(((s, {}) for s in _shards(clean(vocabulary), shard_bytes)), (({}, s) for s in _shards(clean(words), shard_bytes)) if words is not None else ())
    out = None
    for phrases, single in runs:
        shared = spark.sparkContext.broadcast((phrases, single))
        mark = hashlib.sha256(repr((sorted(phrases.items(), key=repr), sorted(single.items(), key=repr))).encode()).hexdigest()

        def run(batches: Iterator[pa.RecordBatch], mark=mark, shared=shared) -> Iterator[pa.RecordBatch]:
            finder = _finder(mark, shared)
            for batch in batches:
                for s in range(0, batch.num_rows, 256):
                    part = batch.slice(s, 256)
                    rows = [(d, *h) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if t for h in finder.find(t)]
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], y) for c, y in enumerate(kinds)], names=["doc_id", "stage", "shorter", "phrase", "start", "end", "type", "text"])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _HITS)
        out = found if out is None else out.union(found)
    return out


def take_free(candidates: DataFrame) -> DataFrame:
    """Of candidates (as :func:`hits` gives them; stage 0 is occupied) those that are free, first come first taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, places = None, Places()
        for batch in batches:
            kept = []
            for i, (d, stage, start, end) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "stage", "start", "end")), strict=True)):
                if d != doc:
                    doc, places = d, Places()
                if stage == 0 or places.free(start, end):
                    places.take(start, end)
                    if stage:
                        kept.append(i)
            yield batch.take(pa.array(kept, pa.int32()))

    return candidates.repartition("doc_id").sortWithinPartitions("doc_id", "stage", "shorter", "phrase", "start").mapInArrow(run, _HITS)


def sweep(docs: DataFrame, vocabulary: DataFrame | list[str], occupied: DataFrame | None = None, words: DataFrame | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, start, end, text, type, stage): hits of ``vocabulary(phrase, type)`` longest first, off ``occupied(doc_id, start, end)``.

    Equal lengths go by phrase, one phrase's hits from left to right.  Then come single words of ``words(phrase,
    type)`` (stage 2), where the place is still free.  A vocabulary may be a list too (its type is null).  Empty
    phrases match nothing, and a null text has no hits; rows of one id, null too, are one document.
    """
    if isinstance(vocabulary, list):
        vocabulary = docs.sparkSession.createDataFrame([(p, None) for p in vocabulary], "phrase string, type string")
    all_ = hits(docs, vocabulary, words, shard_bytes)
    if occupied is not None:
        place = lambda c: F.col(c).cast("long").alias(c)
        none = lambda c: F.lit(None).cast("string").alias(c)
        all_ = all_.union(occupied.select(place("doc_id"), F.lit(0).alias("stage"), F.lit(0).alias("shorter"), F.lit("").alias("phrase"), place("start"), place("end"), none("type"), none("text")))
    return take_free(all_).select("doc_id", "start", "end", "text", "type", "stage")
