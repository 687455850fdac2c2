"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

``Vocabulary`` reads a public tokenizer file (byte-level BPE with word ends, lower-cased, white space
dropped).  ``word_counts`` counts the words of all documents (map-side combined, then one shuffle of words);
the ``lexicon_size`` most frequent are encoded by exact merging and compiled into a minimal acyclic
transducer: words share prefixes and suffixes, and the outputs on a path add up to the word's number, which
finds its ids.  The transducer is one byte string of fixed arrays (bounded by ``lexicon_size``; a few MB): it
travels as a broadcast, and every worker maps it into memory from a file that it unlinks at once.

``encode`` splits whole texts into words, looks up a slice's distinct words in the transducer (all at once, a
byte of each word per step) and merges exactly those it lacks, so the lexicon decides speed, never results.
Exact merging is also done for all words of a length at once; words of more than ``LONG`` bytes use a heap,
which keeps a word of a million letters at n log n.

Defined cases: null text is empty (no ids, decoded to the empty string); the special tokens' strings in a
text become their ids, as the public library has it by default; repeated rows are encoded each; an empty
table gives no rows; columns named as the results are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import struct
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, most_frequent, spread, table, text_slices, without

TOKENIZER = "word_bpe_49k.json"
LEXICON_SIZE = 1 << 15
LEXICON_WORD_BYTES = 32
LONG = 40
CACHE_WORDS = 200_000
END = "</w>"
_NONE = np.int32(2**31 - 1)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte (a fixed rule)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and word pattern of a tokenizer file, with exact merging of single words and batches."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for text, k in [*ids.items(), *self.special.items()]:
            self.token[k] = text
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int32)
        self.last = np.array([ids[c + END] for c in letters], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merged = np.array([ids[a + b] for a, b in merges], np.int32)
        keys = np.array([(ids[a] << 16) | ids[b] for a, b in merges], np.uint64)
        # Open addressing with linear probing; the slots hold ranks.
        self._bits = int(np.ceil(np.log2(max(2, len(keys))))) + 2
        self._slot_key = np.full(1 << self._bits, np.uint64(2**63), np.uint64)
        self._slot_rank = np.full(1 << self._bits, _NONE, np.int32)
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            free = self._slot_rank[at] == _NONE
            self._slot_rank[at[free]] = todo[free]  # the last writer of a slot wins; the others go on
            won = self._slot_rank[at] == todo
            self._slot_key[at[won]] = keys[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & ((1 << self._bits) - 1)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(pattern)
        self.ascii_word = re.compile(pattern.replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}\p{N}", "a-z0-9"), re.ASCII)
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids; ``_NONE`` where there is no such merge."""
        keys = (left.astype(np.uint64) << np.uint64(16)) | right.astype(np.uint64)
        at = self._home(keys)
        out = np.where(self._slot_key[at] == keys, self._slot_rank[at], _NONE)
        todo = np.flatnonzero((out == _NONE) & (self._slot_rank[at] != _NONE))
        at = at[todo]
        while len(todo):
            at = (at + 1) & ((1 << self._bits) - 1)
            hit = self._slot_key[at] == keys[todo]
            out[todo[hit]] = self._slot_rank[at[hit]]
            go = ~hit & (self._slot_rank[at] != _NONE)
            todo, at = todo[go], at[go]
        return out

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if text.isascii():
            return self.ascii_word.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        # Letter by letter, a capital sigma has one small form wherever it stands.
        return self.word.findall(text.replace("Σ", "σ").lower())

    def pieces(self, text: str) -> list[str | int]:
        """Words, and the ids of special tokens, of a text in order."""
        if self._specials is None or "<|" not in text:
            return self.split(text)
        out: list[str | int] = []
        for k, part in enumerate(self._specials.split(text)):
            if k % 2:
                out.append(self.special[part])
            else:
                out += self.split(part)
        return out

    def merge_long(self, word: bytes) -> list[int]:
        """Exact merging of one word by a heap of pairs."""
        ids = [*self.inner[list(word[:-1])].tolist(), int(self.last[word[-1]])]
        left, right = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        array = np.array(ids)
        first = self.ranks(array[:-1], array[1:])
        heap = [(int(first[k]), k, ids[k], ids[k + 1]) for k in np.flatnonzero(first != _NONE).tolist()]
        heapq.heapify(heap)

        def push(k: int) -> None:
            if k >= 0 and right[k] >= 0:
                a, b = ids[k], ids[right[k]]
                if (rank := self._rank_of(a, b)) is not None:
                    heapq.heappush(heap, (rank, k, a, b))

        while heap:
            rank, k, a, b = heapq.heappop(heap)
            r = right[k]
            if ids[k] != a or r < 0 or ids[r] != b:
                continue
            ids[k], ids[r] = int(self.merged[rank]), -1
            right[k] = right[r]
            if right[r] >= 0:
                left[right[r]] = k
            push(left[k])
            push(k)
        return [x for x in ids if x >= 0]

    def _rank_of(self, a: int, b: int) -> int | None:
        if not hasattr(self, "_pairs"):
            used = self._slot_rank != _NONE
            self._pairs = dict(zip(self._slot_key[used].tolist(), self._slot_rank[used].tolist(), strict=True))
        return self._pairs.get((a << 16) | b)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids (little-endian 32-bit) of each non-empty word; words of equal length are merged together."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for length, own in by_length.items():
            if length > LONG:
                for k in own:
                    out[k] = np.array(self.merge_long(words[k]), "<u4").tobytes()
                continue
            raw = np.frombuffer(b"".join(words[k] for k in own), np.uint8).reshape(len(own), length)
            ids = self.inner[raw]
            ids[:, -1] = self.last[raw[:, -1]]
            place = np.array(own)
            rank = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(own), length - 1)
            while True:
                if ids.shape[1] == 1:
                    done = np.ones(len(ids), bool)
                else:
                    best = rank.argmin(1)
                    low = rank[np.arange(len(rank)), best]
                    done = low == _NONE
                if done.any():
                    for k, row in zip(place[done].tolist(), ids[done].astype("<u4"), strict=True):
                        out[k] = row.tobytes()
                    if done.all():
                        break
                    go = ~done
                    ids, rank, place, best, low = ids[go], rank[go], place[go], best[go], low[go]
                rows, width = np.arange(len(ids)), ids.shape[1]
                ids[rows, best] = self.merged[low]
                keep = np.arange(width - 1) + (np.arange(width - 1) > best[:, None])
                ids = np.take_along_axis(ids, keep, 1)
                keep = np.arange(width - 2) + (np.arange(width - 2) >= best[:, None])
                rank = np.take_along_axis(rank, keep, 1)
                for shift in (-1, 0):
                    at = best + shift
                    fits = (at >= 0) & (at < width - 2)
                    r, a = rows[fits], at[fits]
                    rank[r, a] = self.ranks(ids[r, a], ids[r, a + 1])
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: this kind of file has no decoder, so tokens are joined by spaces."""
        return " ".join(map(self.token.__getitem__, ids))


class Transducer:
    """A minimal acyclic transducer from byte strings to id sequences.

    Built from sorted words by adding one word at a time and folding finished states into equal ones (the
    incremental algorithm for sorted input), then laid out as arrays: arcs sorted by (state, byte), each with
    its target and output; final flags; and the ids by word number.  The outputs along a path sum to the
    number of words sorted before, so they are fixed by the states alone and suffixes stay shared.
    """

    MAGIC = b"MATX"

    def __init__(self, raw) -> None:
        n_arcs, n_states, n_words, n_ids, self.longest = struct.unpack_from("<5q", raw, 4)
        at = 48

        def take(n: int, kind) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes + (-out.nbytes) % 8
            return out

        self.key, self.target, self.output = take(n_arcs, np.int64), take(n_arcs, np.int32), take(n_arcs, np.int32)
        self.final, self.start, self.ids = take(n_states, np.uint8), take(n_words + 1, np.int32), take(n_ids, "<u4")

    @classmethod
    def mapped(cls, raw: bytes) -> Transducer:
        """From a memory-mapped file, which has no name any more once it is mapped."""
        fd, path = tempfile.mkstemp(prefix="lexicon-")
        try:
            with os.fdopen(fd, "wb") as f:
                f.write(raw)
            return cls(np.memmap(path, np.uint8, "r"))
        finally:
            os.unlink(path)

    @staticmethod
    def compile(entries: dict[bytes, bytes]) -> bytes:
        """The bytes of a transducer from words to their ids (packed 32-bit)."""
        words = sorted(entries)
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        known: dict[tuple, int] = {}

        def fold(path: list[tuple[int, int]], keep: int) -> None:
            while len(path) > keep:
                parent, label = path.pop()
                child = arcs[parent][label]
                sign = (final[child], tuple(arcs[child].items()))
                same = known.setdefault(sign, child)
                if same != child:
                    arcs[parent][label] = same
                    if child == len(arcs) - 1:
                        arcs.pop()
                        final.pop()

        path: list[tuple[int, int]] = []
        before = b""
        for w in words:
            common = len(os.path.commonprefix([w, before]))
            fold(path, common)
            at = arcs[path[-1][0]][path[-1][1]] if path else 0
            for label in w[common:]:
                arcs.append({})
                final.append(False)
                arcs[at][label] = len(arcs) - 1
                path.append((at, label))
                at = len(arcs) - 1
            final[at] = True
            before = w
        fold(path, 0)

        # Words below each state (children before parents), then outputs.
        below: dict[int, int] = {}
        todo = [0]
        while todo:
            s = todo[-1]
            open_ = [t for t in arcs[s].values() if t not in below]
            if open_:
                todo += open_
            else:
                below[s] = final[s] + sum(below[t] for t in arcs[s].values())
                todo.pop()
        number = {s: k for k, s in enumerate(sorted(below))}
        key, target, output = [], [], []
        for s in sorted(below):
            run = int(final[s])
            for label, t in sorted(arcs[s].items()):
                key.append((number[s] << 8) | label)
                target.append(number[t])
                output.append(run)
                run += below[t]
        ids = [entries[w] for w in words]
        start = np.zeros(len(words) + 1, np.int32)
        np.cumsum([len(x) // 4 for x in ids], out=start[1:])
        parts = (np.array(key, np.int64), np.array(target, np.int32), np.array(output, np.int32), np.array([final[s] for s in sorted(below)], np.uint8), start, np.frombuffer(b"".join(ids), "<u4"))
        head = Transducer.MAGIC + struct.pack("<5q", len(key), len(below), len(words), int(start[-1]), max(map(len, words), default=0)) + b"\0" * 4
        return head + b"".join(p.tobytes() + b"\0" * ((-p.nbytes) % 8) for p in parts)

    def lookup(self, words: list[bytes]) -> list[bytes | None]:
        """The packed ids of each word, None for words that the lexicon lacks; all words step together."""
        if not words or not len(self.key):
            return [None] * len(words)
        lens = np.array([len(w) for w in words])
        width = int(min(self.longest, lens.max()))
        grid = np.zeros((len(words), width), np.uint8)
        fits = lens <= width
        flat = np.frombuffer(b"".join(w for w, f in zip(words, fits, strict=True) if f), np.uint8)
        own = lens[fits]
        rows = np.repeat(np.flatnonzero(fits), own)
        grid[rows, np.arange(len(flat)) - np.repeat(np.cumsum(own) - own, own)] = flat
        state, number, live = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), fits & (lens > 0)
        for k in range(width):
            go = np.flatnonzero(live & (lens > k))
            if not len(go):
                break
            want = (state[go] << 8) | grid[go, k]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[at] == want
            live[go[~hit]] = False
            state[go[hit]] = self.target[at[hit]]
            number[go[hit]] += self.output[at[hit]]
        live &= self.final[state] > 0
        out: list[bytes | None] = [None] * len(words)
        for k in np.flatnonzero(live).tolist():
            n = number[k]
            out[k] = self.ids[self.start[n] : self.start[n + 1]].tobytes()
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """(word, n): how often each word of at most ``LEXICON_WORD_BYTES`` bytes occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, seen = vocabulary(path), Counter()

        def flush() -> pa.RecordBatch:
            own = [(w, n) for w, n in seen.items() if isinstance(w, str) and len(w.encode()) <= LEXICON_WORD_BYTES]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in own], pa.string()), pa.array([n for _, n in own], pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, j, data, offs in text_slices(batch):
                raw = data.tobytes()
                for r in range(j - i):
                    seen.update(voc.pieces(raw[offs[r] : offs[r + 1]].decode()))
                if len(seen) > CACHE_WORDS:
                    yield flush()
        yield flush()

    counted = docs.select("text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, lexicon_size: int = LEXICON_SIZE) -> bytes:
    """The transducer of the most frequent words; at most ``lexicon_size`` of them reach the driver."""
    counts = cut(word_counts(docs, path), "words")
    top = most_frequent(counts, "word", lexicon_size).orderBy(F.desc("n"), "word").limit(lexicon_size).collect()
    words = [r["word"].encode() for r in top]
    return Transducer.compile(dict(zip(words, vocabulary(path).merge(words), strict=True)))


class Encoder:
    """Encodes texts in one worker: words seen of late, then the transducer, then exact merging."""

    def __init__(self, path: str, lexicon: bytes) -> None:
        self.voc, self.fst, self.seen = vocabulary(path), Transducer.mapped(lexicon), {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        split = [self.voc.pieces(t) for t in texts]
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        new = [w for w in set().union(*split) if w not in self.seen]
        words = [w for w in new if isinstance(w, str)]
        for w in new:
            if not isinstance(w, str):
                self.seen[w] = struct.pack("<I", w)
        raw = [w.encode() for w in words]
        found = self.fst.lookup(raw)
        lack = [k for k, f in enumerate(found) if f is None]
        for k, ids in zip(lack, self.voc.merge([raw[k] for k in lack]), strict=True):
            found[k] = ids
        self.seen.update(zip(words, found, strict=True))
        get = self.seen.__getitem__
        return [b"".join(map(get, own)) for own in split]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, mark: str, shared) -> Encoder:
    """This worker's encoder, kept from task to task; ``mark`` tells one lexicon from another."""
    key = (path, mark)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(path, shared.value)
    return _ENCODERS[key]


def encode(docs: DataFrame, path: str | None = None, lexicon: bytes | None = None, decoded: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids (packed little-endian 32-bit) and, if asked, decoded (the text of the ids)."""
    path = path or tokenizer_path()
    lexicon = build_lexicon(docs, path) if lexicon is None else lexicon
    shared, mark = docs.sparkSession.sparkContext.broadcast(lexicon), hashlib.sha256(lexicon).hexdigest()
    names = ["n_tokens", "ids", *(["decoded"] if decoded else [])]
    docs = without(docs, "n_tokens", "ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, mark, shared)
        for batch in batches:
            for i, j, data, offs in text_slices(batch):
                raw = data.tobytes()
                ids = enc.encode([raw[offs[r] : offs[r + 1]].decode() for r in range(j - i)])
                new = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    new.append(pa.array([enc.voc.decode(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *new], names=[*batch.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, n_tokens long, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (with a column ids as :func:`encode` makes it) with the column decoded."""
    path = path or tokenizer_path()
    encoded = without(encoded, "decoded")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            texts = [voc.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{fields}, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids)."""
    out = encode(docs.select("doc_id", "text"), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"), "ids")


def bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spread(table(spark, sf_dir, "documents"))).drop("ids")
