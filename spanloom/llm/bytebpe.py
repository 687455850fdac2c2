"""Byte-level BPE by recursive DuckDB queries inside each partition.

``Ranks`` reads a public rank file: a token's bytes and its rank, which is its id.  Two neighbouring tokens
merge if their joined bytes are a token, whichever way that token was first made, so the merge table has every
split of every token into two tokens.  In a partition, ``Encoder`` cuts whole texts into pieces by the public
pattern, and encodes the distinct pieces that it hasn't seen of late in one recursive query over rows (piece,
position, token): a step joins neighbours with the merge table, finds each piece's leftmost pair of minimum
rank, and contracts it; a piece without a pair leaves the recursion.  A piece that is a token as a whole is
that token, as the public library has it.  Decoding joins (row, position, id) with the vocabulary and
aggregates the bytes in order of position; a piece's ids are decoded when they are made, and a text's bytes
are those of its pieces' ids in order.

Bounds: the vocabulary and its merge table are the file's (a few MB a worker); pieces go to DuckDB
``BATCH_BYTES`` at a time; of pieces seen before, two generations of ``CACHE_PIECES`` are kept.  Neither bound
changes a result.  A step of the recursion handles all rows of the pieces still in it, which is quadratic in a
piece's length; pieces of more than ``LONG`` bytes (words of hundreds of letters, runs of one sign) are merged
in the same order by a heap, which keeps a piece of a million bytes at n log n.

Scale: one pass over the texts and no shuffle; every partition stands alone, so a lost executor costs its
partitions only.

Defined cases: null text is empty (no ids, nothing decoded); special tokens' strings in a text are ordinary
text; repeated rows are encoded each; very long texts are slices of their own, read whole; an empty table
gives no rows; columns that clash, in any letter case, with those added are replaced; decoding null ids gives
nothing, and an id that the vocabulary lacks raises.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, table, text_slices, without

RANKS = "byte_bpe_50k.tiktoken"
LONG = 256
BATCH_BYTES = 1 << 20
CACHE_PIECES = 300_000

#: One piece's tokens stand at positions 0, 1, ...; a row has its right neighbour and what the two merge into, so a
#: step looks up only pairs that are new.  ``it`` counts contractions: a piece's last rows are its result.
MERGE = """
WITH RECURSIVE step(it, piece, pos, tok, nxt, merged) AS (
    SELECT 0, piece, pos, tok, nxt, m.merged FROM start LEFT JOIN merges m ON m.pair = (tok::BIGINT << 24) | nxt
    UNION ALL
    SELECT * FROM (
        WITH best AS (
            SELECT piece, min((merged::BIGINT << 20) | pos) AS least FROM step WHERE merged IS NOT NULL GROUP BY piece
        ), win AS (
            SELECT b.piece, (least & 1048575)::INTEGER AS at, (least >> 20)::INTEGER AS made, r.nxt AS after
            FROM best b JOIN step r ON r.piece = b.piece AND r.pos = (least & 1048575)::INTEGER + 1
        ), moved AS (
            SELECT s.it + 1 AS it, s.piece, (s.pos - (s.pos > w.at)::INTEGER)::INTEGER AS pos,
                   CASE WHEN s.pos = w.at THEN w.made ELSE s.tok END AS tok,
                   CASE WHEN s.pos = w.at THEN w.after WHEN s.pos = w.at - 1 THEN w.made ELSE s.nxt END AS nxt,
                   s.merged, s.pos IN (w.at, w.at - 1) AS fresh
            FROM step s JOIN win w USING (piece) WHERE s.pos <> w.at + 1
        )
        SELECT it, piece, pos, tok, nxt, CASE WHEN fresh THEN m.merged ELSE moved.merged END
        FROM moved LEFT JOIN merges m ON m.pair = CASE WHEN fresh THEN (tok::BIGINT << 24) | nxt END
    )
), last AS (
    SELECT piece, max(it) AS it FROM step GROUP BY piece
)
SELECT piece, pos, tok FROM step JOIN last USING (piece, it)
"""

#: Ordered aggregation of the tokens' bytes (in hexadecimal) by row; ``known`` counts the ids that the vocabulary has.
DECODE = """
SELECT row, unhex(string_agg(v.hex, '' ORDER BY pos)) AS raw, count(*) AS n, count(v.id) AS known
FROM tokens LEFT JOIN vocab v ON v.id = tok GROUP BY row
"""


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def public_pattern() -> str:
    import public_tokenizers

    return str(public_tokenizers.PATTERN)


class Ranks:
    """A rank file's tokens, its merge table, and one DuckDB connection that holds both."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte = np.array([self.rank[bytes([k])] for k in range(256)], np.int32)
        self.pair: dict[tuple[int, int], int] = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    self.pair[left, right] = rank
        self.duck = duckdb.connect(config={"threads": 1})
        merges = pa.table({"pair": pa.array([a << 24 | b for a, b in self.pair], pa.int64()), "merged": pa.array(list(self.pair.values()), pa.int32())})
        vocab = pa.table({"id": pa.array(list(self.rank.values()), pa.int64()), "hex": pa.array([t.hex() for t in self.rank])})
        for name, data in (("merges", merges), ("vocab", vocab)):
            self.duck.register("given", data)
            self.duck.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.duck.unregister("given")

    def _ask(self, sql: str, **tables: pa.Table) -> pa.Table:
        for name, data in tables.items():
            self.duck.register(name, data)
        out = self.duck.sql(sql).to_arrow_table()
        for name in tables:
            self.duck.unregister(name)
        return out

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each of some distinct pieces."""
        out: list[list[int]] = [[]] * len(pieces)
        todo: list[int] = []
        for k, p in enumerate(pieces):
            if p in self.rank:
                out[k] = [self.rank[p]]
            elif len(p) > LONG:
                out[k] = self.merge_long(p)
            elif p:
                todo.append(k)
        todo.sort(key=lambda k: len(pieces[k]))
        size, run = 0, []
        for k in todo:
            run.append(k)
            size += len(pieces[k])
            if size >= BATCH_BYTES:
                self._recurse(pieces, run, out)
                size, run = 0, []
        if run:
            self._recurse(pieces, run, out)
        return out

    def _recurse(self, pieces: list[bytes], run: list[int], out: list[list[int]]) -> None:
        lens = np.array([len(pieces[k]) for k in run])
        tok = self.byte[np.frombuffer(b"".join([pieces[k] for k in run]), np.uint8)]
        piece = np.repeat(np.arange(len(run), dtype=np.int32), lens)
        ends = np.cumsum(lens)
        pos = (np.arange(len(tok)) - np.repeat(ends - lens, lens)).astype(np.int32)
        nxt = np.append(tok[1:], np.int32(-1))
        nxt[ends - 1] = -1
        got = self._ask(MERGE, start=pa.table({"piece": piece, "pos": pos, "tok": tok, "nxt": nxt}))
        piece = got["piece"].to_numpy()
        order = np.lexsort((got["pos"].to_numpy(), piece))
        ids = got["tok"].to_numpy()[order].tolist()
        at = 0
        for k, n in zip(run, np.bincount(piece, minlength=len(run)).tolist(), strict=True):
            out[k] = ids[at : at + n]
            at += n

    def merge_long(self, piece: bytes) -> list[int]:
        """The ids of one long piece: its pairs in a heap by (rank, place), neighbours as a linked list."""
        tok = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(tok)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(self.pair[tok[k], tok[k + 1]], k, tok[k], tok[k + 1]) for k in range(n - 1) if (tok[k], tok[k + 1]) in self.pair]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            other = right[k]
            if tok[k] != a or other < 0 or tok[other] != b:
                continue  # one of the two has been merged since
            tok[k], tok[other] = rank, -1
            right[k] = right[other]
            if right[k] >= 0:
                left[right[k]] = k
            for x, y in ((left[k], k), (k, right[k])):
                if x >= 0 and y >= 0 and (tok[x], tok[y]) in self.pair:
                    heapq.heappush(heap, (self.pair[tok[x], tok[y]], x, tok[x], tok[y]))
        return [t for t in tok if t >= 0]

    def decode(self, rows: list[list[int]]) -> list[bytes]:
        """The bytes of each row of ids."""
        out = [b""] * len(rows)
        at = 0
        while at < len(rows):
            size, end = 0, at
            while end < len(rows) and (end == at or size + len(rows[end]) <= BATCH_BYTES):
                size += len(rows[end])
                end += 1
            lens = np.array([len(r) for r in rows[at:end]], np.int64)
            flat = np.array(list(chain.from_iterable(rows[at:end])), np.int64)
            row = np.repeat(np.arange(at, end), lens)
            pos = np.arange(size) - np.repeat(np.cumsum(lens) - lens, lens)
            got = self._ask(DECODE, tokens=pa.table({"row": row, "pos": pos, "tok": flat}))
            if not np.array_equal(got["n"].to_numpy(), got["known"].to_numpy()):
                raise ValueError("an id is not in the vocabulary")
            for k, raw in zip(got["row"].to_pylist(), got["raw"].to_pylist(), strict=True):
                out[k] = raw
            at = end
        return out


@lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


class Encoder:
    """Encodes texts in one worker; what a piece gives is kept while it was met of late."""

    def __init__(self, path: str, pattern: str, decimal: bool) -> None:
        self.ranks, self.find = ranks(path), regex.compile(pattern).findall
        self.form = (lambda ids: " ".join(map(str, ids))) if decimal else (lambda ids: np.array(ids, "<u4").tobytes())
        self.ids: dict[str, str | bytes] = {}
        self.decoded: dict[str, bytes] = {}
        self.old_ids: dict[str, str | bytes] = {}
        self.old_decoded: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> tuple[list[list], list[bytes]]:
        """For each text the ids of its pieces, in the asked form, and its decoded bytes."""
        split = [self.find(t) for t in texts]
        if len(self.ids) > CACHE_PIECES:
            self.old_ids, self.old_decoded, self.ids, self.decoded = self.ids, self.decoded, {}, {}
        new = []
        for p in set().union(*split).difference(self.ids):
            if p in self.old_ids:
                self.ids[p], self.decoded[p] = self.old_ids[p], self.old_decoded[p]
            else:
                new.append(p)
        made = self.ranks.merge([p.encode() for p in new])
        for p, ids, back in zip(new, made, self.ranks.decode(made), strict=True):
            self.ids[p], self.decoded[p] = self.form(ids), back
        ids, decoded = self.ids.__getitem__, self.decoded.__getitem__
        return [list(map(ids, own)) for own in split], [b"".join(map(decoded, own)) for own in split]


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(*key) -> Encoder:
    """This worker's encoder, kept from task to task."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def _fields(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, decimal: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids and decoded (the bytes of the ids).

    ``ids`` are packed little-endian 32-bit integers, or with ``decimal`` a string of decimals joined by a space.
    """
    path, pattern = path or ranks_path(), pattern or public_pattern()
    docs = without(docs, "n_tokens", "ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, pattern, decimal)
        for batch in batches:
            for i, j, data, offs in text_slices(batch):
                raw = data.tobytes()
                pieces, decoded = enc.encode([raw[offs[r] : offs[r + 1]].decode() for r in range(j - i)])
                if decimal:
                    ids = pa.array([" ".join(own) for own in pieces], pa.string())
                    n = [x.count(" ") + 1 if x else 0 for x in ids.to_pylist()]
                else:
                    ids = pa.array([b"".join(own) for own in pieces], pa.binary())
                    n = [len(x) // 4 for x in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(n, pa.int64()), ids, pa.array(decoded, pa.binary())], names=[*batch.schema.names, "n_tokens", "ids", "decoded"])

    return docs.mapInArrow(run, f"{_fields(docs)}n_tokens long, ids {'string' if decimal else 'binary'}, decoded binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (with packed ids, as :func:`encode` makes them) with their bytes as ``decoded``."""
    path = path or ranks_path()
    encoded = without(encoded, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = ranks(path)
        for batch in batches:
            rows = [np.frombuffer(x or b"", "<u4").tolist() for x in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(voc.decode(rows), pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{_fields(encoded)}decoded binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids as decimals joined by a space."""
    out = encode(docs.select("doc_id", "text"), path, decimal=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def byte_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spread(table(spark, sf_dir, "documents")))
