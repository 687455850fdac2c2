"""Phrases that follow themselves at once, counted as ``(.{6,}?)\\1`` finds them, in time that grows as n log n.

A regular expression tries every length at every place.  Here a repeat of length L is looked for only at places p that
are multiples of L: one that begins in (p - L, p] holds both p and p + L, so what agrees to the right and to the left of
the two adds up to L or more.  Agreement is tested by rolling hashes over many (L, p) at a time, and each repeat that is
counted is compared letter by letter.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST = 6
#: (L, p) tested at a time, and letters taken together.
PAIRS, LETTERS = 1 << 20, 1 << 17
#: What ends a line to the regular expression.
ENDS = (0x0A, 0x0D, 0x85, 0x2028, 0x2029)
_PLAIN = re.compile(r"([^\n\r\x85\u2028\u2029]{6,}?)\1")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _intervals(codes: np.ndarray) -> np.ndarray:
    """(L, first, last) rows: places at which a repeat of length L begins, of all lines of ``codes``; line ends differ from all."""
    n, letters = len(codes), codes.astype(np.int32)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * _SPREAD
    mixed ^= mixed >> np.uint64(29)
    power = _powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    prefix[1:] = np.add.accumulate(mixed * power[:n])

    def same(p: np.ndarray, far: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` letters from p on equal those from p + far on (bounds are the caller's)."""
        return (prefix[p + size] - prefix[p]) * power[far] == prefix[p + far + size] - prefix[p + far]

    def agree(p: np.ndarray, far: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many letters agree from p and p + far on (or before them), up to ``most``."""
        low, high = np.zeros(len(p), np.int64), most.copy()
        while len(p) and (low < high).any():
            half = (low + high + 1) >> 1
            ok = same(p - half if back else p, far, half)
            low, high = np.where(ok, half, low), np.where(ok, high, half - 1)
        return low

    stops = np.append(np.flatnonzero(codes < 0), n)
    starts = np.concatenate(([0], stops[:-1] + 1))
    room = (stops - starts) // 2 - LEAST + 1
    some = room > 0
    starts, stops, room = starts[some], stops[some], room[some]
    total = int(room.sum())
    out = []
    if not total:
        return np.zeros((0, 3), np.int64)
    first = np.cumsum(room) - room
    at = 0
    while at < total:
        # Rows (line, L), as many as their places fit; the most places are with the shortest L.
        take = min(total - at, PAIRS)
        k = np.arange(at, at + take)
        line = np.searchsorted(first, k, "right") - 1
        size = k - first[line] + LEAST
        places = (stops[line] - starts[line] - 1 - size) // size + 1
        upto = np.cumsum(places)
        fit = max(1, int(np.searchsorted(upto, PAIRS, "right")))
        line, size, places = line[:fit], size[:fit], places[:fit]
        at += fit
        far = np.repeat(size.astype(np.int32), places)
        # A row's places go up by its L, from the line's start on.
        step = far.copy()
        head = np.cumsum(places) - places
        step[head] = starts[line] - np.concatenate(([0], (starts[line] + (places - 1) * size)[:-1]))
        p = np.cumsum(step, dtype=np.int32)
        # Right and left agreement add up to L: one of them is half of it or more.  The letter next to p tells most apart.
        other = p + far
        near = np.flatnonzero((letters[p] == letters[other]) | (letters[p - 1] == letters[other - 1]))
        if not len(near):
            continue
        row = np.searchsorted(head, near, "right") - 1
        p, far, low, high = p[near].astype(np.int64), far[near].astype(np.int64), starts[line][row], stops[line][row]
        half = (far + 1) >> 1
        right = p + far + half <= high
        right[right] = same(p[right], far[right], half[right])
        left = (p - half >= low) & ~right
        left[left] = same(p[left] - half[left], far[left], half[left])
        hit = np.flatnonzero(right | left)
        if not len(hit):
            continue
        p, far, low, high = p[hit], far[hit], low[hit], high[hit]
        after = agree(p, far, np.minimum(far, high - p - far), False)
        before = agree(p, far, np.minimum(far - 1, p - low), True)
        good = after + before >= far
        out.append(np.stack([far, p - before, p + after - far], 1)[good])
    rows = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    if len(rows) < 2:
        return rows
    # Those of one length that touch are one.
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] > rows[:-1, 2] + 1)
    begin = np.flatnonzero(new)
    return np.stack([rows[begin, 0], rows[begin, 1], np.maximum.reduceat(rows[:, 2], begin)], 1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


def count_repeats(texts: list[str]) -> list[int]:
    """The number of repeats of each text, from the left, none inside another, at a place the shortest."""
    if not texts:
        return []
    parts = [_codes(t) for t in texts]
    bounds = np.cumsum([0] + [len(p) + 1 for p in parts])
    codes = np.concatenate([x for p in parts for x in (p, np.array([10], np.int64))])
    ends = np.isin(codes, ENDS)
    codes[ends] = -1 - np.flatnonzero(ends)
    rows = _intervals(codes)
    rows = rows[np.argsort(rows[:, 1], kind="stable")].tolist()
    counts, heap, k, at = [0] * len(texts), [], 0, 0
    bad = set()
    while heap or k < len(rows):
        if not heap:
            at = max(at, rows[k][1])
        while k < len(rows) and rows[k][1] <= at:
            heapq.heappush(heap, (rows[k][0], rows[k][2]))
            k += 1
        while heap and heap[0][1] < at:
            heapq.heappop(heap)
        if not heap:
            continue
        size = heap[0][0]
        text = int(np.searchsorted(bounds, at, "right")) - 1
        if not np.array_equal(codes[at : at + size], codes[at + size : at + 2 * size]):
            # Two hashes met by chance: this text is read the plain way.
            bad.add(text)
            at += 1
            continue
        counts[text] += 1
        at += 2 * size
    for text in bad:
        counts[text] = len(_PLAIN.findall(texts[text]))
    return counts


@F.arrow_udf(T.IntegerType())
def phrase_repeats(texts: pa.Array) -> pa.Array:
    """How often ``(.{6,}?)\\1`` is found in each text; null for a null text."""
    out, some, size = [], [], 0
    for t in [*texts.to_pylist(), None]:
        if t is not None:
            some.append(t)
            size += len(t)
        if some and (t is None or size >= LETTERS):
            out += count_repeats(some)
            some, size = [], 0
        if t is None:
            out.append(None)
    return pa.array(out[:-1], pa.int32())
