"""Words of Arrow string columns as 64-bit hashes, vectorised over raw UTF-8.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z count as a-z.
Bytes of multi-byte characters never fall in those ranges, so working on bytes
equals working on code points. A word's hash chains a bijective mixer over its
bytes, eight at a time, from a start that its length and a seed give: words of up
to eight bytes and equal length never meet, and no arrangement of bytes makes
others meet more often than chance. Where a result rests on hashes being different,
operators draw a seed for each run.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18  # bytes of text that are worked on at once
SEGMENT = 64  # longer spans are hashed in parts of so many bytes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of consecutive rows. ``first[i]:first[i+1]`` are those of row ``i``; ``low`` is ``data`` in lower case."""

    rows: range
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray
    low: Bytes


def _tables():
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return low, space


class Bytes:
    """Bytes whose spans can be hashed."""

    def __init__(self, b: np.ndarray):
        self.n = len(b)
        padded = np.empty(self.n + 8, np.uint8)
        padded[: self.n], padded[self.n :] = b, 0
        # Eight bytes from every place on.
        self.eight = np.ndarray((self.n + 1,), "<u8", padded, strides=(1,))

    def _chain(self, start: np.ndarray, n: np.ndarray, h: np.ndarray) -> np.ndarray:
        h = mix(h ^ (self.eight[start] & _MASK[np.minimum(n, 8)]))
        rest, at = np.flatnonzero(n > 8), 8
        while len(rest):
            left = n[rest] - at
            h[rest] = mix(h[rest] ^ (self.eight[start[rest] + at] & _MASK[np.minimum(left, 8)]))
            rest, at = rest[left > 8], at + 8
        return h

    def hashes(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        """A hash of each span ``start:end``, by its bytes, its length and ``seed``."""
        n = end - start
        with np.errstate(over="ignore"):
            key = np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) % (1 << 64))
            h = mix(n.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) ^ key)
            long = np.flatnonzero(n > SEGMENT)
            if not len(long):
                return self._chain(start, n, h)
            out = np.empty(len(n), np.uint64)
            short = np.flatnonzero(n <= SEGMENT)
            out[short] = self._chain(start[short], n[short], h[short])
            # Parts hash by themselves, with their number in the span, and add up.
            many = -(-n[long] // SEGMENT)
            begin = np.cumsum(many) - many
            part = np.arange(many.sum()) - np.repeat(begin, many)
            at = np.repeat(start[long], many) + part * SEGMENT
            size = np.minimum(np.repeat(end[long], many) - at, SEGMENT)
            parts = self._chain(at, size, mix(np.repeat(h[long], many) + part.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
            out[long] = mix(np.add.reduceat(mix(parts), begin) ^ h[long])
            return out


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def kept() -> dict:
    """What a worker process keeps from task to task (functions arrive by value, so their modules keep nothing)."""
    return sys.modules.setdefault("_lakeassay_kept", types.ModuleType("_lakeassay_kept")).__dict__


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def words(col: pa.Array | pa.ChunkedArray, chunk: int = CHUNK, seed: int = 0) -> Iterator[Words]:
    """Every row of ``col`` once, whole, in order; at least one row at a time."""
    kept().pop("encoder", None)  # a worker that turns to other work lets its tokenizer go
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return
    off, data = buffers(col)
    low, space = _tables()
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(off, off[at] + chunk, "right")) - 1)
        b = data[off[at] : off[to]]
        ends = off[at : to + 1] - off[at]
        solid = ~space[b]
        edge = np.zeros(len(b) + 1, bool)
        edge[ends] = True
        before = np.empty(len(b), bool)
        before[:1] = True
        before[1:] = ~solid[:-1]
        start = np.flatnonzero(solid & (before | edge[:-1]))
        after = np.empty(len(b), bool)
        after[-1:] = True
        after[:-1] = ~solid[1:]
        end = np.flatnonzero(solid & (after | edge[1:])) + 1
        lowered = Bytes(low[b])
        yield Words(range(at, to), lowered.hashes(start, end, seed), start, end, np.searchsorted(start, ends), b, lowered)
        at = to


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word runs, and where each row's begin; a row of 1 to k-1 words has its whole sequence as one."""
    n = np.diff(w.first)
    with np.errstate(over="ignore"):
        m = max(0, len(w.hash) - k + 1)
        # A word's hash is even over 64 bits, so a sum with odd weights, mixed, tells runs apart; order counts.
        acc = np.zeros(m, np.uint64)
        for j in range(k):
            acc += w.hash[j : j + m] * np.uint64(pow(0xA24BAED4963EE407, j + 1, 1 << 64))
        acc = mix(acc)
        count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        first = np.concatenate([[0], np.cumsum(count)])
        row = np.repeat(np.arange(len(n)), count)
        src = w.first[:-1][row] + np.arange(first[-1]) - first[row]
        out = acc[np.minimum(src, max(0, len(acc) - 1))] if len(acc) else np.zeros(first[-1], np.uint64)
        for i in np.flatnonzero((n > 0) & (n < k)):
            x = np.uint64(n[i])
            for v in w.hash[w.first[i] : w.first[i + 1]]:
                x = mix(np.array([x * np.uint64(0x9FB21C651E98DF25) + v]))[0]
            out[first[i]] = x
    return out, first


def sorted_sets(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, ascending, and where each row's begin."""
    parts, count = [], np.zeros(len(first) - 1, np.int64)
    for i in range(len(first) - 1):
        s = np.sort(h[first[i] : first[i + 1]])
        if len(s) > 1:
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        parts.append(s)
        count[i] = len(s)
    return np.concatenate(parts) if parts else h[:0], np.concatenate([[0], np.cumsum(count)])


@dataclass
class Lines:
    """``\\n``-split lines of consecutive rows (an empty row has one). ``lo:hi`` is a line, ``start:end`` what is left of
    it without ``[\\x20\\x09-\\x0D]`` at both ends; ``hash`` is of that part with A-Z as a-z; ``points`` are its code points."""

    rows: range
    first: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    points: np.ndarray
    data: np.ndarray


def lines(col: pa.Array, chunk: int = CHUNK, seed: int = 0) -> Iterator[Lines]:
    if not len(col):
        return
    off, data = buffers(col)
    low, space = _tables()
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(off, off[at] + chunk, "right")) - 1)
        b = data[off[at] : off[to]]
        ends = off[at : to + 1] - off[at]
        cut = np.flatnonzero(b == 10)
        row = np.searchsorted(ends, cut, "right") - 1
        # Lines are numbered row by row: each row has its newlines and one more.
        count = np.bincount(row, minlength=to - at) + 1
        first = np.concatenate([[0], np.cumsum(count)])
        lo, hi = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
        lo[first[:-1]], hi[first[1:] - 1] = ends[:-1], ends[1:]
        k = np.arange(len(cut)) + row
        hi[k], lo[k + 1] = cut, cut + 1
        solid = np.flatnonzero(~space[b])
        i, j = np.searchsorted(solid, lo), np.searchsorted(solid, hi)
        some = j > i
        start = np.where(some, solid[np.minimum(i, max(0, len(solid) - 1))] if len(solid) else 0, lo)
        end = np.where(some, (solid[np.maximum(j - 1, 0)] if len(solid) else 0) + 1, lo)
        h = Bytes(low[b]).hashes(start, end, seed)
        points = np.zeros(len(b) + 1, np.int64)
        np.cumsum((b & 0xC0) != 0x80, out=points[1:])
        yield Lines(range(at, to), first, lo, hi, start, end, h, points[end] - points[start], b)
        at = to
