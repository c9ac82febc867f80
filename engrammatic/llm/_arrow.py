"""Vectorised text primitives for Arrow batches in Python workers.

A *word* here is what is left of a whitespace-separated token after Unicode lower-casing and removal of ASCII
punctuation and control characters; tokens of which nothing is left are no words. Words are represented by 64-bit
hashes computed over the UTF-8 buffer of a whole slice at once: no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20

_SPACE = 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, start: int) -> np.ndarray:
    """n odd 64-bit constants that depend on start alone."""
    return mix64(np.arange(start, start + n, dtype=np.uint64) * _BASE) | np.uint64(1)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about ``most`` bytes of text each."""
    if not batch.num_rows:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64) + 16
    part = (np.cumsum(size) - size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def texts(column: pa.Array) -> pa.Array:
    """The column as large strings without nulls (a null text counts as empty)."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def _byte_map() -> np.ndarray:
    """What each byte becomes: itself, a space, or 0 for bytes that are dropped."""
    m = np.zeros(256, np.uint8)
    m[128:] = np.arange(128, 256)
    for c in range(128):
        if chr(c).isalnum():
            m[c] = c
        elif chr(c) in " \t\n\r\x0b\x0c":
            m[c] = _SPACE
    return m


class WordHasher:
    """Hashes the words of a column of texts; keeps its tables of powers from slice to slice."""

    def __init__(self) -> None:
        self.map = _byte_map()
        self.table = seeds(256, 1)
        self.mult = np.uint64(0xD6E8FEB86659FD93)
        self.inverse = np.uint64(pow(int(self.mult), -1, 1 << 64))
        self.powers = self.inverses = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 16)
            for name, m in (("powers", self.mult), ("inverses", self.inverse)):
                x = np.full(n, m, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and for each row the place of its first word (with the total at the end)."""
        a = pc.utf8_lower(texts(column))
        off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
        raw = np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
        off = off - off[0]
        mapped = self.map[raw]
        keep = mapped != 0
        kept = np.concatenate([[0], np.cumsum(keep)])
        row = kept[off]
        c = mapped[keep]
        n = len(c)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(a) + 1, np.int64)
        letter = c != _SPACE
        begins = np.zeros(n + 1, bool)
        begins[row] = True
        prev = np.concatenate([[False], letter[:-1]])
        start = np.flatnonzero(letter & (~prev | begins[:-1]))
        follows = np.concatenate([letter[1:], [False]])
        end = np.flatnonzero(letter & (~follows | begins[1:])) + 1
        self._grow(n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.table[c] * self.powers[:n])])
        h = mix64((sums[end] - sums[start]) * self.inverses[start])
        h[h == 0] = 1
        return h, np.searchsorted(start, row)


def ids_of(batch: pa.RecordBatch, column: str = "doc_id") -> np.ndarray:
    """The ids as int64; rows without an id must have been filtered before."""
    return np.asarray(batch.column(column).cast(pa.int64()))


def worker_cache(name: str, key=None) -> dict:
    """A dict that lives as long as the Python worker, which Spark reuses for many tasks.

    One operator's cache is kept at a time: asking for another name, or the same with another key, drops the one before,
    so that what one stage of a pipeline held is gone in the next.
    """
    import sys

    store = sys.modules["pyarrow"].__dict__.setdefault("_engrammatic_worker_cache", {})
    if store.get("for") != (name, key):
        store.clear()
        store.update({"for": (name, key), "cache": {}})
    return store["cache"]
