"""Vectorised text kernels on Arrow string columns, shared by the corpus operators.

A *word* is a maximal run of bytes other than ASCII white space (tab, line feed, vertical tab, form feed,
carriage return, space).  All arithmetic is modulo 2**64 on numpy arrays; there is no Python loop per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), kept per process and grown when needed."""
    have = _tables.get(name)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        _tables[name] = have = np.multiply.accumulate(out)
    return have[:n]


def span_weights(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of n places in a sum of word hashes, and what makes a difference of sums independent of its place."""
    return _powers("word", _MUL, n), _powers("inverse", _MUL_INV, n)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string column; a null counts as the empty text."""
    if pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `limit` bytes of text each (a longer row stands alone)."""
    if not batch.num_rows:
        return
    _, offsets = string_buffers(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(batch.num_rows, max(start + 1, end))
        yield batch.slice(start, end - start)
        start = end


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library than glibc
    _trim = None


def release() -> None:
    """Memory that is freed, but kept by this process for later, goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


class Words:
    """The words of a column of texts: byte bounds, owner row, and 64-bit hashes with range queries."""

    def __init__(self, col: pa.Array) -> None:
        data, offsets = string_buffers(col)
        self.data, self.offsets, n = data, offsets, len(data)
        solid = ~_SPACE[data]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        edge = offsets[:-1][offsets[:-1] < n]
        begin[edge] = solid[edge]
        finish = solid.copy()
        finish[:-1] &= ~solid[1:]
        edge = edge[edge > 0] - 1
        finish[edge] = solid[edge]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.starts, offsets)  # word index of each row's first word; n+1 entries
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self._begin, self._solid = begin, solid
        self._hash: np.ndarray | None = None
        self._prefix: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            if not len(self.starts):
                self._hash = np.zeros(0, np.uint64)
            else:
                lengths = np.diff(np.append(self.starts, len(self.data)))
                within = np.arange(self.starts[0], len(self.data)) - np.repeat(self.starts, lengths)
                weight = _powers("byte", _MUL, int((self.ends - self.starts).max()) + 1)
                v = np.where(self._solid[self.starts[0] :], _BYTE[self.data[self.starts[0] :]], np.uint64(0))
                np.minimum(within, len(weight) - 1, out=within)
                v *= weight[within]
                self._hash = mix(np.add.reduceat(v, self.starts - self.starts[0]))
        return self._hash

    @property
    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            h = self.hash
            self._prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers("word", _MUL, len(h) + 1)[: len(h)], dtype=np.uint64)])
        return self._prefix

    def span_hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """A hash of words lo..hi-1, the same wherever they stand."""
        c = self.prefix
        return mix((c[hi] - c[lo]) * _powers("inverse", _MUL_INV, len(c) + 1)[lo] + (hi - lo).astype(np.uint64))

    def gram_hash(self, k: int) -> np.ndarray:
        """A hash of words i..i+k-1 for every i that leaves k words in the batch; rows aren't looked at."""
        i = np.arange(max(0, len(self) - k + 1))
        return self.span_hash(i, i + k)


def _slide(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over x[i:i+w] for each i, shorter at the end, by doubling."""
    out, have = x.copy(), 1
    while have < w:
        step = min(have, w - have)
        if step < len(out):
            out[:-step] = op(out[:-step], out[step:])
        have += step
    return out


def winnow(words: Words, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and hashes of the gram-word anchors: those with the least hash in some span-word window.

    Every span-word window of a row holds at least one, and equal windows hold the same ones.
    """
    n = len(words)
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = words.gram_hash(gram)
    w = span - gram + 1
    least = _slide(g, w, np.minimum)[: n - span + 1]
    row = words.row
    least = np.where(row[: n - span + 1] == row[span - 1 :], least, np.uint64(0))  # windows across rows count for nothing
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(max(0, len(g) - len(least)), np.uint64)])
    most = _slide(padded, w, np.maximum)[: len(g)]  # over the windows that begin at p-w+1 .. p
    at = np.flatnonzero((most == g) & (g > 0))
    return at, g[at]
