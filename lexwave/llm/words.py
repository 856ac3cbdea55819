"""Vectorised words and rolling word k-gram hashes over Arrow string columns.

Words of a whole column are found and hashed with a few numpy passes over its
UTF-8 bytes; no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once, which bounds a worker's memory; one longer text is handled alone.
BLOCK = 1 << 20
_M = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_Q = np.uint64(0xC2B2AE3D27D4EB4F | 1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of 0-9, a-z (after lower-casing A-Z) and all bytes from 0x80.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[65:91] = IS_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))[LOWER]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the two bases; those up to a block's length are kept."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    out = []
    for base in (_P, _PINV):
        x = np.full(max(n, BLOCK + 1), base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    if len(out[0]) == BLOCK + 1:
        _powers[:] = out
    return out[0], out[1]


def release() -> None:
    """Gives freed memory back to the system: a worker lives for many tasks, beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n or column.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most limit bytes each (or of one text)."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b


class Words:
    """Words of some texts: byte spans, 64-bit hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        off = off - off[0]
        n = len(data)
        self.data, self.off = data, off
        if not n:
            self.starts = self.ends = np.empty(0, np.int64)
            self.hashes = np.empty(0, np.uint64)
            self.at = np.zeros(len(off), np.int64)
            return
        inside = IS_WORD[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.empty(n, bool)
        before[0], before[1:] = False, inside[:-1]
        before &= ~edge[:n]
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, inside[1:]
        after &= ~edge[1:]
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        up, down = _pow(n)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[data] * up[:n], out=total[1:])
        self.hashes = mix((total[self.ends] - total[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))
        self.at = np.searchsorted(self.starts, off).astype(np.int64)

    def text(self, i: int, k: int) -> str:
        """Words i to i+k-1, lower-cased, one blank between them."""
        return b" ".join(LOWER[self.data[a:b]].tobytes() for a, b in zip(self.starts[i : i + k], self.ends[i : i + k], strict=True)).decode("utf8", "replace")

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-grams by position of their first word; ok: whether the k-gram stays in its text."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        out = self.hashes[:n].copy()
        for j in range(1, k):
            out = out * _Q + self.hashes[j : j + n]
        ok = np.ones(len(self.hashes), bool)
        for j in range(1, k):
            cut = self.at[1:] - j
            ok[cut[(cut >= 0) & (cut >= self.at[:-1])]] = False
        return mix(out), ok[:n]

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, offsets by text) of k-grams; a text of 1 to k-1 words has one shingle of all its words."""
        h, ok = self.grams(k)
        count = np.diff(self.at)
        short = np.flatnonzero((count > 0) & (count < k))
        size = np.maximum(count - k + 1, 0)
        size[short] = 1
        at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        out = np.empty(at[-1], np.uint64)
        full = np.ones(at[-1], bool)
        full[at[short]] = False
        out[full] = h[ok]
        for i in short:
            x = np.uint64(count[i])
            with np.errstate(over="ignore"):
                for w in self.hashes[self.at[i] : self.at[i + 1]]:
                    x = x * _Q + w
            out[at[i]] = mix(np.array([x], np.uint64))[0]
        return out, at


def each(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, Words]]:
    """Blocks of a batch's texts: first and last row, and their words."""
    data, off = utf8(batch.column(column))
    for a, b in blocks(off):
        yield a, b, Words(data[off[a] : off[b]], off[a : b + 1])
        release()
