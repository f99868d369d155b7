"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on the UTF-8 bytes of an Arrow batch at once: a batch is cut
into chunks of bounded size (a longer text is a chunk of its own), words are
spans found with a byte table, and word hashes come from one prefix sum.
No function loops over bytes or words in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; only a single longer text makes a larger chunk.
CHUNK_BYTES = 1 << 20

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93
_STEP_INV = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        with np.errstate(over="ignore"):
            out[1:] = np.uint64(base)
            np.multiply.accumulate(out, out=out)
    return out


class _Powers:
    """base**i modulo 2**64 for all i below a length that grows when asked."""

    def __init__(self, base: int) -> None:
        self.base, self.table = base, _powers(base, 1 << 12)

    def __call__(self, n: int) -> np.ndarray:
        if n > len(self.table):
            self.table = _powers(self.base, max(n, 2 * len(self.table)))
        return self.table[:n]


_P, _PI = _Powers(_BASE), _Powers(_BASE_INV)
_Q, _QI = _Powers(_STEP), _Powers(_STEP_INV)

#: A random 64-bit value for each byte.
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words parted by ASCII white space only.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of words of ASCII letters, digits and all other characters beyond ASCII.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[48:58] = ALNUM_WORDS[65:91] = ALNUM_WORDS[97:123] = ALNUM_WORDS[128:] = True


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (null: empty) and its offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if binary else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def _trimmer():
    """What returns freed memory to the system; nothing where the C library can't."""
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda: None
    return lambda: trim(0)


_trim = _trimmer()


def release() -> None:
    """Gives back what the arrays of a batch took: a worker that waits for its next task holds none of it."""
    pa.default_memory_pool().release_unused()
    _trim()


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch with the bytes and offsets of their texts."""
    if not batch.num_rows:
        return
    buf, at = byte_view(batch.column(batch.schema.get_field_index(text)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, batch.num_rows)
        yield batch.slice(i, j - i), buf[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
    release()


def words(buf: np.ndarray, at: np.ndarray, table: np.ndarray = SPACE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = table[buf]
    first = at[:-1][at[:-1] < n]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[first] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[first[first > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    n = len(buf)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _P(n), out=total[1:])
    out = total[ends]
    out -= total[starts]
    out *= _PI(n + 1)[starts]
    return mix(out)


class Spans:
    """Hashes of many, also overlapping, spans of the same bytes, equal to those of span_hashes."""

    def __init__(self, buf: np.ndarray) -> None:
        self.total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * _P(len(buf)), out=self.total[1:])
        self.inverse = _PI(len(buf) + 1)

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Without the finaliser."""
        out = self.total[ends]
        out -= self.total[starts]
        out *= self.inverse[starts]
        return out

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive values, also of those that reach into the next text."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    if n <= 8:
        out = hashes[:m].copy()
        for k in range(1, n):
            out *= np.uint64(_STEP)
            out += hashes[k : k + m]
    else:
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * _Q(len(hashes)), out=total[1:])
        out = (total[n:] - total[:m]) * _QI(m)
    return mix(out + np.uint64(n))


def inside_texts(first: np.ndarray, n: int, m: int) -> np.ndarray:
    """Which of m runs of n words lie in one text; first: index of each text's first word, one more at the end."""
    ok = np.zeros(max(m, 0), bool)
    if m > 0:
        change = np.zeros(m + 1, np.int64)
        a = np.minimum(first[:-1], m)
        b = np.minimum(np.maximum(first[1:] - n + 1, first[:-1]), m)
        np.add.at(change, a, 1)
        np.add.at(change, b, -1)
        ok = np.cumsum(change[:-1]) > 0
    return ok


def minimizers(grams: np.ndarray, ok: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the least of grams[i : i + width], the rightmost of equals; only where ok[i] is the answer of use.

    Doubling: after a step the array holds the place of the least of 2**k grams.
    """
    m = len(grams)
    best = np.arange(m)
    span = 1

    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(grams[b] <= grams[a], b, a)

    while 2 * span <= width:
        if m - span > 0:
            best[: m - span] = least(best[: m - span], best[span:])
        span *= 2
    rest = width - span
    if rest and m - rest > 0:
        best = best.copy()
        best[: m - rest] = least(best[: m - rest], best[rest:].copy())
    return best


def owner(first: np.ndarray, n: int) -> np.ndarray:
    """The text of each of n words."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the spans."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0
