"""Words and shingles of Arrow string columns, in NumPy, a bounded number of bytes at a time.

A text is its UTF-8 bytes. Words are runs of bytes other than space and 0x09-0x0D; A-Z count as a-z.
A missing text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes and rows of text that are hashed at once; a longer text makes a block of its own.
BLOCK_BYTES, BLOCK_ROWS = 1 << 19, 2000
WIDTH = 5

#: Bytes of an Arrow batch on its way to a Python task and back.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering the session's Arrow batches to 8 MB, on which a Python task's memory depends."""
    conf = df.sparkSession.conf
    now = str(conf.get(_BATCH))
    if not (now.rstrip("b").isdigit() and 0 < int(now.rstrip("b")) <= BATCH_BYTES):
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def multipliers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n pairs (odd factor, shift) of 64-bit universal hash functions, fixed by the seed."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, n, dtype=np.uint64)


def _table(which: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        x = np.full(max(n, BLOCK_BYTES + 1), base, dtype=np.uint64)
        x[0] = 1
        have = np.multiply.accumulate(x)
        if len(have) <= 2 * BLOCK_BYTES:  # a table for one giant text is not kept
            _powers[which] = have
    return have


@dataclass
class Words:
    """Words of a block of texts: hashes, and for each text the first and last + 1 of its words."""

    hashes: np.ndarray
    first: np.ndarray
    last: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start of each text, end of each text); missing texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    start, end = offsets[:-1].copy(), offsets[1:].copy()
    if column.null_count:
        missing = column.is_null().to_numpy(zero_copy_only=False)
        end[missing] = start[missing]
    return data, start, end


def slices(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about ``most`` bytes of text each, one row at least and 2,000 at most."""
    _, start, end = buffers(column)
    if not len(start):
        return
    piece = np.cumsum(end - start) // most
    cuts = np.flatnonzero((np.diff(piece) > 0) | (np.arange(1, len(piece)) % BLOCK_ROWS == 0)) + 1
    edges = [0, *cuts.tolist(), len(start)]
    yield from zip(edges[:-1], edges[1:])


def words(column: pa.Array, lower: bool = True) -> Words:
    """Hashes of all words of the texts in ``column`` (one block)."""
    data, start, end = buffers(column)
    n = len(start)
    if n == 0 or not (end > start).any():
        z = np.zeros(n, np.int64)
        e = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), z, z.copy(), e, e)
    low = int(start.min())
    data = data[low : int(end.max())]
    start, end = start - low, end - low
    space = _SPACE[data]
    # a word starts at a byte that is no space after a space or at the start of a text
    before = np.empty(len(data), dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    filled = end > start
    before[start[filled]] = True
    starts = np.flatnonzero(before & ~space)
    after = np.empty(len(data), dtype=bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[end[filled] - 1] = True
    ends = np.flatnonzero(after & ~space) + 1
    size = len(data) + 1
    up = _table("up", _BASE, size)
    down = _table("down", pow(_BASE, -1, 1 << 64), size)
    sums = np.zeros(size, dtype=np.uint64)
    value = (_LOWER[data] if lower else data).astype(np.uint64)
    value += np.uint64(1)
    value *= up[: len(data)]
    np.cumsum(value, out=sums[1:])
    hashes = sums[ends] - sums[starts]
    hashes *= down[starts]
    hashes ^= (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return Words(mix(hashes), np.searchsorted(starts, start), np.searchsorted(starts, end), starts, ends)


def ngram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` hashes, by its first element (windows may cross texts)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out += hashes[i : i + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """As ``ngram_hashes``, other values, in a time that does not grow with ``width``."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * _table("up", _BASE, len(hashes))[: len(hashes)], out=sums[1:])
    out = sums[width:] - sums[:n]
    out *= _table("down", pow(_BASE, -1, 1 << 64), len(hashes))[:n]
    return mix(out)


def _whole(hashes: np.ndarray) -> np.uint64:
    return ngram_hashes(hashes, len(hashes))[0]


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, edges): text i has ``[edges[i], edges[i+1])``.

    A text with fewer than ``width`` words has its whole sequence as one shingle, one without words none.
    """
    w = words(column)
    grams = ngram_hashes(w.hashes, width)
    parts, edges = [], np.zeros(len(w.first) + 1, dtype=np.int64)
    for i, (a, b) in enumerate(zip(w.first.tolist(), w.last.tolist())):
        if b - a >= width:
            got = np.sort(grams[a : b - width + 1])
            if len(got) > 1:
                keep = np.empty(len(got), dtype=bool)
                keep[0] = True
                np.not_equal(got[1:], got[:-1], out=keep[1:])
                got = got[keep]
            parts.append(got)
            edges[i + 1] = len(got)
        elif b > a:
            parts.append(np.array([_whole(w.hashes[a:b])], dtype=np.uint64))
            edges[i + 1] = 1
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(edges)


def minhashes(values: np.ndarray, edges: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash samples, one row per text and one column per hash function; empty sets get the largest value."""
    out = np.full((len(edges) - 1, len(a)), _MASK, dtype=np.uint64)
    sizes = np.diff(edges)
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return out
    # groups of texts of about 32,000 shingles stay in the processor's cache
    piece = np.cumsum(sizes[filled]) >> 15
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(filled)]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        rows = filled[lo:hi]
        x = values[edges[rows[0]] : edges[rows[-1] + 1]]
        at = edges[rows] - edges[rows[0]]
        y = np.empty_like(x)
        for k in range(len(a)):
            np.multiply(x, a[k], out=y)
            y += b[k]
            out[rows, k] = np.minimum.reduceat(y, at)
    return out


def set_keys(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A 128-bit key per set, as two columns: equal sets have equal keys."""
    out = np.zeros((len(edges) - 1, 2), dtype=np.uint64)
    rows = np.flatnonzero(np.diff(edges))
    if len(rows):
        out[rows, 0] = np.add.reduceat(mix(values.copy()), edges[rows])
        out[rows, 1] = np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), edges[rows])
    return out


def binary(rows: np.ndarray) -> pa.Array:
    """One fixed-length binary value per row of a 2-D array."""
    width = rows.shape[1] * rows.itemsize
    data = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
