"""Product codes of vectors in whole numbers, with exact nearest entries by a Walsh-Hadamard transform.

Parts and entries are padded with zeros to a power of two and transformed by additions alone. The transform
keeps distances but for its length as a factor, so squared differences are added up coefficient by coefficient,
the slow ones (few sign changes) first, and an entry ends as soon as its sum passes the best whole distance.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm.blocks import small_batches
from trialweave.operators.joins import left_join
from trialweave.session import cut_lineage

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Coefficients that every entry is compared on, then those added between two eliminations.
LEAD, STEP = 8, 8
#: Rows times entries whose sums are held at once.
CELLS = 1 << 20


def kept_vectors(df: DataFrame, vector: str) -> Column:
    """The vector is there and all its components are finite numbers."""
    c = F.col(vector)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    return c.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _most(size: int) -> float:
    """Components below this keep all sums of squares of transformed differences within 64 bits."""
    return 2.0**29 / max(size, 1) ** 1.5


def whole(column: pa.Array, size: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of every component, rows padded with zeros to ``size``.

    64-bit numbers, or Python's own where a sum of squares of this batch could pass 64 bits.
    """
    rows = np.zeros((len(column), size))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    rows[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    if not rows.size or np.abs(rows).max() * scale < _most(size):
        return np.floor(rows * scale).astype(np.int64)
    # scaling by a power of two is exact; a number this large is whole already
    exact = [[math.floor(x * scale) if abs(x) < 2.0**60 else int(x) * scale for x in r] for r in rows.tolist()]
    return np.array(exact, dtype=object).reshape(rows.shape)


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, zero-padded to a power of two, in sequency order."""
    n = 1 << max(0, x.shape[1] - 1).bit_length()
    out = np.zeros((len(x), n), dtype=x.dtype)
    out[:, : x.shape[1]] = x
    h = 1
    while h < n:
        pairs = out.reshape(len(x), n // (2 * h), 2, h)
        a, b = pairs[:, :, 0].copy(), pairs[:, :, 1].copy()
        pairs[:, :, 0], pairs[:, :, 1] = a + b, a - b
        h *= 2
    return out[:, sequency(n)]


def sequency(n: int) -> np.ndarray:
    """Rows of the transform of length n by their number of sign changes."""
    i = np.arange(n)
    signs = np.bitwise_count(i[:, None] & i[None, :]) & 1
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(1), kind="stable")


def nearest(y: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, ties to the lower; squared distance) of each row, both sides transformed."""
    n, size = y.shape
    if size == 0 or not len(entries):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    step = max(1, CELLS // len(entries))
    if n > step:
        parts = [nearest(y[i : i + step], entries) for i in range(0, n, step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    if y.dtype == entries.dtype == np.int64 and size * (int(np.abs(y).max()) + int(np.abs(entries).max())) ** 2 < 1 << 31:
        y, entries = y.astype(np.int32), entries.astype(np.int32)  # half the memory to move, as exact
    lead = min(LEAD, size)
    columns, rows = np.ascontiguousarray(entries.T), np.ascontiguousarray(y.T)
    sums = np.zeros((n, len(entries)), y.dtype if y.dtype == entries.dtype else object)
    for j in range(lead):
        off = rows[j][:, None] - columns[j][None, :]
        off *= off
        sums += off
    best = ((y - entries[sums.argmin(1)]) ** 2).sum(1)  # a whole distance that the nearest entry does not pass
    row, entry = np.nonzero(sums <= best[:, None])
    sums = sums[row, entry]
    for j in range(lead, size, STEP):
        sums = sums + ((y[row, j : j + STEP] - entries[entry, j : j + STEP]) ** 2).sum(1)
        stay = sums <= best[row]
        row, entry, sums = row[stay], entry[stay], sums[stay]
    order = np.lexsort((entry, sums, row)) if sums.dtype != object else np.array(
        sorted(range(len(row)), key=lambda k: (row[k], sums[k], entry[k])), np.int64
    )
    first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
    return entry[first], (sums[first] if sums.dtype == object else sums[first].astype(np.int64)) // size


def _limbs(total: int) -> list[int]:
    """A whole number of any size in digits to the base 2**32, the last one signed."""
    out = []
    while not -(1 << 31) <= total < 1 << 31:
        out.append(total & 0xFFFFFFFF)
        total >>= 32
    return [*out, total]


class Book:
    """The entries of all parts, as whole numbers and transformed."""

    def __init__(self, entries: list[np.ndarray]) -> None:
        self.entries = entries  # per part: entries x components
        self.ready = [transform(e) for e in entries]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row and part."""
        width = self.entries[0].shape[1]
        found = [nearest(transform(x[:, p * width : (p + 1) * width]), e) for p, e in enumerate(self.ready)]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def digest(self) -> str:
        text = ",".join(str(v) for e in self.entries for r in e.tolist() for v in r)
        return hashlib.sha256(text.encode()).hexdigest()


def _start(kept: DataFrame, size: int, parts: int, entries: int) -> Book:
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    x = whole(pa.array([list(r.vector) for r in first], pa.list_(pa.float64())), size)
    width = size // parts
    return Book([x[:, p * width : (p + 1) * width] for p in range(parts)])


def _moved(kept: DataFrame, book: Book, size: int) -> Book:
    """The entries at the mean of their parts, rounded down. Sums per entry are made in each task, then added up."""
    parts, width = len(book.entries), book.entries[0].shape[1]

    def task(batches) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(e.shape, dtype=object) for e in book.entries]
        counts = [np.zeros(len(e), np.int64) for e in book.entries]
        for batch in batches:
            x = whole(batch.column(0), size)
            code, _ = book.assign(x)
            for p in range(parts):
                part = np.zeros(sums[p].shape, dtype=x.dtype)
                np.add.at(part, code[:, p], x[:, p * width : (p + 1) * width])
                sums[p] += part
                counts[p] += np.bincount(code[:, p], minlength=len(counts[p]))
        rows = [
            (p, e, j, limb, digit, int(counts[p][e]))
            for p in range(parts)
            for e in np.flatnonzero(counts[p]).tolist()
            for j in range(width)
            for limb, digit in enumerate(_limbs(int(sums[p][e, j])))
        ]
        names = ["part", "entry", "place", "limb", "digit", "n"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names)

    made = kept.select("vector").mapInArrow(task, "part long, entry long, place long, limb long, digit long, n long")
    total = made.groupBy("part", "entry", "place", "limb").agg(F.sum("digit").alias("digit"), F.sum("n").alias("n"))
    sums: dict[tuple, int] = {}
    counts: dict[tuple, int] = {}
    for r in total.collect():  # a few rows per component of an entry
        at = (r.part, r.entry, r.place)
        sums[at] = sums.get(at, 0) + (r.digit << (32 * r.limb))
        if r.limb == 0:
            counts[at] = r.n
    moved = [e.astype(object) for e in book.entries]
    for (p, e, j), total in sums.items():
        moved[p][e, j] = total // counts[p, e, j]
    small = all(abs(v) < _most(size) for m in moved for v in m.ravel().tolist())
    return Book([m.astype(np.int64) if small else m for m in moved])


def compress(
    df: DataFrame,
    vector: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row of ``df(vec_id, vector, label)`` that is kept.

    Rows whose vector is missing or holds missing or non-finite components are dropped; repeated rows stay, and of
    rows with one id the smaller vector comes first. A missing id comes after all others. Vectors shorter than the
    longest one, or whose length is no multiple of ``parts``, count as filled up with zeros. With fewer rows than
    ``entries`` the codebooks are as short; an empty table gives an empty result. All sums are exact at any size of
    the components; an error that passes 64 bits is null. Rows without a label are one group. Other columns are
    ignored.
    """
    rows = small_batches(df).select("vec_id", F.col(vector).alias("vector"), "label")
    kept = cut_lineage(rows.where(kept_vectors(rows, "vector")), "vectors")
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    size = -(-longest // parts) * parts
    book = _start(kept, size, parts, entries)
    for _ in range(rounds):
        book = _moved(kept, book, size)
    digits = len(f"{max(entries - 1, 1):x}")
    form = f"%0{digits + digits % 2}x"

    def task(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = book.assign(whole(batch.column(2), size))
            sums = [sum(map(int, r)) for r in error.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(["".join(form % c for c in r) for r in code.tolist()], pa.string()),
                    pa.array([s if s < 1 << 63 else None for s in sums], pa.int64()),
                ],
                ["vec_id", "label", "code", "error"],
            )

    kinds = dict(kept.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    coded = cut_lineage(kept.select("vec_id", "label", "vector").mapInArrow(task, schema), "codes")
    total = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long"))
    labels = coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    out = left_join(coded, labels, "label", "_label")
    return out.select("vec_id", "code", "error", "label_error", F.lit(book.digest()).alias("codebooks_sha256"))
