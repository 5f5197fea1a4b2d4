"""Sums that a regression with cluster intercepts needs, as blocks made by NumPy in Arrow batches.

Cross products are needed in total per group, the rest (size, sum of the design, sum of the outcomes) per
cluster, and of clusters only per cluster size. One pass over the rows gives both; blocks are added up where they
arise, then in two steps across tasks. Any number of columns costs one matrix product per batch, and any number of
outcomes shares the design: rows are never copied per outcome.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a batch that meet all outcomes at once; groups and sizes whose sums a task holds before it hands them on.
BLOCK_ROWS, HELD = 2_000, 256
#: Tasks that add up a group's cross products before one does.
SALTS = 64


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def triangle(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (j, k), j <= k, of a symmetric matrix, row by row."""
    return np.triu_indices(width)


def codes(columns: Sequence[pa.Array]) -> np.ndarray:
    """Whole numbers that are equal where all columns are; a missing value equals a missing value."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        code = c.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        out = out * (code.max(initial=0) + 1) + code
    return out


def _merge(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Adds up ``count`` and ``v`` of rows that agree in the first ``keys`` columns and follow each other."""
    now, count, total = None, 0, None
    done: list[tuple] = []
    for batch in batches:
        names, types = batch.schema.names, [batch.schema.field(i).type for i in range(keys)]
        columns = [batch.column(i).to_pylist() for i in range(keys + 1)]
        for row in zip(*columns, batch.column(keys + 1)):
            v = np.frombuffer(row[-1].as_buffer())
            if row[:keys] == now:
                count, total = count + row[keys], total + v
            else:
                if total is not None:
                    done.append((*now, count, total.tobytes()))
                now, count, total = row[:keys], row[keys], v
        if len(done) >= HELD:
            yield _rows(done, names, types)
            done = []
    if total is not None:
        yield _rows([*done, (*now, count, total.tobytes())], names, types)


def _rows(rows: list[tuple], names: Sequence[str], types: Sequence[pa.DataType]) -> pa.RecordBatch:
    kinds = [*types, pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], list(names))


def _ddl(df: DataFrame, columns: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{c}` {kinds[c]}, " for c in columns)


def _added(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df(keys..., count, v)`` with one row per key."""
    sorted_rows = df.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_rows.mapInArrow(lambda b: _merge(b, len(keys)), _ddl(df, keys) + "count long, v binary")


def cluster_blocks(
    rows: DataFrame, keys: Sequence[str], width: int, ndraws: int, outcomes: Callable[[pa.RecordBatch], np.ndarray]
) -> DataFrame:
    """(keys..., cluster, salt, count, v) from ``rows(keys..., cluster, x, rest...)``.

    A cluster's row has its size and v = sums of the ``width`` design columns and of each outcome. A row without
    cluster has a share of the group's total: v = cross products of the design, then per outcome its square and
    its products with the design. ``outcomes`` gives the outcomes of a batch, rows x ndraws.
    """
    keys = list(keys)
    k = len(keys)
    up, down = triangle(width)

    def task(batches) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        names = [*keys, "cluster", "salt", "count", "v"]

        def flush(types: list[pa.DataType]) -> pa.RecordBatch:
            made = [(*g, None, zlib.crc32(v.tobytes()) % SALTS, 0, v.tobytes()) for g, v in totals.items()]
            totals.clear()
            return _rows(made, names, types)

        types: list[pa.DataType] = []
        for whole in batches:
            types = [*(whole.schema.field(i).type for i in range(k + 1)), pa.int32()]
            for low in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(low, BLOCK_ROWS)
                code = codes(batch.columns[: k + 1])
                order = np.argsort(code, kind="stable")
                starts = np.flatnonzero(np.diff(code[order], prepend=-1))
                x, y = matrix(batch.column(k + 1), width)[order], outcomes(batch)[order]
                n = np.diff(np.append(starts, len(order)))
                sums = np.concatenate([np.add.reduceat(x, starts), np.add.reduceat(y, starts)], 1)
                first = pa.array(order[starts])
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.take(first) for c in batch.columns[: k + 1]],
                        pa.array(np.zeros(len(starts), np.int32)),
                        pa.array(n.astype(np.int64)),
                        pa.array([r.tobytes() for r in sums], pa.binary()),
                    ],
                    names,
                )
                group = codes(batch.columns[:k])[order] if k else np.zeros(len(order), np.int64)
                for g in np.unique(group):
                    at = np.flatnonzero(group == g)
                    xg, yg = x[at], y[at]
                    own = np.concatenate([(yg * yg).sum(0)[:, None], yg.T @ xg], 1)
                    v = np.concatenate([(xg.T @ xg)[up, down], own.ravel()])
                    label = tuple(c[int(order[at[0]])].as_py() for c in batch.columns[:k])
                    totals[label] = totals[label] + v if label in totals else v
                if len(totals) >= HELD:
                    yield flush(types)
        if totals:
            yield flush(types)

    schema = _ddl(rows, [*keys, "cluster"]) + "salt int, count long, v binary"
    return rows.mapInArrow(task, schema)


def merged_clusters(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per cluster, and at most ``SALTS`` per group's total."""
    return _added(blocks, [*keys, "cluster", "salt"])


def size_blocks(
    clusters: DataFrame,
    keys: Sequence[str],
    width: int,
    ndraws: int,
    spread: Sequence[str | Column] | None = None,
    by: Sequence[str] | None = None,
) -> DataFrame:
    """(by..., outcome_no, n, n_clusters, v): sums over clusters of one size, per outcome 1, 2, ...

    For n > 0, v = sums of the clusters' design sums s, of s x s, of the outcome's sum t, of t x t and of t x s.
    The row n = 0 holds what is needed in total: cross products of the design, the outcome's square and its
    products with the design. ``spread`` are columns ``by`` that take the place of the keys, such as an exploded
    list of the groups that a row counts in.
    """
    keys = list(keys)
    k = len(keys)
    up, down = triangle(width)

    def sizes(batches) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        names, types = [*keys, "n", "count", "v"], []

        def flush() -> pa.RecordBatch:
            made = [(*g, c, v.tobytes()) for g, (c, v) in held.items()]
            held.clear()
            return _rows(made, names, types)

        for batch in batches:
            types = [*(batch.schema.field(i).type for i in range(k)), pa.int64()]
            lead = list(zip(*(batch.column(i).to_pylist() for i in range(k)))) if k else [()] * batch.num_rows
            for g, cluster, n, raw in zip(lead, batch.column(k), batch.column(k + 2).to_pylist(), batch.column(k + 3)):
                v = np.frombuffer(raw.as_buffer())
                if not cluster.is_valid:
                    at, one = (*g, 0), 0
                else:
                    s, t = v[:width], v[width:, None]
                    own = np.concatenate([t, t * t, t * s], 1)
                    at, one, v = (*g, n), 1, np.concatenate([s, s[up] * s[down], own.ravel()])
                if at in held:
                    held[at][0] += one
                    held[at][1] = held[at][1] + v
                else:
                    held[at] = [one, v]
            if len(held) >= HELD:
                yield flush()
        if held:
            yield flush()

    made = clusters.mapInArrow(sizes, _ddl(clusters, keys) + "n long, count long, v binary")
    if spread is not None:
        made, keys = made.select(*spread, "n", "count", "v"), list(by or ())
    added = _added(made, [*keys, "n"])
    head = len(up)

    def each(batches) -> Iterator[pa.RecordBatch]:
        """One row per outcome."""
        c = len(keys)
        for batch in batches:
            for low in range(batch.num_rows):
                n, v = batch.column(c)[low].as_py(), np.frombuffer(batch.column(c + 2)[low].as_buffer())
                common = head + (width if n else 0)
                rows = np.concatenate([np.tile(v[:common], (ndraws, 1)), v[common:].reshape(ndraws, -1)], 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array([batch.column(i)[low].as_py()] * ndraws, batch.column(i).type) for i in range(c)],
                        pa.array(np.arange(1, ndraws + 1, dtype=np.int32)),
                        pa.array([n] * ndraws, pa.int64()),
                        pa.array([batch.column(c + 1)[low].as_py()] * ndraws, pa.int64()),
                        lists(rows),
                    ],
                    [*keys, "outcome_no", "n", "n_clusters", "v"],
                )

    return added.mapInArrow(each, _ddl(added, keys) + "outcome_no int, n long, n_clusters long, v array<double>")


def array_of(columns: Sequence[Column]) -> Column:
    return F.array(*columns).cast(T.ArrayType(T.DoubleType()))
