"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text gives a short vector of transformed statistics (lengths, shares of character kinds, repetition,
line shape). Per class a mean and a covariance are kept; the covariance is shrunk towards the diagonal of
the pooled one. A text's score is the logistic of the difference of the two log densities, each a
Mahalanobis term through the class's Cholesky factor (factored once, on the driver, from d x d sums)
and a log determinant, plus the log odds of the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from trialweave.llm import blocks
from trialweave.session import cut_lineage

NAMES = (
    "chars", "words", "word_length", "upper", "digits", "symbols", "bangs", "bars", "sentence_ends", "other_bytes",
    "newlines", "distinct_words", "top_word", "distinct_shingles", "line_words", "short_words", "odd_endings",
)
#: Weight of the pooled diagonal in a class's covariance, and the least variance of a statistic.
SHRINK, LEAST = 0.05, 1e-2

_KIND = np.zeros((8, 256), dtype=bool)
_KIND[0, 65:91] = True
_KIND[1, 48:58] = True
_KIND[2, [*b"#$%&*@^~_<>=+/\\{}[]"]] = True
_KIND[3, [*b"!?"]] = True
_KIND[4, ord("|")] = True
_KIND[5, [*b".,;:"]] = True
_KIND[6, 128:] = True
_KIND[7, 10] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), *b".,;:"]] = True


def _share(count, of):
    """Square root of a share: spreads small shares."""
    return np.sqrt(count / np.maximum(of, 1))


def features(column: pa.Array) -> np.ndarray:
    """One row of statistics per text; a missing or empty text has zero lengths and shares."""
    data, start, end = blocks.buffers(column)
    n = len(start)
    out = np.zeros((n, len(NAMES)))
    if not n or not (end > start).any():
        return out
    low = int(start.min())
    data, start, end = data[low : int(end.max())], start - low, end - low
    size = (end - start).astype(float)
    counts = []
    for kind in _KIND:
        at = np.flatnonzero(kind[data])
        counts.append((np.searchsorted(at, end) - np.searchsorted(at, start)).astype(float))
    upper, digits, symbols, bangs, bars, ends, other, lines = counts
    w = blocks.words(column)
    n_words = (w.last - w.first).astype(float)
    length = np.concatenate([[0], np.cumsum(w.ends - w.starts)])
    short = np.concatenate([[0], np.cumsum(w.ends - w.starts <= 3)])
    odd = np.concatenate([[0], np.cumsum(~_LETTER[data[w.ends - 1]])])
    grams = blocks.ngram_hashes(w.hashes, blocks.WIDTH)
    distinct, top, shingles = np.zeros(n), np.zeros(n), np.zeros(n)
    for i, (a, b) in enumerate(zip(w.first.tolist(), w.last.tolist())):
        if b > a:
            x = np.sort(w.hashes[a:b])
            runs = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
            distinct[i] = len(runs) - 1
            top[i] = np.diff(runs).max()
            if b - a >= blocks.WIDTH:
                x = np.sort(grams[a : b - blocks.WIDTH + 1])
                shingles[i] = 1 - (1 + np.count_nonzero(x[1:] != x[:-1])) / len(x)
    out[:, 0] = np.log1p(size)
    out[:, 1] = np.log1p(n_words)
    out[:, 2] = np.log1p((length[w.last] - length[w.first]) / np.maximum(n_words, 1))
    for k, c in enumerate((upper, digits, symbols, bangs, bars, ends, other), start=3):
        out[:, k] = _share(c, size)
    out[:, 10] = np.log1p(lines / np.maximum(size, 1) * 100)
    out[:, 11] = np.log1p(distinct) / np.log1p(np.maximum(n_words, 1))
    out[:, 12] = _share(top, n_words)
    out[:, 13] = np.sqrt(shingles)
    out[:, 14] = np.log1p(n_words / (lines + 1))
    out[:, 15] = _share(short[w.last] - short[w.first], n_words)
    out[:, 16] = _share(odd[w.last] - odd[w.first], n_words)
    return out


def _append(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in blocks.slices(batch.column(at)):
            part = batch.slice(lo, hi - lo)
            x = features(part.column(at))
            offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
            stats = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns, stats], names=[*batch.schema.names, "statistics"])


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its columns renamed c0, c1, ... and a last column ``statistics``; nothing is shuffled."""
    at = docs.columns.index(text_col)
    plain = blocks.small_batches(docs).toDF(*[f"c{i}" for i in range(len(docs.columns))])
    kind = StructType([*plain.schema.fields, StructField("statistics", ArrayType(DoubleType()))])
    return plain.mapInArrow(partial(_append, at=at), kind)


@dataclass
class Model:
    """Per class (0, 1): mean, inverse Cholesky factor, log determinant; log odds of class 1."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_odds: float
    counts: tuple[int, int]

    def scores(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for mean, factor, det in zip(self.means, self.factors, self.log_dets):
            z = (x - mean) @ factor.T
            logs.append(-0.5 * ((z * z).sum(1) + det))
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + self.log_odds, -700, 700)))


def _sums(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, d + 1, d + 1))
    for batch in batches:
        label = batch.column(0).to_numpy()
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(label), d)
        x = np.hstack([np.ones((len(x), 1)), x])
        for c in (0, 1):
            own = x[label == c]
            total[c] += own.T @ own
    c, i, j = np.indices(total.shape).reshape(3, -1)
    yield pa.RecordBatch.from_arrays(
        [*(pa.array(k.astype(np.int32)) for k in (c, i, j)), pa.array(total.ravel())], names=["c", "i", "j", "v"]
    )


def fit(labelled: DataFrame, shrink: float = SHRINK) -> Model:
    """Fit on rows (label 0/1, statistics); other or missing labels are left out.

    All rows count: tasks reduce them to sums of d x d products, which is all the driver sees. Without
    rows of both classes the densities are equal, so that every score is the class share (with one
    row added to each class).
    """
    d = len(NAMES)
    rows = labelled.where("label in (0, 1) and statistics is not null").select(
        F.col("label").cast("int").alias("label"), "statistics"
    )
    cells = rows.mapInArrow(partial(_sums, d=d), "c int, i int, j int, v double")
    total = np.zeros((2, d + 1, d + 1))
    for c, i, j, v in cells.groupBy("c", "i", "j").agg(F.sum("v")).collect():
        total[c, i, j] = v
    n = total[:, 0, 0]
    odds = float(np.log((n[1] + 1) / (n[0] + 1)))
    means, factors, dets = np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2)
    if n.min() > 0:
        covs = []
        for c in (0, 1):
            means[c] = total[c, 0, 1:] / n[c]
            covs.append(total[c, 1:, 1:] / n[c] - np.outer(means[c], means[c]))
        pooled = np.diag((n[0] * covs[0] + n[1] * covs[1]).diagonal() / n.sum())
        for c in (0, 1):
            # few rows lean more on the pooled diagonal
            weight = max(shrink, d / (d + n[c]))
            cov = (1 - weight) * covs[c] + weight * pooled + LEAST * np.eye(d)
            low = np.linalg.cholesky(cov)
            factors[c] = np.linalg.inv(low)
            dets[c] = 2 * np.log(low.diagonal()).sum()
    return Model(means, factors, dets, odds, (int(n[0]), int(n[1])))


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    d = len(NAMES)
    for batch in batches:
        x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(model.scores(x))], names=[*batch.schema.names[:-1], "score"]
        )


def score(table: DataFrame, model: Model) -> DataFrame:
    """``statistics()`` rows with the last column replaced by ``score`` (0 to 1, higher: class 1 likelier)."""
    kind = StructType([*table.schema.fields[:-1], StructField("score", DoubleType())])
    return table.mapInArrow(partial(_score, model=model), kind)


def held_out(id_col) -> F.Column:
    """Whether a row is kept from the fit: crc32 of the id as text leaves 1 by 3. A missing id is."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))


def learn(table: DataFrame, labels: DataFrame, id_col: str, label_id: str, label_col: str) -> Model:
    """Fit on the rows of ``table`` (``statistics()`` rows) that ``labels`` marks and that are not held out."""
    marks = labels.where(~held_out(label_id)).select(
        F.col(label_id).cast("long").alias("mark_id"), F.col(label_col).alias("label")
    )
    known = table.select(F.col(id_col).cast("long").alias("mark_id"), "statistics")
    return fit(known.join(marks.where("label is not null").distinct(), "mark_id"))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``; only whole texts are inputs.

    Missing texts count as empty. Rows without id are scored, never learnt from, and held out. Repeated
    rows get equal scores. Labels that are missing are left out; contradicting labels of one id both count.
    """
    table = cut_lineage(statistics(docs.select(F.col(id_col).cast("long"), text_col), text_col).drop("c1"), "statistics")
    found = score(table, learn(table, labels, "c0", id_col, label_col))
    return found.select(
        F.col("c0").alias("doc_id"),
        held_out("c0").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns as they are. Texts are not shuffled."""
    names = docs.columns
    own = statistics(docs.select(F.col(id_col).cast("long"), text_col), text_col).drop("c1")
    model = learn(own, labels, "c0", id_col, "quality")
    at = names.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.mapInArrow(partial(_accept, at=at, model=model), plain.schema).toDF(*names)


def _accept(batches: Iterator[pa.RecordBatch], at: int, model: Model) -> Iterator[pa.RecordBatch]:
    """Rows whose text scores 0.5 or more; statistics and score in one pass."""
    for batch in batches:
        for lo, hi in blocks.slices(batch.column(at)):
            part = batch.slice(lo, hi - lo)
            yield part.filter(pa.array(model.scores(features(part.column(at))) >= 0.5))
