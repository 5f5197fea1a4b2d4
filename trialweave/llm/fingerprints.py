"""Document fingerprints by MinHash.

256 universal hash functions over the distinct five-word shingles of a text, taken in NumPy, give 256
samples; the lowest eight bits of each make the fingerprint. The share of equal bytes, less what chance
gives, estimates the Jaccard similarity.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm import blocks
from trialweave.llm.near_dedup import confirm
from trialweave.session import cut_lineage

SAMPLES, SEED = 256, 40_009
BANDS, ROWS = 32, 4
#: Rows of a range of ids, and most ranges.
RANGE_ROWS, MOST_RANGES = 5_000, 10_000

_FIRST = -(1 << 63)


def samples(column: pa.Array) -> np.ndarray:
    """MinHash samples of each text; texts without words have the largest value everywhere."""
    a, b = blocks.multipliers(SEED, SAMPLES)
    values, edges = blocks.shingle_sets(column)
    return blocks.minhashes(values, edges, a, b)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity of fingerprints, row by row: 1 for equal ones, 0 for unrelated ones."""
    equal = (x == y).mean(axis=1)
    return np.clip((equal - 1 / 256) / (1 - 1 / 256), 0.0, 1.0)


def _short(found: np.ndarray) -> np.ndarray:
    return (found & np.uint64(255)).astype(np.uint8)


def _edited(text: str, after: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, borrowed, doc_id, text) in order: each own row is compared with the row behind it."""
    last = None  # (range, borrowed, doc_id, text, fingerprint)
    for batch in batches:
        for lo, hi in blocks.slices(batch.column(3)):
            part = batch.slice(lo, hi - lo)
            texts = [t or "" for t in part.column(3).to_pylist()]
            prints = _short(samples(part.column(3)))
            rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), texts, prints))
            if last is not None:
                rows.insert(0, last)
            last = rows.pop()
            after = [*rows[1:], last]
            own = [(x, y) for x, y in zip(rows, after) if not x[1]]
            if not own:
                continue
            edited = [_edited(x[3], y[3]) for x, y in own]
            changed = np.empty((len(own), SAMPLES), dtype=np.uint8)
            column = pa.array(edited, pa.large_string())
            for a, b in blocks.slices(column):
                changed[a:b] = _short(samples(column.slice(a, b - a)))
            was = np.stack([x[4] for x, _ in own])
            behind = np.stack([y[4] for _, y in own])
            text = lambda m: pa.array([base64.b64encode(r).decode() for r in m], pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[2] for x, _ in own], pa.int64()),
                    pa.array([len(x[3]) for x, _ in own], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    text(was),
                    text(changed),
                    pa.array(likeness(was, changed)),
                    pa.array(likeness(was, behind)),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def _ranges(keys: DataFrame) -> np.ndarray:
    """Cut points of the column ``k``, by approximate quantiles."""
    count = keys.count()
    ranges = int(min(max(-(-count // RANGE_ROWS), 1), MOST_RANGES))
    if ranges == 1:
        return np.zeros(0)
    return np.array(sorted(set(keys.approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.2 / ranges))))


def _placed(rows: DataFrame, points: np.ndarray) -> DataFrame:
    """``rows`` with a first column ``range``, the place of ``k`` among the cut points."""

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, k.to_numpy().astype(float), side="right").astype(np.int32))

    return rows.select(place("k").alias("range"), "*")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; one row per row of ``docs``.

    The edited text replaces the last quarter of a text's code points by the first as many of the next
    document in ascending id (then text); the last one takes the first. Missing texts are empty, rows
    without id come first. Texts without words are alike among themselves (1) and unlike others.

    Ids are cut into ranges by approximate quantiles; rows move once, to their range, and stream through
    a task in order. Each range borrows the first row of the next one.
    """
    base = blocks.small_batches(docs).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("k"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    points = _ranges(base.select("k"))
    firsts = _placed(base.select("k"), points).groupBy("range").agg(F.min("k")).collect()
    firsts = sorted((r[0], r[1]) for r in firsts)
    spark = docs.sparkSession
    # the first row of a range also closes the range before it, that of the first range the last one
    closing = [(firsts[i - 1][0], k) for i, (_, k) in enumerate(firsts)]
    closes = spark.createDataFrame(closing, "closes int, at long")
    # one row per range, at most MOST_RANGES: small whatever the size of the table
    heads = base.join(F.broadcast(closes), base.k == closes["at"]).groupBy("closes").agg(F.min(F.struct("k", "text")).alias("h"))
    heads = heads.select(
        F.col("closes").alias("range"), F.lit(1).alias("borrowed"), F.lit(None).cast("long").alias("doc_id"),
        F.col("h.text").alias("text"), F.col("h.k").alias("k"),
    )
    rows = _placed(base, points).select("range", F.lit(0).alias("borrowed"), "doc_id", "text", "k").unionByName(heads)
    rows = rows.repartition(len(points) + 1, "range").sortWithinPartitions("range", "borrowed", "k", "text").drop("k")
    return rows.mapInArrow(
        _compare,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in blocks.slices(batch.column(1)):
            found = samples(batch.column(1).slice(lo, hi - lo))
            used = found[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
            keys = np.zeros(used.shape[:2], dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for r in range(ROWS):
                keys = blocks.mix(keys * np.uint64(0xFF51AFD7ED558CCD) + used[:, :, r])
            some = np.flatnonzero((found != np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch.column(0).slice(lo, hi - lo).to_numpy()[some], BANDS)),
                    pa.array(keys[some].astype(np.int64).ravel()),
                ],
                names=["doc_id", "bucket"],
            )


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_cent: int = 75) -> DataFrame:
    """(a, b): texts that share a signature band with its smallest text and whose full sets are similar enough.

    Bands of four samples are joined on their hash; each bucket pairs its members with one centre, never
    with each other, and every pair is checked on full shingle sets. Rows without id or words are left out.
    """
    base = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    base = base.dropDuplicates(["doc_id"])
    members = cut_lineage(base.mapInArrow(_bands, "doc_id long, bucket long"), "bands")
    centres = members.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.count("*").alias("m")).where("m > 1")
    pairs = members.join(centres, "bucket").where("doc_id != a").select("a", F.col("doc_id").alias("b")).distinct()
    return confirm(cut_lineage(pairs, "pairs"), base, per_cent)
