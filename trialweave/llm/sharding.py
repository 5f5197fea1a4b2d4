"""Sharding by sampled splitters: near equal bytes per shard, groups of equal texts together.

Rows are ordered by the hash of their text. A size-weighted sample of that order gives quantile
boundaries of many small ranges; ranges that turn out overfull are sampled again and subdivided. The
exact bytes and rows of each range are counted, so every row's place in the whole order is known from its
place in its range. The shard is the part of the total bytes that the middle of the row's group falls in.

A group of equal texts stays whole unless it is larger than a set part of a shard; then its rows are
placed one by one, in order of their ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.session import cut_lineage

SHARDS = 16
#: Ranges per shard, expected sample rows per range, and how far above the mean a range counts as overfull.
RANGES_PER_SHARD, SAMPLES_PER_RANGE, OVERFULL = 64, 8, 4
#: Groups above this part of a shard's bytes are split; there are at most shards / part of them.
SPLIT_PART = 1 / 64
ROUNDS = 8

_FIRST = -(1 << 63)


def _placed(rows: DataFrame, points: list[tuple[int, int]]) -> DataFrame:
    """``rows`` with ``range``: how many splitters (h, k) are at or below the row's."""
    heads = np.array([p[0] for p in points], dtype=np.int64)
    keys = np.array([p[1] for p in points], dtype=np.int64)

    @F.pandas_udf("int")
    def place(h: pd.Series, k: pd.Series) -> pd.Series:
        x, y = h.to_numpy(), k.to_numpy()
        low, high = np.searchsorted(heads, x, "left"), np.searchsorted(heads, x, "right")
        out = low.copy()
        # rows of a text that is itself a splitter, perhaps of several: decided by the second key
        inside = np.flatnonzero(high > low)
        for a in np.unique(low[inside]):
            own = inside[low[inside] == a]
            out[own] = a + np.searchsorted(keys[a : high[own[0]]], y[own], "right")
        return pd.Series(out.astype(np.int32))

    return rows.withColumn("range", place("h", "k"))


def _sample(rows: DataFrame, wanted: int, total: int, seed: int) -> list[tuple[int, int, float]]:
    """About ``wanted`` keys (h, k, weight), drawn in proportion to size by a hash of the key."""
    share = F.least(F.lit(1.0), F.col("size") * (wanted / max(total, 1)))
    draw = F.pmod(F.xxhash64("h", "k", "salt", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    drawn = rows.where(draw < share).select("h", "k", (F.col("size") / share).alias("w"))
    return sorted((r[0], r[1], r[2]) for r in drawn.collect())


def _quantiles(drawn: list[tuple[int, int, float]], parts: int) -> list[tuple[int, int]]:
    """Keys that cut the sample into parts of equal weight."""
    weight = np.cumsum([w for _, _, w in drawn])
    if not len(weight):
        return []
    at = np.searchsorted(weight, weight[-1] * np.arange(1, parts) / parts)
    return sorted({drawn[i][:2] for i in at.tolist()})


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of ``docs``.

    The law is ``bytes``; ``size`` is the text's UTF-8 bytes plus 1 and a missing text counts as an empty
    one. Slots number the rows of a shard without gaps, in the order of text hash, then id. Rows that
    repeat id and text get slots of their own, rows without id come before others of their text. An
    empty table gives no rows; fewer groups than shards may leave shards empty. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.monotonically_increasing_id().alias("salt"),  # written once, so a row keeps it
    )
    rows = cut_lineage(rows, "sizes")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    split = total / shards * SPLIT_PART
    large = rows.groupBy("h").agg(F.sum("size").alias("group"), F.count("*").alias("m"))
    large = large.where((F.col("group") > split) & (F.col("m") > 1)).select("h", F.lit(True).alias("large"))
    # at most shards / SPLIT_PART rows, known to Spark as a small table, so that no text's rows meet in one task
    rows = rows.join(cut_lineage(large, "large"), "h", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    rows = cut_lineage(
        rows.withColumn("k", F.when(F.col("large"), F.coalesce("doc_id", F.lit(_FIRST))).otherwise(F.lit(0))), "keyed"
    )

    parts = shards * RANGES_PER_SHARD
    points = _quantiles(_sample(rows, parts * SAMPLES_PER_RANGE, total, 0), parts)
    for seed in range(1, ROUNDS + 1):
        ranged = _placed(rows, points)
        found = ranged.groupBy("range").agg(
            F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.max(F.struct("h", "k")) .alias("hi"), F.min(F.struct("h", "k")).alias("lo")
        ).collect()
        over = {r["range"]: r["bytes"] for r in found if r["bytes"] > OVERFULL * total / parts and r["hi"] != r["lo"]}
        if not over:
            break
        inside = ranged.where(F.col("range").isin(list(over)))
        size = sum(over.values())
        more = _quantiles(_sample(inside, parts * SAMPLES_PER_RANGE, size, seed), max(2, round(2 * parts * size / total)))
        grown = sorted({*points, *more})
        if grown == points:  # what is left cannot be cut by its keys
            break
        points = grown
    bytes_before, rows_before, b, n = {}, {}, 0, 0
    for r in sorted(found, key=lambda r: r["range"]) if count else []:
        bytes_before[r["range"]], rows_before[r["range"]] = b, n
        b, n = b + r["bytes"], n + r["rows"]

    spark = docs.sparkSession
    before = spark.createDataFrame(
        [(k, bytes_before[k], rows_before[k]) for k in bytes_before], "range int, bytes_before long, rows_before long"
    )
    order = ["h", "k", "doc_id", "salt"]
    run = Window.partitionBy("range").orderBy(*order)
    group = Window.partitionBy("range", "h", "k")
    placed = _placed(rows, points).select(
        "range", "doc_id", "size", "text_crc32", "large", "h", "k",
        F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, -1)).alias("ahead"),
        F.row_number().over(run).alias("nth"),
    )
    # a whole group stands where its first row stands
    placed = placed.select(
        "*", F.min(F.coalesce("ahead", F.lit(0))).over(group).alias("start"), F.sum("size").over(group).alias("whole")
    )
    placed = placed.join(before, "range")
    own = F.coalesce("ahead", F.lit(0)) + F.col("size") / 2
    middle = F.col("bytes_before") + F.when(F.col("large"), own).otherwise(F.col("start") + F.col("whole") / 2)
    placed = placed.select(
        "doc_id", "size", "text_crc32",
        F.least(F.floor(middle * shards / max(total, 1)), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("nth") - 1).alias("place"),
    )
    placed = cut_lineage(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(first, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
