"""Draw documents that look like a target: hashed n-gram histograms of both, gains per bucket, Gumbel top-k.

A tokenizer's untrained split over the ASCII-lowered text returns words with their offsets. Offset pairs of
neighbouring words are the features; their CRC picks a bucket. Every feature of every text is counted.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from trialweave.llm.blocks import small_batches
from trialweave.operators.ranges import number_rows
from trialweave.session import cut_lineage

BUCKETS = 10_000
#: Neighbouring words of the longest feature.
MOST_WORDS = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024

#: Code points of a text that are split at once, up to the end of the word there.
PIECE = 1 << 16
#: Rows of a range of scores that one task orders, and the number of ranges from which on they hold more.
RANGE_ROWS, MOST_RANGES = 20_000, 10_000

_WORD, _BREAK = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``size`` code points that end between words."""
    at = 0
    while at < len(text):
        found = _BREAK.search(text, at + size)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def windows(words: list[str], most: int, new: int = 0) -> Iterator[bytes]:
    """The runs of 1 to ``most`` words that end at word ``new`` or later, joined by one space.

    They are slices of the joined words by pairs of a word's start and a later word's end.
    """
    line = " ".join(words).encode()
    if most == 1 and not new:
        yield from line.split(b" ") if words else ()
        return
    sizes = np.fromiter((len(w.encode()) for w in words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    for k in range(1, most + 1):
        first = max(0, new - k + 1)
        for a, b in zip(starts[first : max(0, len(words) - k + 1)].tolist(), ends[first + k - 1 :].tolist()):
            yield line[a:b]


def _kind(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def _buckets(text: str | None, split: Split, most: int, buckets: int) -> tuple[int, np.ndarray]:
    """(number of words, bucket of each feature) of a text of any length."""
    kind = _kind(buckets)
    n, before, found = 0, [], []
    for piece in pieces((text or "").encode().translate(_LOWER).decode()):
        words = [*before, *(w for w, _ in split.pre_tokenize_str(piece))]
        n += len(words) - len(before)
        found.append(np.array([zlib.crc32(f) % buckets for f in windows(words, most, len(before))], kind))
        before = words[max(0, len(words) - most + 1) :]
    return n, np.concatenate(found) if found else np.zeros(0, kind)


def bucketed(df: DataFrame, keys: list[str], most: int = MOST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(keys..., n_words, n_features, buckets): the buckets of all features of ``text``, packed."""

    def task(batches):
        split = Split(Regex(_WORD), behavior="removed", invert=True)
        for batch in batches:
            made = [_buckets(t, split, most, buckets) for t in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(len(keys))],
                    pa.array([n for n, _ in made], pa.int64()),
                    pa.array([len(b) for _, b in made], pa.int64()),
                    pa.array([b.tobytes() for _, b in made], pa.binary()),
                ],
                [*keys, "n_words", "n_features", "buckets"],
            )

    kept = small_batches(df).select(*keys, "text")
    schema = ", ".join(f"`{k}` {t}" for k, t in kept.drop("text").dtypes)
    return kept.mapInArrow(task, f"{schema + ', ' if schema else ''}n_words long, n_features long, buckets binary")


def _unpacked(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all rows, edges of the rows)."""
    kind = _kind(buckets)
    values = [np.frombuffer(v.as_buffer(), kind) for v in column]
    edges = np.cumsum([0, *map(len, values)])
    return (np.concatenate(values) if values else np.zeros(0, kind)), edges


def histogram(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket: summed in each task, then over tasks. One number per bucket reaches the driver."""

    def task(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_unpacked(batch.column(0), buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    counts = rows.select("buckets").mapInArrow(task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counts.collect():  # one row per bucket
        out[r.bucket] = r.n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of both smoothed shares of each bucket, in thousandths, rounded down."""
    k = len(own)
    top, low = float(own.sum() + k), float(target.sum() + k)
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * top / ((s + 1.0) * low))) for s, t in zip(own.tolist(), target.tolist())],
        np.int64,
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    most: int = MOST_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    range_rows: int | None = None,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): a draw without replacement, likelier the more a document looks
    like the texts of ``target``.

    The weight is the sum of the gains of a document's features, the score adds Gumbel noise from a hash of seed
    and id. Of the documents with ``least_words`` words at least, ``percent`` % (rounded down) with the highest
    scores have a rank; equal scores go by id, then by weight and features.

    One row per row of ``docs``, repeated ones included. Missing and empty texts have no feature, weight 0 and no
    rank; a missing id counts as the text ``null`` in the noise and comes last in a tie. An empty target counts
    as nothing in any bucket. Other columns are ignored.
    """
    own = cut_lineage(bucketed(docs, ["doc_id"], most, buckets), "features")
    gain = gains(histogram(own, buckets), histogram(bucketed(target, [], most, buckets), buckets))

    def task(batches):
        for batch in batches:
            found, edges = _unpacked(batch.column(3), buckets)
            sums = np.concatenate([[0], np.cumsum(gain[found])])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sums[edges[1:]] - sums[edges[:-1]], pa.int64())],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    kind = dict(own.dtypes)["doc_id"]
    weighed = own.mapInArrow(task, f"doc_id {kind}, n_words long, n_features long, weight long")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut_lineage(weighed.withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    fit = F.col("n_words") >= least_words
    n = scored.where(fit).count()
    size = range_rows or max(RANGE_ROWS, -(-n // MOST_RANGES))
    placed = number_rows(
        scored.where(fit).withColumn("_down", -F.col("score")), [], ["_down", "doc_id", "weight", "n_features"], "_no", size
    )
    drawn = F.when(F.col("_no") <= percent * n // 100, F.col("_no")).alias("rank")
    out = ("doc_id", "n_features", "weight", "score")
    return placed.select(*out, drawn).unionByName(
        scored.where(~fit).select(*out, F.lit(None).cast("long").alias("rank"))
    )
