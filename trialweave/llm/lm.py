"""Stupid-backoff language-model scores from corpus-wide n-gram counts.

Documents are dealt into chunks. Each chunk explodes its texts into n-grams of order 1 to 3 and counts
them; the counts, keyed by n-gram hash, are partitioned by hash ranges and summed there into the count
tables of the corpus. The tables are joined back to each chunk's n-grams, and the score of each position
is summed per document.

Millions of n-grams travel as few rows: a chunk's distinct hashes for one range are one binary value
(sorted, as differences, in byte planes), and the range answers with the counts in the same order.

Counts for a document leave out its own n-grams, so that a text does not vouch for itself and backing off
is needed where no other document has the n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm import blocks

ORDER, ALPHA = 3, 0.4
#: Count of a word that no other document has.
UNSEEN = 0.5
#: Bytes of text per chunk, and chunks' worth of n-grams per hash range.
CHUNK_BYTES, CHUNKS_PER_RANGE = 5 << 20, 1
#: Bits of an n-gram's hash above those that number the n-grams: one lookup in 2**SPARE_BITS (to 64 bits)
#: meets another n-gram's count, at any size of the corpus.
SPARE_BITS = 28


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Whole numbers in as many byte planes as the largest needs, compressed; ascending ones as differences."""
    step = values.astype(np.uint64)
    if ascending:
        step = np.diff(step, prepend=np.uint64(0))
    width = max(1, (int(step.max()).bit_length() + 7) // 8) if len(step) else 1
    planes = step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width, ascending]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).data)


def unpack(data: bytes) -> np.ndarray:
    width, ascending = data[0], data[1]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[2:]), dtype=np.uint8).reshape(width, -1)
    full = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    full[:, :width] = planes.T
    out = full.view("<u8").ravel().astype(np.uint64)
    return np.cumsum(out, dtype=np.uint64) if ascending else out


class _Grams:
    """n-grams of a block of texts.

    ``hashes`` and ``ends`` are one after another by order: hash and place of the last word of each
    n-gram that lies inside one text; ``cuts`` separates the orders.
    """

    def __init__(self, column: pa.Array, order: int, bits: int) -> None:
        w = blocks.words(column)
        self.sizes = w.last - w.first
        self.text = np.repeat(np.arange(len(w.first), dtype=np.int32), self.sizes)
        # words in front of a word within its text
        self.depth = np.arange(len(w.hashes)) - np.repeat(w.first, self.sizes)
        hashes, ends = [], []
        for n in range(1, order + 1):
            at = np.flatnonzero(self.depth >= n - 1).astype(np.int32)
            hashes.append(blocks.ngram_hashes(w.hashes, n)[at - (n - 1)] >> np.uint64(64 - bits))
            ends.append(at)
        self.cuts = np.cumsum([0, *map(len, ends)])
        self.hashes, self.ends = np.concatenate(hashes), np.concatenate(ends)


def _runs(ranked: np.ndarray) -> np.ndarray:
    """First places of the runs of equal values."""
    return np.flatnonzero(np.concatenate([[len(ranked) > 0], ranked[1:] != ranked[:-1]]))


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) with the text compressed, as it is moved once and read twice."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data, start, end = blocks.buffers(batch.column(1))
        small = [press.compress(data[a:b]) for a, b in zip(start.tolist(), end.tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(small, pa.binary())], names=["doc_id", "packed"])


def _texts(column: pa.Array) -> Iterator[pa.Array]:
    """The texts of compressed rows, some at a time."""
    press = zstandard.ZstdDecompressor()
    parts, size = [], 0
    for x in column:
        parts.append(press.decompress(x.as_buffer()))
        size += len(parts[-1])
        if size >= blocks.BLOCK_BYTES or len(parts) == blocks.BLOCK_ROWS:
            yield pa.array(parts, pa.large_binary()).view(pa.large_string())
            parts, size = [], 0
    if parts:
        yield pa.array(parts, pa.large_binary()).view(pa.large_string())


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes and words of all texts."""
    size = words = 0
    for batch in batches:
        for lo, hi in blocks.slices(batch.column(1)):
            column = batch.column(1).slice(lo, hi - lo)
            _, start, end = blocks.buffers(column)
            size += int((end - start).sum())
            words += len(blocks.words(column).hashes)
    yield pa.RecordBatch.from_pydict({"size": [size], "words": [words]})


def _ask(batches: Iterator[pa.RecordBatch], order: int, ranges: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, compressed text) sorted by chunk -> (range, chunk, grams, counts)."""
    edges = np.array([-(-(i << bits) // ranges) for i in range(ranges)], dtype=np.uint64)

    def answer(chunk: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        every = np.sort(np.concatenate(parts))
        starts = _runs(every)
        grams, counts = every[starts], np.diff(np.append(starts, len(every)))
        cut = [*np.searchsorted(grams, edges).tolist(), len(grams)]
        full = [r for r in range(ranges) if cut[r + 1] > cut[r]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(full, pa.int32()),
                pa.array([chunk] * len(full), pa.int64()),
                pa.array([pack(grams[cut[r] : cut[r + 1]], True) for r in full], pa.binary()),
                pa.array([pack(counts[cut[r] : cut[r + 1]]) for r in full], pa.binary()),
            ],
            names=["range", "chunk", "grams", "counts"],
        )

    now, parts = None, []
    for batch in batches:
        chunks = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist(), len(chunks)] if len(chunks) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if now is not None and chunks[lo] != now and parts:
                yield answer(now, parts)
                parts = []
            now = int(chunks[lo])
            column = batch.column(1).slice(lo, hi - lo)
            parts += [_Grams(texts, order, bits).hashes for texts in _texts(column)]
    if parts:
        yield answer(now, parts)


def _tell(table: pa.Table) -> pa.Table:
    """One hash range: sum the counts of all chunks, and give each chunk the totals of its n-grams."""
    grams = [unpack(x) for x in table.column("grams").to_pylist()]
    counts = [unpack(x) for x in table.column("counts").to_pylist()]
    every = np.concatenate(grams)
    order = np.argsort(every)
    ranked = every[order]
    starts = _runs(ranked)
    sums = np.add.reduceat(np.concatenate(counts)[order], starts)
    totals = np.empty(len(every), dtype=np.uint64)
    totals[order] = np.repeat(sums, np.diff(np.concatenate([starts, [len(ranked)]])))
    cut = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
    answers = [pack(totals[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    return pa.table(
        {"chunk": table.column("chunk"), "range": table.column("range"), "totals": pa.array(answers, pa.binary())}
    )


def _scores(docs: pa.Table, answers: pa.Table, order: int, words: int, bits: int, alpha: float) -> pa.Table:
    """Scores of one chunk's documents from the totals of its distinct n-grams, range after range."""
    parts = answers.column("totals").to_pylist()
    by_range = np.argsort(answers.column("range").to_numpy()) if parts else []
    totals = np.concatenate([np.zeros(0, np.uint64), *[unpack(parts[i]) for i in by_range]])
    packed = docs.column("packed").combine_chunks()
    pieces = [_Grams(texts, order, bits) for texts in _texts(packed)]
    every = np.concatenate([np.zeros(0, np.uint64), *[g.hashes for g in pieces]])
    firsts = np.cumsum([0, *[len(g.sizes) for g in pieces]])
    owner = np.concatenate([np.zeros(0, np.int64), *[g.text[g.ends] + f for g, f in zip(pieces, firsts)]])
    # number of each n-gram among the chunk's distinct ones, whose totals are in ascending order
    rank = np.argsort(every)
    ranked = every[rank]
    number = np.empty(len(every), dtype=np.int64)
    number[rank] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]])) if len(every) else 0
    del every, rank, ranked
    others = totals[number].astype(np.float64)
    # less the n-gram's count in its own document
    number *= max(int(firsts[-1]), 1)
    number += owner
    del owner
    rank = np.argsort(number)
    starts = _runs(number[rank])
    length = np.diff(np.append(starts, len(number)))
    others[rank] -= np.repeat(length, length)
    del number, rank, starts, length

    names = [f"order_{n}" for n in range(order, 0, -1)]
    out: dict[str, list] = {c: [] for c in ("n_words", *names, "log_score")}
    at = 0
    for g in pieces:
        n, n_texts = len(g.depth), len(g.sizes)
        left = np.maximum(words - g.sizes, 1)[g.text]
        # counts by the place of the last word, order by order
        counts = np.zeros((order + 1, n))
        for k in range(1, order + 1):
            a, b = g.cuts[k - 1], g.cuts[k]
            counts[k, g.ends[a:b]] = others[at + a : at + b]
        at += len(g.hashes)
        value = np.log(np.maximum(counts[1], UNSEEN) / left)
        used = np.ones(n, dtype=np.int64)
        for k in range(2, order + 1):
            ends = g.ends[g.cuts[k - 1] : g.cuts[k]]
            hit = counts[k, ends] > 0
            # a context is at least as frequent as what follows it, whatever hashes meet
            context = np.maximum(np.where(hit, counts[k - 1, ends - 1], 1.0), np.where(hit, counts[k, ends], 1.0))
            direct = np.log(np.where(hit, counts[k, ends], 1.0) / context)
            value[ends] = np.where(hit, direct, np.log(alpha) + value[ends])
            used[ends] = np.where(hit, k, used[ends])
        out["n_words"].append(g.sizes)
        out["log_score"].append(np.bincount(g.text, value, n_texts))
        for k in range(1, order + 1):
            out[f"order_{k}"].append(np.bincount(g.text[used == k], minlength=n_texts))
    kinds = {c: np.float64 if c == "log_score" else np.int64 for c in out}
    pa.default_memory_pool().release_unused()
    flat = {c: np.concatenate([np.zeros(0), *v]).astype(kinds[c]) for c, v in out.items()}
    return pa.table({"doc_id": docs.column("doc_id"), **{c: pa.array(v) for c, v in flat.items()}})


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, n_words, order_3, order_2, order_1, log_score, mean_log_score), one row per row of ``docs``.

    The score of a word is its n-gram's count over its context's count, both in all other rows; where
    that n-gram has no count, alpha times the score at the order below; at order one its count over all
    words, an unseen word counting 0.5. ``order_k`` counts the words scored at order k. Texts without
    words score 0 (mean NULL). Repeated rows vouch for each other; rows without id are scored alike.
    """
    base = blocks.small_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    size, words = base.mapInArrow(_measure, "size long, words long").agg(
        F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))
    ).first()
    chunks = max(1, -(-size // CHUNK_BYTES))
    ranges = max(1, -(-chunks // CHUNKS_PER_RANGE))
    bits = min(64, (int(words) * order).bit_length() + SPARE_BITS)
    # equal texts are dealt apart by their ids; the text decides among rows without id
    dealt = base.mapInArrow(_squeeze, "doc_id long, packed binary")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "packed"), F.lit(chunks)))
    dealt = dealt.repartition(int(chunks), "chunk").sortWithinPartitions("chunk", "doc_id", "packed")
    asked = dealt.select("chunk", "packed").mapInArrow(
        partial(_ask, order=order, ranges=ranges, bits=bits), "range int, chunk long, grams binary, counts binary"
    )
    told = asked.groupBy("range").applyInArrow(_tell, "chunk long, range int, totals binary")
    fields = "doc_id long, n_words long, " + ", ".join(f"order_{n} long" for n in range(order, 0, -1)) + ", log_score double"
    run = partial(_scores, order=order, words=int(words), bits=bits, alpha=alpha)
    found = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(lambda x, y: run(x, y), fields)
    return found.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
