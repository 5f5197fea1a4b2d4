"""Near duplicates by MinHash bands, odd sketches and a check on full shingle sets.

1. Every text gets 256 MinHash samples over its distinct five-word shingles. 32 bands of four samples
   name buckets; all samples are folded into an odd sketch, a bitmap that holds the parity of the
   samples falling on each bit. The XOR of two sketches holds only samples that differ, so its
   population count estimates a high similarity from a few bytes.
2. Texts with equal sets form one class, seen through its smallest id.
3. Each bucket links its members to one centre. Pairs whose sketches are alike enough are checked on
   full sets, read from whole texts. Confirmed links give components.
4. Buckets whose members are then in several components are searched in blocks, in rounds: finer sketches
   (2,048 samples) of all members are compared inside the task, and of the pairs across components that
   are alike enough a forest of the most alike ones goes on to the check on full sets. A link joins two
   components, whose other pairs need no check; a refused pair is not tried again. A block with pairs left
   takes part in the next round, with eight times as many forests, until none has. Nothing is capped; large
   buckets are cut into pairs of blocks.

A pair at the threshold shares no bucket with probability 5e-6 and falls below a sketch's limit (five
standard deviations under the threshold) with probability 3e-7.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm import blocks
from trialweave.llm.graph import components
from trialweave.session import cut_lineage

BANDS, ROWS, SAMPLES, BITS = 32, 4, 256, 1024
FINE_SAMPLES, FINE_BITS = 2048, 4096
SIGMAS = 5.0
#: Members of a bucket that are compared with each other in one task; a larger bucket takes pairs of blocks.
BLOCK = 4096
#: Forests of alike pairs that a block hands on in the first round, and how many times as many in each further one.
FORESTS, MORE = 8, 8
#: Members that are checked against one copy of their centre.
CHUNK = 1000
SEED = 20_011

SIGNATURES = "doc_id long, n long, set_key binary, bands binary, sketch binary"


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmap of each row's samples, as bytes: sample k toggles the bit its value and k choose."""
    n, k = samples.shape
    where = blocks.mix(samples ^ (np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    where = (where % np.uint64(bits)).astype(np.int64)
    where += np.arange(n, dtype=np.int64)[:, None] * bits
    parity = (np.bincount(where.ravel(), minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(n, bits), axis=1)


def likeness(toggled, samples: int, bits: int):
    """Jaccard similarity that a population count of XORed sketches stands for."""
    share = np.minimum(2.0 * np.asarray(toggled) / bits, 1 - 1e-9)
    return 1 + bits / (4.0 * samples) * np.log(1 - share)


def most_toggled(similarity: float, samples: int, bits: int, sigmas: float = SIGMAS) -> int:
    """Largest population count that a pair of the given similarity can be expected to show."""
    m = 2 * samples * (1 - similarity)
    slope = np.exp(-2 * m / bits)
    noise = max(bits / 4 * (1 - np.exp(-4 * m / bits)) - m * np.exp(-4 * m / bits), 0) ** 0.5 / slope / (2 * samples)
    low = similarity - sigmas * float(np.hypot(noise, (similarity * (1 - similarity) / samples) ** 0.5))
    m = 2 * samples * (1 - max(low, 0.0))
    return int(np.ceil(bits / 2 * (1 - np.exp(-2 * m / bits))))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = blocks.multipliers(SEED, SAMPLES)
    for batch in batches:
        for lo, hi in blocks.slices(batch.column(1)):
            values, edges = blocks.shingle_sets(batch.column(1).slice(lo, hi - lo))
            samples = blocks.minhashes(values, edges, a, b)
            used = samples[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
            bands = np.zeros(used.shape[:2], dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for r in range(ROWS):
                bands = blocks.mix(bands * np.uint64(0xFF51AFD7ED558CCD) + used[:, :, r])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array(np.diff(edges)),
                    blocks.binary(blocks.set_keys(values, edges)),
                    blocks.binary(bands),
                    blocks.binary(odd_sketch(samples, BITS)),
                ],
                names=["doc_id", "n", "set_key", "bands", "sketch"],
            )


def _matrix(column: pa.Array, kind=np.uint8) -> np.ndarray:
    """Rows of a fixed-length binary column."""
    if not len(column):
        return np.zeros((0, 1), dtype=kind)
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(raw[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), -1)


def _alike(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose two sketches differ in few enough bits."""
    for batch in batches:
        differ = np.bitwise_count(_matrix(batch.column(2)) ^ _matrix(batch.column(3))).sum(1, dtype=np.int64)
        kept = batch.filter(pa.array(differ <= most))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])


def _check(batches: Iterator[pa.RecordBatch], per_cent: int) -> Iterator[pa.RecordBatch]:
    """Members whose full set is similar enough to that of the centre in front of them."""
    centre = None
    for batch in batches:
        found_a, found_b = [], []
        ids, centres, roles = batch.column(3), batch.column(0), batch.column(2).to_numpy()
        for lo, hi in blocks.slices(batch.column(4)):
            values, edges = blocks.shingle_sets(batch.column(4).slice(lo, hi - lo))
            for i in range(lo, hi):
                own = values[edges[i - lo] : edges[i - lo + 1]]
                if roles[i] == 0:
                    centre = own.copy()
                    continue
                at = np.searchsorted(centre, own)
                at[at == len(centre)] = 0
                both = int((centre[at] == own).sum()) if len(centre) else 0
                if 100 * both >= per_cent * (len(own) + len(centre) - both):
                    found_a.append(centres[i].as_py())
                    found_b.append(ids[i].as_py())
        yield pa.RecordBatch.from_pydict({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})


def confirm(pairs: DataFrame, texts: DataFrame, per_cent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts, rows (doc_id, text), have similar enough full shingle sets.

    The members b of a centre a stream past its set; a centre with many members is copied per chunk.
    """
    count = pairs.groupBy("a").agg(F.count("*").alias("m"))
    dealt = pairs.join(count, "a").withColumn(
        "salt", F.pmod(F.xxhash64("b"), F.greatest(F.ceil(F.col("m") / CHUNK), F.lit(1)))
    )
    dealt = cut_lineage(dealt.select("a", "b", "salt"), "pairs")
    members = dealt.join(texts, dealt.b == texts.doc_id).select("a", "salt", F.lit(1).alias("role"), "doc_id", "text")
    centres = dealt.select("a", "salt").distinct()
    centres = centres.join(texts, centres.a == texts.doc_id).select(
        "a", "salt", F.lit(0).alias("role"), "doc_id", "text"
    )
    rows = members.unionByName(centres).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return rows.mapInArrow(partial(_check, per_cent=per_cent), "a long, b long")


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = blocks.multipliers(SEED + 1, FINE_SAMPLES)
    for batch in batches:
        for lo, hi in blocks.slices(batch.column(1)):
            values, edges = blocks.shingle_sets(batch.column(1).slice(lo, hi - lo))
            for x in range(0, hi - lo, 64):
                part = edges[x : x + 65]
                samples = blocks.minhashes(values, part, a, b)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo + x, len(part) - 1),
                        blocks.binary(odd_sketch(samples, FINE_BITS)),
                    ],
                    names=["doc_id", "fine"],
                )


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with equal first ``keys`` columns (numbers without nulls), as one batch each."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for k in range(keys):
            x = batch.column(k).to_numpy()
            change |= x[1:] != x[:-1]
        if rest and any(rest[-1].column(k)[-1] != batch.column(k)[0] for k in range(keys)):
            yield _joined(rest)
            rest = []
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if lo and rest:
                yield _joined(rest)
                rest = []
            rest.append(batch.slice(lo, hi - lo))
    if rest:
        yield _joined(rest)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def _forests(edges: list[tuple[int, int, int]], comp: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Of ``edges`` (distance, x, y), most alike first, ``k`` spanning forests over the components one after another."""
    kept, rest = [], sorted(edges)
    for _ in range(k):
        root: dict[int, int] = {}

        def find(c: int, root: dict[int, int] = root) -> int:
            while root.get(c, c) != c:
                root[c] = root.get(root[c], root[c])
                c = root[c]
            return c

        left = []
        for edge in rest:
            a, b = find(int(comp[edge[1]])), find(int(comp[edge[2]]))
            if a == b:
                left.append(edge)
            else:
                root[a] = b
                kept.append(edge)
        if len(left) == len(rest):
            break
        rest = left
    return kept


def _across(batches: Iterator[pa.RecordBatch], most: int, per_cent: int, k: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a bucket that lie in different components and whose fine sketches are alike enough, ``k`` forests of them.

    A pair that meets in several buckets is given by the bucket of its first common band only. A row without
    pair says that the block holds more.
    Columns: bucket, block i, block j, band, side (0: block i, 1: block j), doc_id, comp, n, bands, fine, refused.
    """
    for g in sorted_groups(batches, 3):
        band, side = int(g.column(3)[0].as_py()), g.column(4).to_numpy()
        ids, comp, n = (g.column(c).to_numpy() for c in (5, 6, 7))
        bands, fine = _matrix(g.column(8), np.uint64), _matrix(g.column(9), np.uint64)
        refused = g.column(10)
        one = g.column(1)[0].as_py() == g.column(2)[0].as_py()
        left = np.arange(len(ids)) if one else np.flatnonzero(side == 0)
        right = left if one else np.flatnonzero(side == 1)
        edges, total = [], 0
        for x in left.tolist():
            # only those behind x in a block's own triangle, in another component, of a size that can be similar
            y = right[x + 1 :] if one else right
            y = y[(comp[y] != comp[x]) & (100 * np.minimum(n[y], n[x]) >= per_cent * np.maximum(n[y], n[x]))]
            if not len(y):
                continue
            far = np.bitwise_count(fine[y] ^ fine[x]).sum(1, dtype=np.int64)
            y, far = y[far <= most], far[far <= most]
            if len(y):
                mine = (bands[y] == bands[x]).argmax(1) == band
                if refused[x].is_valid:
                    mine &= ~np.isin(ids[y], refused[x].values.to_numpy())
                y, far = y[mine], far[mine]
                total += len(y)
                if len(y) > k:
                    near = np.argpartition(far, k - 1)[:k]
                    y, far = y[near], far[near]
                edges += zip(far.tolist(), [x] * len(y), y.tolist())
        if total:
            kept = _forests(edges, comp, k)
            x, y = np.array([e[1] for e in kept]), np.array([e[2] for e in kept])
            more = [None] if len(kept) < total else []
            size = len(kept) + len(more)
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array([g.column(c)[0].as_py()] * size, g.column(c).type) for c in (0, 1, 2)],
                    pa.array([*np.minimum(ids[x], ids[y]).tolist(), *more], pa.int64()),
                    pa.array([*np.maximum(ids[x], ids[y]).tolist(), *more], pa.int64()),
                ],
                names=["bucket", "i", "j", "a", "b"],
            )


def _split_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            buckets = _matrix(batch.column(1), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)),
                    pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(buckets))),
                    pa.array(buckets.ravel()),
                ],
                names=["doc_id", "band", "bucket"],
            )


def _rounds(
    cells: DataFrame, detail: DataFrame, texts: DataFrame, roots: DataFrame, most: int, per_cent: int
) -> DataFrame:
    """(u, root) after all links between members of one block have been found.

    ``cells(bucket, i, j, band, side, doc_id)`` are the members of each block, ``detail`` what is compared.
    """
    block, k, refused = ["bucket", "i", "j"], FORESTS, None
    while True:
        placed = cells.join(roots.withColumnRenamed("u", "doc_id"), "doc_id", "left").withColumn(
            "comp", F.coalesce("root", "doc_id")
        )
        apart = placed.groupBy(*block).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
        rows = placed.join(apart.select(*block), block, "left_semi").join(detail, "doc_id")
        if refused is None:
            rows = rows.withColumn("refused", F.lit(None).cast("array<long>"))
        else:
            both = refused.select("a", "b").unionByName(refused.select(F.col("b").alias("a"), F.col("a").alias("b")))
            lists = both.groupBy(F.col("a").alias("doc_id")).agg(F.collect_list("b").alias("refused"))
            rows = rows.join(lists, "doc_id", "left")
        rows = rows.select(*block, "band", "side", "doc_id", "comp", "n", "bands", "fine", "refused")
        rows = rows.repartition(*block).sortWithinPartitions(*block, "band", "doc_id")
        found = rows.mapInArrow(
            partial(_across, most=most, per_cent=per_cent, k=k), "bucket long, i int, j int, a long, b long"
        )
        found = cut_lineage(found, "across")
        pairs = cut_lineage(found.where("a is not null").select("a", "b").distinct(), "pairs")
        if pairs.isEmpty():
            return roots
        good = cut_lineage(confirm(pairs, texts, per_cent), "links")
        roots = cut_lineage(components(roots.toDF("a", "b").unionByName(good)), "roots")
        more = found.where("a is null").select(*block)
        if more.isEmpty():
            return roots
        bad = pairs.join(good, ["a", "b"], "left_anti")
        refused = cut_lineage(bad if refused is None else refused.unionByName(bad), "refused")
        cells = cut_lineage(cells.join(more, block, "left_semi"), "cells")
        k *= MORE


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_cent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Texts link where 100 * |intersection| >= per_cent * |union| of their distinct five-word shingles;
    ``component_id`` is the smallest id reachable. Missing and empty texts, and those of white space
    only, have no shingles and stay alone. Equal texts and repeated rows share a component; each row
    of its smallest id is kept. A row without id is compared with nothing, is its own component
    (NULL) and is kept. Other columns are ignored.
    """
    base = blocks.small_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    signed = cut_lineage(base.mapInArrow(_signatures, SIGNATURES), "signatures")
    known = signed.where("doc_id is not null and n > 0")
    # a table of its own, so that the joins below can split a set that very many rows have
    classes = cut_lineage(known.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "sets")
    # one row per class: the row of its smallest id
    reps = cut_lineage(
        known.join(classes, "set_key").where("doc_id = rep").drop("rep").dropDuplicates(["doc_id"]), "classes"
    )

    banded = reps.select("doc_id", "bands").mapInArrow(_split_bands, "doc_id long, band int, bucket long")
    order = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")
    buckets = (
        banded.groupBy("band", "bucket")
        .agg(F.min(order).alias("c"), F.count("*").alias("m"))
        .where("m > 1")
        .select("band", "bucket", F.col("c.doc_id").alias("centre"), "m")
    )
    members = cut_lineage(banded.join(buckets, ["band", "bucket"]), "buckets")
    met = members.select("doc_id").distinct()
    texts = cut_lineage(base.join(met, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")

    sketches = reps.select("doc_id", "sketch", "n")
    pairs = members.where("doc_id != centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
    pairs = pairs.join(sketches.toDF("a", "s", "na"), "a").join(sketches.toDF("b", "t", "nb"), "b")
    pairs = pairs.where(f"100 * least(na, nb) >= {per_cent} * greatest(na, nb)").select("a", "b", "s", "t")
    near = most_toggled(per_cent / 100, SAMPLES, BITS)
    pairs = pairs.mapInArrow(partial(_alike, most=near), "a long, b long")
    first = cut_lineage(confirm(pairs, texts, per_cent), "links")
    roots = cut_lineage(components(first), "roots")

    # buckets whose members are still apart
    placed = members.join(roots, members.doc_id == roots.u, "left").select(
        "doc_id", "band", "bucket", "m", F.coalesce("root", "doc_id").alias("comp")
    )
    apart = placed.groupBy("band", "bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    apart = apart.where("lo != hi").select("band", "bucket")
    placed = cut_lineage(placed.join(apart, ["band", "bucket"], "left_semi"), "open")
    met = placed.select("doc_id").distinct()
    fine = texts.join(met, "doc_id", "left_semi").mapInArrow(_fine, "doc_id long, fine binary")
    detail = cut_lineage(
        fine.join(reps.select("doc_id", "n", "bands"), "doc_id").select("doc_id", "n", "bands", "fine"), "fine"
    )
    cells = placed.withColumn("g", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn(
        "own", F.pmod(F.xxhash64("doc_id"), F.col("g")).cast("int")
    )
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    cells = cells.select(
        "bucket",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        "band",
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
        "doc_id",
    )
    most = most_toggled(per_cent / 100, FINE_SAMPLES, FINE_BITS)
    roots = _rounds(cut_lineage(cells, "cells"), detail, texts, roots, most, per_cent)

    named = signed.select("doc_id", "n", "set_key").join(
        classes.select("set_key", "rep"), "set_key", "left"
    )
    named = named.join(roots, named.rep == roots.u, "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    comp = F.when(alone, F.col("doc_id")).otherwise(F.coalesce("root", "rep", "doc_id"))
    return named.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        comp.alias("component_id"),
        comp.eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_cent: int = 75) -> DataFrame:
    """One row of ``docs`` per group of near duplicates, the one with the smallest id; all columns as they are.

    Of rows that repeat both id and text one stays; rows without id and texts without words all stay.
    """
    found = near_duplicates(docs, id_col, text_col, per_cent)
    gone = cut_lineage(found.where("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    own = docs[id_col].cast("long")
    rows = docs.join(gone, own == F.col("__gone"), "left_anti")
    # ids that stand in several rows are rare; only their rows are compared whole
    again = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1")
    again = cut_lineage(again.select(F.col("doc_id").alias("__again")), "again")
    if again.isEmpty():
        return rows
    once = rows.join(again, own == F.col("__again"), "left_anti")
    return once.unionByName(rows.join(again, own == F.col("__again"), "left_semi").dropDuplicates([id_col, text_col]))
