"""Nearest vectors by inner product: a neighbour graph by NN-descent, searched greedily.

Each vector gets one more component that makes all lengths equal, so that the graph's nearness is a distance
also where lengths differ. Graph and search compare 8-bit codes; what the search returns is ranked by the exact
inner product of the original vectors. Equal vectors are one node, which names its smallest ids.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.blocks import small_batches
from trialweave.llm.codes import kept_vectors
from trialweave.operators.joins import attach
from trialweave.session import cut_lineage

#: Neighbours of a node in the graph, and of those that name it, followed by the search.
DEGREE, BACK = 32, 24
#: First neighbours: rows of a block in which all pairs are compared, and orders that are cut into blocks.
BLOCK, ORDERS = 4096, 5
#: Members of a node's neighbourhood that are paired in a round: new ones and others, drawn by a hash.
NEW, OLD = 32, 20
#: Rounds of descent; it ends before where fewer than this share of all links is new.
ROUNDS, LEAST_NEW = 6, 0.02
#: Nodes that a query keeps, and how many of them it follows in a step.
BEAM, WIDTH = 128, 32
#: Nodes from which any query can start (a sample by hash, and the longest vectors), and how many of them it follows.
STARTS, LONGEST, FOLLOWED = 256, 64, 4
SEED = 11


def _fixed(column: pa.Array, kind=np.uint8) -> np.ndarray:
    """Binary values of equal length as the rows of an array."""
    if not len(column):
        return np.zeros((0, 0), kind)
    column = column.cast(pa.large_binary())
    raw = column.buffers()
    at = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(raw[2], np.uint8)[at[0] : at[-1]].reshape(len(column), -1).view(kind)


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def encode(x: np.ndarray) -> np.ndarray:
    """Rows of float numbers as a 32-bit scale and 8-bit whole numbers."""
    top = np.maximum(np.abs(x).max(1, initial=0.0), 1e-30)
    code = np.rint(x / top[:, None] * 127).astype(np.int8)
    return np.concatenate([(top / 127).astype(np.float32)[:, None].view(np.uint8), code.view(np.uint8)], 1)


def decode(code: np.ndarray) -> np.ndarray:
    scale = np.ascontiguousarray(code[:, :4]).view(np.float32)
    return code[:, 4:].view(np.int8).astype(np.float32) * scale


def _vectors(df: DataFrame, vector: str) -> tuple[DataFrame, type]:
    """(vec_id, vec, key): the vectors that take part as bytes, filled up with zeros, and a digest of them."""
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    there = F.col("vec_id").isNotNull() & kept_vectors(rows, "vector") & F.exists("vector", lambda x: x != 0)
    rows = cut_lineage(rows.where(there), "vectors")
    size = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    kind = np.float32 if dict(rows.dtypes)["vector"] == "array<float>" else np.float64

    def task(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            lengths = np.diff(column.offsets.to_numpy())
            row = np.repeat(np.arange(len(column)), lengths)
            place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            x = np.zeros((len(column), size), kind)
            x[row, place] = column.flatten().to_numpy(zero_copy_only=False)
            x += 0  # -0.0 is 0.0
            key = pa.array([hashlib.blake2b(r.tobytes(), digest_size=16).hexdigest() for r in x], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(x), key], ["vec_id", "vec", "key"])

    return small_batches(rows).mapInArrow(task, "vec_id long, vec binary, key string"), kind


def _limit(df: DataFrame, by: list[str], order: list[Column], most: int, keep: str | None = None) -> DataFrame:
    """The first ``most`` rows of each group; each task sends on no more than that of a group."""
    no = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    out = df.withColumn(keep or "_no", no).where(F.col(keep or "_no") <= most)
    return out if keep else out.drop("_no")


@dataclass(frozen=True)
class Index:
    """``nodes(id, vec, members)``, ``rows(vec_id, id)``, ``codes(id, code)``, ``graph(id, near)``, starts."""

    nodes: DataFrame
    rows: DataFrame
    codes: DataFrame
    graph: DataFrame
    starts: list[tuple[int, bytes]]
    kind: type


def build(df: DataFrame, vector: str = "embedding", names: int = 21, rounds: int = ROUNDS) -> Index:
    """The neighbour graph over all distinct vectors; a node names the ``names`` smallest ids of its vector."""
    rows, kind = _vectors(df, vector)
    one = cut_lineage(rows.groupBy("vec_id").agg(F.min(F.struct("vec", "key")).alias("s")).select("vec_id", "s.*"), "one")
    distinct = one.groupBy("key").agg(F.min("vec_id").alias("id"), F.min("vec").alias("vec"))
    least = _limit(one.select("key", "vec_id"), ["key"], [F.col("vec_id")], names)
    members = least.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    nodes = cut_lineage(distinct.join(members, "key"), "nodes")
    placed = attach(one.select("vec_id", "key"), nodes.select("key", "id"), "key", ["vec_id"], "inner")
    nodes = nodes.drop("key")

    @F.pandas_udf("double")
    def length(vec):
        return vec.map(lambda v: float(np.linalg.norm(np.frombuffer(v, kind).astype(np.float64))))

    measured = cut_lineage(nodes.select("id", "vec", length("vec").alias("length")), "lengths")
    found = measured.agg(F.max("length"), F.count("*")).first()  # two numbers
    longest, n = found[0] or 1.0, found[1]

    def task(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _fixed(batch.column(1), kind).astype(np.float64) / longest
            rest = np.sqrt(np.maximum(1.0 - (batch.column(2).to_numpy() / longest) ** 2, 0.0))
            x = np.concatenate([x.reshape(len(rest), -1), rest[:, None]], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), _packed(encode(x))], ["id", "length", "code"])

    coded = cut_lineage(measured.mapInArrow(task, "id long, length double, code binary"), "codes")
    codes = coded.select("id", "code")
    sample = codes.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(STARTS)
    longer = coded.orderBy(F.desc("length"), "id").limit(LONGEST).select("id", "code")
    starts = sorted({(r.id, bytes(r.code)) for r in sample.unionByName(longer).collect()})  # at most 320 rows
    links = _descend(codes, _first_links(codes, n, starts), n, rounds)
    ahead = links.select("id", "nbr", "sim")
    back = _limit(links.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"), "sim"), ["id"], [F.desc("sim"), F.col("nbr")], BACK)
    near = ahead.unionByName(back).groupBy("id").agg(F.collect_set("nbr").alias("near"))
    return Index(nodes, placed, codes, cut_lineage(near, "graph"), starts, kind)


def _first_links(codes: DataFrame, n: int, starts: list[tuple[int, bytes]]) -> DataFrame:
    """(id, nbr, sim): nearest rows inside blocks of rows that lie on the same sides of planes between sampled pairs."""
    bits = min(24, max(1, math.ceil(math.log2(max(n, 2) / BLOCK)) + 2))
    sample = decode(np.frombuffer(b"".join(c for _, c in starts), np.uint8).reshape(len(starts), -1)) if starts else None
    out = None
    for order in range(ORDERS):
        rng = np.random.default_rng([SEED, order])

        if sample is not None:
            at = rng.integers(0, len(sample), (2, bits))
            planes = sample[at[0]] - sample[at[1]] + 1e-6 * rng.standard_normal((bits, sample.shape[1]))
        else:
            planes = np.zeros((bits, 1))

        def sides(batches, planes=planes.astype(np.float32)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lean = decode(_fixed(batch.column(1))) @ planes.T
                side = ((lean > 0) << np.arange(lean.shape[1])[::-1]).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(side.astype(np.int64)), pa.array(lean[:, 0].astype(np.float64))],
                    ["id", "code", "side", "lean"],
                )

        placed = codes.mapInArrow(sides, "id long, code binary, side long, lean double")
        parts = max(1, min(n // BLOCK, 100_000))
        ranged = placed.repartitionByRange(parts, "side", "lean", "id").sortWithinPartitions("side", "lean", "id")
        made = ranged.select("id", "code").mapInArrow(_block_links, "id long, nbr long, sim float")
        out = made if out is None else out.unionByName(made)
    return out


def _block_links(batches) -> Iterator[pa.RecordBatch]:
    def links(ids: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
        x = decode(code)
        k = min(DEGREE, len(ids) - 1)
        for low in range(0, len(ids) if k else 0, 256):
            sims = x[low : low + 256] @ x.T
            sims[np.arange(len(sims)), np.arange(low, low + len(sims))] = -np.inf
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            own = np.repeat(ids[low : low + len(sims)], k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array(ids[near].ravel()), pa.array(np.take_along_axis(sims, near, 1).ravel())],
                ["id", "nbr", "sim"],
            )

    parts, held = [], 0

    def block(n: int) -> Iterator[pa.RecordBatch]:
        nonlocal parts, held
        ids, code = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        parts, held = [(ids[n:], code[n:])], len(ids) - n
        yield from links(ids[:n], code[:n])

    for batch in batches:
        if batch.num_rows:
            parts.append((batch.column(0).to_numpy(), _fixed(batch.column(1))))
            held += batch.num_rows
        while held >= 2 * BLOCK:  # what is left stays a block's length at least
            yield from block(BLOCK)
    if held:
        yield from block(held)


def _best(links: DataFrame) -> DataFrame:
    """The nearest ``DEGREE`` neighbours of each node; a link that was there before is not new."""
    merged = links.groupBy("id", "nbr").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    return _limit(merged, ["id"], [F.desc("sim"), F.col("nbr")], DEGREE)


def _descend(codes: DataFrame, first: DataFrame, n: int, rounds: int) -> DataFrame:
    """NN-descent: members of each node's neighbourhood, both ways, are proposed to each other."""
    links = cut_lineage(_best(first.withColumn("new", F.lit(True))), "links")
    for step in range(rounds):
        if links.where("new").count() < LEAST_NEW * DEGREE * n:
            break
        ends = [("id", "nbr", True), ("nbr", "id", False)]
        pool = [links.select(F.col(a).alias("centre"), F.col(b).alias("id"), "new", F.lit(c).alias("ahead")) for a, b, c in ends]
        mixed = F.xxhash64("centre", "id", F.lit(step), F.lit(SEED))
        pool = pool[0].unionByName(pool[1]).where("id != centre")
        drawn = _limit(pool, ["centre", "new"], [mixed, F.col("id")], max(NEW, OLD), "_no")
        drawn = cut_lineage(drawn.where(F.col("_no") <= F.when(F.col("new"), NEW).otherwise(OLD)).drop("_no"), "drawn")
        used = drawn.where("new and ahead").select(F.col("centre").alias("id"), F.col("id").alias("nbr"))
        full = links.groupBy("id").agg(F.when(F.count("*") >= DEGREE, F.min("sim")).alias("worst"))
        known = codes.join(full, "id", "left")
        cell = F.struct("id", "new", F.coalesce("worst", F.lit(-math.inf).cast("float")).alias("worst"), "code")
        groups = drawn.drop("ahead").join(known, "id").groupBy("centre").agg(F.collect_list(cell).alias("m"))
        found = groups.where(F.exists("m", lambda x: x["new"])).select("m").mapInArrow(_propose, "id long, nbr long, sim float")
        # a link stays new until its node has drawn it
        used = used.select("id", "nbr", F.lit(-math.inf).cast("float").alias("sim"), F.lit(False).alias("new"))
        links = cut_lineage(_best(links.unionByName(found.withColumn("new", F.lit(True))).unionByName(used)), "links")
    return links


def _propose(batches) -> Iterator[pa.RecordBatch]:
    """Pairs of a neighbourhood with a new member that improve the neighbours of one of them."""
    for batch in batches:
        column = batch.column(0)
        offsets = column.offsets.to_numpy()
        cells = column.flatten()
        ids, new, worst = (cells.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        code = _fixed(cells.field(3))
        at = offsets - offsets[0]
        for low in range(0, len(column), 512):
            high = min(low + 512, len(column))
            edge, sizes = at[low], np.diff(at[low : high + 1])
            group = np.repeat(np.arange(high - low), sizes)
            place = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            span = slice(edge, edge + len(group))
            x = np.zeros((high - low, sizes.max(), code.shape[1] - 4), np.float32)
            x[group, place] = decode(code[span])
            grid = np.full((3, high - low, sizes.max()), np.inf)
            grid[0, group, place], grid[1, group, place] = new[span], worst[span]
            who = np.full((high - low, sizes.max()), -1, np.int64)
            who[group, place] = ids[span]
            there = np.zeros(who.shape, bool)
            there[group, place] = True
            sims = x @ x.transpose(0, 2, 1)
            fresh = grid[0] == 1
            use = there[:, :, None] & there[:, None, :] & (fresh[:, :, None] | fresh[:, None, :])
            use &= (who[:, :, None] != who[:, None, :]) & (sims > grid[1][:, :, None])
            g, i, j = np.nonzero(use)
            yield pa.RecordBatch.from_arrays(
                [pa.array(who[g, i]), pa.array(who[g, j]), pa.array(sims[g, i, j])], ["id", "nbr", "sim"]
            )


BEAM_TYPE = "array<struct<id: long, score: float, done: boolean>>"


def _beam(ids: np.ndarray, scores: np.ndarray, done: np.ndarray) -> list[dict]:
    """The best ``BEAM`` nodes, ties to the smaller id."""
    order = np.lexsort((ids, -scores))[:BEAM]
    return [{"id": int(ids[i]), "score": float(scores[i]), "done": bool(done[i])} for i in order]


def search(index: Index, queries: DataFrame, own: bool = True) -> DataFrame:
    """(query, id, score): the nodes that a greedy search of the graph keeps for ``queries(query, vec)``.

    A query starts from the best of the index's starts and, with ``own``, from the node of its own number. In each
    step it follows the best nodes not followed yet, until all it keeps have been followed. ``vec`` are bytes as in
    the index; the score is the exact inner product. A query's nodes are one row; what it meets in a step is at
    most ``WIDTH`` nodes' neighbours.
    """
    kind, starts = index.kind, index.starts
    if not starts:
        return queries.select("query", F.lit(None).cast("long").alias("id"), F.lit(0.0).alias("score")).limit(0)
    ids = np.array([i for i, _ in starts])
    sample = decode(np.frombuffer(b"".join(c for _, c in starts), np.uint8).reshape(len(starts), -1))
    beam_type = pa.list_(pa.struct([("id", pa.int64()), ("score", pa.float32()), ("done", pa.bool_())]))

    def prepare(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _fixed(batch.column(1), kind).astype(np.float64)
            x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
            code = encode(np.concatenate([x, np.zeros((len(x), 1))], 1))
            scores = decode(code) @ sample.T
            cells = []
            for query, row in zip(batch.column(0).to_pylist(), scores):
                beam = _beam(ids, row, np.ones(len(ids), bool))
                for cell in beam[:FOLLOWED]:
                    cell["done"] = False
                if own and all(cell["id"] != query for cell in beam):
                    beam = [{"id": query, "score": 2.0, "done": False}, *beam[: BEAM - 1]]  # followed first of all
                cells.append([{**c, "done": c["done"] and c["id"] != query} for c in beam] if own else beam)
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(code), pa.array(cells, beam_type)], ["query", "q", "beam"])

    def step(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            beams = []
            q = decode(_fixed(batch.column(1)))
            for i, beam in enumerate(batch.column(2).to_pylist()):
                ready = np.array([c["id"] for c in beam], np.int64)
                scores = np.array([c["score"] for c in beam], np.float32)
                done = np.array([c["done"] for c in beam], bool)
                done[np.flatnonzero(~done)[:WIDTH]] = True
                met = batch.column(3)[i]
                if met.is_valid and len(met.values):
                    found, at = np.unique(met.values.field(0).to_numpy(), return_index=True)
                    new = ~np.isin(found, ready)
                    code = _fixed(met.values.field(1))[at[new]]
                    ready = np.concatenate([ready, found[new]])
                    scores = np.concatenate([scores, decode(code) @ q[i]])
                    done = np.concatenate([done, np.zeros(new.sum(), bool)])
                beams.append(_beam(ready, scores, done))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(beams, beam_type)], ["query", "q", "beam"])

    schema = f"query long, q binary, beam {BEAM_TYPE}"
    state = cut_lineage(queries.select("query", "vec").mapInArrow(prepare, schema), "beam")
    open_cells = F.filter("beam", lambda c: ~c["done"])
    finished = None
    while True:
        over = state.where(F.size(open_cells) == 0)
        finished = over if finished is None else finished.unionByName(over)
        state = state.where(F.size(open_cells) > 0)
        if state.isEmpty():
            break
        front = state.select("query", F.explode(F.slice(open_cells, 1, WIDTH)).alias("c")).select("query", F.col("c.id").alias("id"))
        near = front.join(index.graph, "id").select("query", F.explode("near").alias("id"))
        met = near.join(index.codes, "id").groupBy("query").agg(F.collect_list(F.struct("id", "code")).alias("met"))
        state = cut_lineage(state.join(met, "query", "left").select("query", "q", "beam", "met").mapInArrow(step, schema), "beam")

    def exact(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_fixed(batch.column(i), kind).astype(np.float64) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array((a * b).sum(1))], ["query", "id", "score"])

    kept = finished.select("query", F.explode("beam.id").alias("id"))
    pairs = kept.join(index.nodes.select("id", F.col("vec").alias("b")), "id")
    pairs = pairs.join(queries.select("query", F.col("vec").alias("a")), "query").select("query", "id", "a", "b")
    return pairs.mapInArrow(exact, "query long, id long, score double")


def nearest(df: DataFrame, vector: str = "embedding", k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row whose id is divisible by ``every``.

    Nearness is the inner product of the original vectors in double precision, larger first, ties to the smaller
    id; a row is no candidate of its own. Vectors that are missing, all zeros, empty or hold missing or non-finite
    components take no part, nor do rows without an id. Of several vectors under one id the smallest (as bytes)
    stands; repeated rows count once. A shorter vector counts as filled up with zeros. An empty table gives an
    empty result. Equal vectors are searched once and all their ids are candidates. Other columns are ignored.
    """
    index = build(df, vector, k + 1)
    asking = cut_lineage(index.rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "id"), "asking")
    vectors = index.nodes.select(F.col("id").alias("query"), "vec")
    queries = cut_lineage(vectors.join(asking.select(F.col("id").alias("query")).distinct(), "query", "left_semi"), "asked")
    found = search(index, queries)
    named = found.join(index.nodes.select("id", "members"), "id").select("query", "score", F.explode("members").alias("vec_id"))
    best = _limit(named, ["query"], [F.desc("score"), F.col("vec_id")], k + 1)
    cell = F.struct((-F.col("score")).alias("down"), "vec_id", "score")
    lists = best.groupBy(F.col("query").alias("id")).agg(F.sort_array(F.collect_list(cell)).alias("found"))
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = attach(asking, lists, "id", ["query_id"], "inner").select("query_id", F.posexplode(others).alias("p", "c"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), "c.vec_id", "c.score")
