"""Connected components of a link table, with joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.session import cut_lineage


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """(u, root): the smallest vertex reachable from each vertex ``u`` that is not itself a root.

    ``links`` has two columns of the same type. Large-star and small-star steps alternate until the
    edges no longer change; a vertex's neighbours are never gathered in one value, and each step is
    written to the shared folder. Loops and repeated links do no harm; no links give an empty table.
    """
    a, b = links.columns
    edges = cut_lineage(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "links",
    )
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("low"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v")
        )
        large = large.unionByName(edges.join(low, "u").select("u", F.col("low").alias("v")).where("u != v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
            .unionByName(low.select("u", F.col("low").alias("v")))
            .where("u != v")
            .distinct()
        )
        edges = cut_lineage(small, "links")
        after = _state(edges)
        if tuple(after) == tuple(before):
            break
        before = after
    return edges.groupBy("u").agg(F.min("v").alias("root"))
