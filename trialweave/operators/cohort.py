"""Cluster selection, enrolment order and stratified block assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.operators.ranges import number_rows
from trialweave.schema import ARMS


def first_row(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each group in ascending order, missing values last.

    Spark keeps only the best row per group and map task before the shuffle, so a group of any
    size sends at most one row per task.
    """
    w = Window.partitionBy(*by).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def representative_units(
    df: DataFrame, cluster: str = "cluster_id", unit: str = "unit_id"
) -> DataFrame:
    """One row per cluster: the one with the smallest unit id."""
    return first_row(df, [cluster], [unit])


def enrolment_rank(
    clusters: DataFrame, strata: Sequence[str], cluster: str = "cluster_id"
) -> DataFrame:
    """Number the clusters of each stratum in id order; clusters without a stratum drop out."""
    known = clusters
    for s in strata:
        known = known.where(F.col(s).isNotNull())
    return number_rows(known, strata, [cluster])


def block_arm(rank: Column, arms: Sequence[str], seed: int, *stratum: Column) -> Column:
    """Arm of the ``rank``-th slot: blocks of one slot per arm, each block permuted by a hash.

    The permutation depends on seed and block only, so every stratum has the same sequence unless
    its columns are passed too.
    """
    k = len(arms)
    block = F.floor((rank - 1) / k)
    keyed = [
        F.struct(
            F.md5(F.concat_ws("|", F.lit(str(seed)), *stratum, block.cast("string"), F.lit(a))).alias("h"),
            F.lit(a).alias("arm"),
        )
        for a in arms
    ]
    slot = F.pmod(rank - 1, F.lit(k)).cast("int") + 1
    return F.element_at(F.array_sort(F.array(*keyed)), slot)["arm"]


def assign_blocks(
    clusters: DataFrame,
    strata: Sequence[str],
    arms: Sequence[str] = ARMS,
    seed: int = 1,
    cluster: str = "cluster_id",
    independent_strata: bool = False,
) -> DataFrame:
    """Stratified permuted-block assignment: adds ``rownumber``, ``block_id`` and ``treatment``."""
    ranked = enrolment_rank(clusters, strata, cluster)
    rank = F.col("rownumber")
    extra = [F.col(s).cast("string") for s in strata] if independent_strata else []
    return ranked.withColumn("block_id", F.floor((rank - 1) / len(arms)).cast("long")).withColumn(
        "treatment", block_arm(rank, arms, seed, *extra)
    )


def block_schedule(slots: DataFrame, arms: Sequence[str], seed: int) -> DataFrame:
    """Schedule rows (block, treatment) for a table of slots with ``rownumber``."""
    rank = F.col("rownumber")
    return slots.withColumn("block_id", F.floor((rank - 1) / len(arms)).cast("long")).withColumn(
        "treatment", block_arm(rank, arms, seed)
    )
