"""Unions, pivots and row expansion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.operators.ranges import number_rows


def union_fill(*frames: DataFrame) -> DataFrame:
    """Union by column name; a column one side lacks is filled with NULL."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def union_strict(*frames: DataFrame) -> DataFrame:
    """Union by column name; differing column sets raise."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other)
    return out


def time_columns(time: str, value: str, names: Mapping[int, str]) -> list[Column]:
    return [F.min(F.when(F.col(time) == t, F.col(value))).alias(name) for t, name in names.items()]


def pivot_time(
    df: DataFrame, unit: str, time: str, value: str, names: Mapping[int, str]
) -> DataFrame:
    """One row per unit with a column per time point; duplicates resolve to the smallest value.

    Conditional aggregates need one shuffle on the unit; a pivot would add one on (unit, time).
    """
    return df.groupBy(unit).agg(*time_columns(time, value, names))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, to be looked at before a pivot."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


def stack_imputations(df: DataFrame, m: int, order: str = "unit_id") -> DataFrame:
    """``m`` stacked copies with the imputation number ``imp`` and the row number ``id``."""
    numbered = number_rows(df, [], [order], "id")
    return numbered.withColumn("imp", F.explode(F.sequence(F.lit(1), F.lit(m))))


def expand_arms(df: DataFrame, arms: Sequence[str]) -> DataFrame:
    """Every row under every arm, the observed arm kept as ``old_arm`` (one scan)."""
    every = F.explode(F.array(*[F.lit(a) for a in arms]))
    return df.withColumnRenamed("arm", "old_arm").withColumn("arm", every)
