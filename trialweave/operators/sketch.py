"""Quantiles from mergeable sketches: an opt-in where an exact rank is not worth a second pass.

A sketch per group is a few kilobytes of binary, can be kept in a stage table, and sketches of parts (stages,
days, imputations) merge into that of their union. Ranks are off by at most ``rank_error``; the exact quantiles are
in ``ranges.group_quantiles``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a sketch; ranks get closer as it grows.
SIZE = 4096


def rank_error(size: int = SIZE, times: float = 3.0) -> float:
    """Share of the rows by which a rank may be off: the published error of this sketch (99 %), three times over."""
    return times * 2.296 / size**0.9021


def quantile_sketches(df: DataFrame, by: Sequence[str], value: str, size: int = SIZE) -> DataFrame:
    """(by..., sketch) of the values that are numbers; combined in each task before the shuffle.

    A group without any has a NULL sketch.
    """
    v = F.col(value).cast("double")
    number = v.isNotNull() & ~F.isnan(v)
    made = df.groupBy(*by).agg(F.kll_sketch_agg_double(F.when(number, v), size).alias("_s"), F.count_if(number).alias("_n"))
    return made.select(*by, F.when(F.col("_n") > 0, F.col("_s")).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """One sketch per (coarser) group."""
    known = sketches.where(F.col("sketch").isNotNull())
    return known.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, by: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """(by..., n_values, a column per name) read off the sketches."""
    return sketches.select(
        *by,
        F.kll_sketch_get_n_double("sketch").alias("n_values"),
        *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in probs.items()],
    )
