"""Row numbers and exact quantiles without putting a whole group into one task.

The value axis is cut at approximate quantiles into ranges of about ``RANGE_ROWS`` rows, or more of very many rows. Everything that
needs order is done inside one range; what lies before a range is known from the row counts of the
earlier ranges, a table of at most (groups x ranges) rows. The cut points only balance the work: any cut
points give the same result, and as plain numbers they put a row into the same range on every retry.
A small table is one range; there is no other path. NaN (the largest number) and NULL (behind it) are
ranges of their own.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.session import cut_lineage

RANGE_ROWS = 1_000_000
#: Ranges at most, as every task holds the cut points; more rows make the ranges larger.
MOST_RANGES = 2_000
#: Rows of the sample that a cut point rests on.
CUT_SAMPLE = 200

GROUP = "_group"
RANGE = "_range"


@dataclass(frozen=True)
class RangePlan:
    rows: int
    cuts: tuple[float, ...]


def plan_ranges(df: DataFrame, value: str, range_rows: int | None = None) -> RangePlan:
    """Count the rows and choose cut points for ranges of about ``range_rows`` rows, ``MOST_RANGES`` at most.

    The cut points come from a sample of some hundred rows per range. The sample decides only how
    evenly the work is spread: all rows are ranked, and the result is the same for any cut points.
    ``df`` is read twice, so it should be a written table.
    """
    wanted = max(1, RANGE_ROWS if range_rows is None else range_rows)
    v = F.col(value).cast("double")
    plain = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != math.inf)
    rows = df.agg(F.count_if(plain)).first()[0]
    parts = min(-(-rows // wanted), MOST_RANGES)
    if parts < 2:
        return RangePlan(rows, ())
    probs = [i / parts for i in range(1, parts)]
    share = CUT_SAMPLE * parts / rows
    source = df.where(plain)
    source = source if share >= 1.0 else source.where(F.rand(0) < share)
    cuts = source.agg(F.percentile_approx(v, probs, 20 * parts)).first()[0]
    return RangePlan(rows, tuple(sorted({c + 0.0 for c in cuts or []})))


def with_range(df: DataFrame, value: str, plan: RangePlan) -> DataFrame:
    """Add the range index of ``value``; equal values share a range, NaN and NULL come last."""
    v = F.col(value).cast("double")
    n = len(plan.cuts)
    if n:
        edges = [-math.inf, *plan.cuts, math.inf]
        keyed = df.withColumn("_range_value", v)
        out = Bucketizer(
            splits=edges, inputCol="_range_value", outputCol="_range_at", handleInvalid="keep"
        ).transform(keyed)
        at = F.col("_range_at").cast("int")
    else:
        out, at = df, F.lit(0)
    place = F.when(v.isNull(), n + 2).when(F.isnan(v), n + 1).otherwise(at)
    return out.withColumn(RANGE, place).drop("_range_value", "_range_at")


def group_key(by: Sequence[str]) -> Column:
    """One never-NULL key for a column list; two rows with the same missing parts are one group."""
    return F.struct(*by) if by else F.struct(F.lit(0).alias("all"))


def number_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    name: str = "rownumber",
    range_rows: int | None = None,
) -> DataFrame:
    """Number rows 1, 2, ... inside each ``by`` group in ascending ``order``, missing values last.

    The first order column is numeric and (nearly) unique, as unit and cluster ids are; the remaining
    ones break ties.
    """
    ascending = [F.col(c).asc_nulls_last() for c in order]
    keyed = cut_lineage(df.withColumn(GROUP, group_key(by)), "to-number")
    ranged = with_range(keyed, order[0], plan_ranges(keyed, order[0], range_rows))
    before = Window.partitionBy(GROUP).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(GROUP, RANGE)
        .agg(F.count("*").alias("_n"))
        .select(GROUP, RANGE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    local = Window.partitionBy(GROUP, RANGE).orderBy(*ascending)
    return (
        ranged.withColumn("_local", F.row_number().over(local))
        .join(offsets, [GROUP, RANGE])
        .withColumn(name, (F.col("_offset") + F.col("_local")).cast("long"))
        .drop(GROUP, RANGE, "_local", "_offset")
    )


def _rank_pair(p: float, n: Column, kind: str) -> tuple[Column, Column, Column]:
    """1-based ranks of the two order statistics and the weight of the second."""
    if kind == "linear":
        h = (n - 1) * F.lit(p)
        low = F.floor(h)
        return (low + 1).cast("long"), F.least(low + 2, n).cast("long"), h - low
    if kind == "average":
        h = n * F.lit(p)
        j = F.floor(h + 1e-9)
        whole = F.abs(h - j) <= 1e-9
        low = F.when(whole, F.greatest(j, F.lit(1))).otherwise(F.least(j + 1, n))
        return low.cast("long"), F.least(j + 1, n).cast("long"), F.lit(0.5)
    raise ValueError(f"unknown quantile kind {kind!r}")


def group_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    kind: str = "linear",
    range_rows: int | None = None,
) -> DataFrame:
    """Exact quantiles per group: one row per group with ``n_values`` and a column per name.

    ``linear`` interpolates between order statistics; ``average`` takes the order statistic, and
    the mean of two where the rank falls between them. Missing values are left out, NaN is the largest.
    """
    src = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    src = cut_lineage(src, "to-rank")
    plan = plan_ranges(src, "_v", range_rows)
    ranged = with_range(src.withColumn(GROUP, group_key(by)), "_v", plan)
    sized = ranged.groupBy(GROUP, RANGE).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(GROUP)
    upto = whole.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("_end", F.sum("_n").over(upto)).withColumn(
        "_total", F.sum("_n").over(whole)
    )
    wanted = []
    for name, p in probs.items():
        low, high, weight = _rank_pair(p, F.col("_total"), kind)
        for rank, share in ((low, 1.0 - weight), (high, weight)):
            wanted.append(
                F.struct(
                    F.lit(name).alias("name"), rank.alias("rank"), share.cast("double").alias("share")
                )
            )
    start = F.col("_end") - F.col("_n")
    targets = (
        placed.select(GROUP, RANGE, "_total", "_n", "_end", F.explode(F.array(*wanted)).alias("t"))
        .where((F.col("t.rank") > start) & (F.col("t.rank") <= F.col("_end")))
        .select(
            GROUP,
            RANGE,
            F.col("_total").alias("n_values"),
            F.col("t.name").alias("_name"),
            F.col("t.share").alias("_share"),
            (F.col("t.rank") - start).alias("_rank"),
        )
    )
    inside = Window.partitionBy(GROUP, RANGE).orderBy("_v")
    counted = (
        ranged.join(targets.select(GROUP, RANGE).distinct(), [GROUP, RANGE], "left_semi")
        .groupBy(GROUP, RANGE, "_v")
        .agg(F.count("*").alias("_c"))
        .withColumn("_last", F.sum("_c").over(inside))
    )
    hit = counted.join(targets, [GROUP, RANGE]).where(
        (F.col("_rank") > F.col("_last") - F.col("_c")) & (F.col("_rank") <= F.col("_last"))
    )
    picks = [
        F.sum(F.when((F.col("_name") == name) & (F.col("_share") > 0), F.col("_v") * F.col("_share"))).alias(name)
        for name in probs
    ]
    return (
        hit.groupBy(GROUP)
        .agg(F.max("n_values").alias("n_values"), *picks)
        .select(*[F.col(GROUP)[c].alias(c) for c in by], "n_values", *probs)
    )
