"""Group comparisons: chi-square, rank-sum and Fisher's exact test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions.tails import chisq_tail, normal_two_sided
from trialweave.operators.ranges import RANGE, plan_ranges, with_range
from trialweave.session import cut_lineage


def _cells(df: DataFrame, by: str, variable: str) -> DataFrame:
    return (
        df.where(F.col(by).isNotNull() & F.col(variable).isNotNull())
        .groupBy(F.col(by).alias("row_label"), F.col(variable).alias("col_label"))
        .agg(F.count("*").alias("o"))
    )


def chi_square(df: DataFrame, by: str, variable: str, p_value: bool = True) -> DataFrame:
    """Pearson's chi-square without continuity correction, with the smallest expected count.

    Sum of (o-e)^2/e over the grid of the observed labels, cells without rows included; the labels are
    closed sets, so the grid is small.
    """
    cells = _cells(df, by, variable)
    rows = cells.groupBy("row_label").agg(F.sum("o").alias("r"))
    cols = cells.groupBy("col_label").agg(F.sum("o").alias("c"))
    listed = cols.agg(F.collect_list(F.struct("col_label", "c")).alias("l")).scalar()
    total = rows.agg(F.sum("r").cast("double")).scalar()
    grid = rows.select("row_label", "r", F.inline(listed)).join(cells, ["row_label", "col_label"], "left")
    o, e = F.coalesce("o", F.lit(0)).cast("double"), F.col("r").cast("double") * F.col("c") / total
    out = (
        grid.agg(
            F.sum((o - e) * (o - e) / e).alias("s"),
            F.min(e).alias("least"),
            F.count_distinct("row_label").alias("n_row"),
            F.count_distinct("col_label").alias("n_col"),
        )
        .select(
            F.lit(variable).alias("variable"),
            F.col("s").alias("statistic"),
            ((F.col("n_row") - 1) * (F.col("n_col") - 1)).cast("long").alias("df"),
            F.col("least").alias("min_expected"),
        )
    )
    if p_value:
        out = out.withColumn("p_value", chisq_tail("statistic", F.col("df").cast("double")))
    return out


def rank_sum(
    df: DataFrame,
    by: str,
    value: str,
    groups: Sequence,
    p_value: bool = True,
    range_rows: int | None = None,
) -> DataFrame:
    """Wilcoxon rank-sum of the first group against the second: mid-ranks, tie and continuity
    correction, normal approximation.

    Rows are counted per distinct value first. Ranks inside a value range follow from the counts
    in that range; the ranges are then put together from one row each.
    """
    first, second = groups
    label, v = F.col(by), F.col(value).cast("double")
    src = df.where(label.isin(first, second) & v.isNotNull()).select(
        v.alias("_v"), (label == first).cast("long").alias("_a")
    )
    values = cut_lineage(src.groupBy("_v").agg(F.count("*").alias("t"), F.sum("_a").alias("a")), "to-rank")
    counted = with_range(values, "_v", plan_ranges(values, "_v", range_rows))
    inside = Window.partitionBy(RANGE).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    t, a = F.col("t").cast("double"), F.col("a").cast("double")
    local = F.coalesce(F.sum("t").over(inside), F.lit(0)) + (t + 1.0) / 2.0
    per_range = (
        counted.withColumn("_local", a * local)
        .groupBy(RANGE)
        .agg(
            F.sum("t").alias("t"),
            F.sum("a").alias("a"),
            F.sum("_local").alias("local"),
            F.sum(t * t * t - t).alias("ties"),
        )
    )
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offset = F.coalesce(F.sum("t").over(earlier), F.lit(0))
    n_first, n_second = F.col("n_first").cast("double"), F.col("n_second").cast("double")
    total = n_first + n_second
    sums = (
        per_range.withColumn("_ranks", F.col("a") * offset + F.col("local"))
        .agg(
            F.sum("a").alias("n_first"),
            (F.sum("t") - F.sum("a")).alias("n_second"),
            F.sum("_ranks").alias("ranks"),
            F.sum("ties").alias("tie_term"),
        )
        .withColumn("w", F.col("ranks") - n_first * (n_first + 1.0) / 2.0)
    )
    shift = F.col("w") - n_first * n_second / 2.0
    spread = F.sqrt(
        n_first * n_second / 12.0 * (total + 1.0 - F.col("tie_term") / (total * (total - 1.0)))
    )
    out = sums.select(
        F.lit(value).alias("variable"),
        "n_first",
        "n_second",
        "w",
        "tie_term",
        F.try_divide(shift - 0.5 * F.signum(shift), spread).alias("z"),
    )
    return out.withColumn("p_value", normal_two_sided("z")) if p_value else out


FISHER_REACH = 40.0
FISHER_CHUNK = 100_000


def fisher_2x2(
    df: DataFrame, by: str, variable: str, rows: Sequence, cols: Sequence
) -> DataFrame:
    """Two-sided exact test of a 2x2 table, with all margins fixed.

    The four counts are kept as a one-row table first, so the data is read once. Log probabilities come from running sums of the log ratios of neighbouring tables, which stays
    accurate for large counts. Tables further than 40 standard deviations from the expected one
    have no weight in double precision and are not listed, unless the observed one lies there.
    """
    cell = {
        name: F.count_if((F.col(by) == r) & (F.col(variable) == c)).alias(name)
        for name, r, c in (
            ("n11", rows[0], cols[0]),
            ("n12", rows[0], cols[1]),
            ("n21", rows[1], cols[0]),
            ("n22", rows[1], cols[1]),
        )
    }
    d = lambda name: F.col(name).cast("double")
    counts = cut_lineage(df.agg(*cell.values()), "fisher-cells")
    table = (
        counts.withColumn("r1", F.col("n11") + F.col("n12"))
        .withColumn("c1", F.col("n11") + F.col("n21"))
        .withColumn("n", F.col("r1") + F.col("n21") + F.col("n22"))
        .withColumn("centre", F.try_divide(d("r1") * d("c1"), d("n")))
        .withColumn(
            "sd",
            F.sqrt(
                F.col("centre")
                * F.try_divide(d("n") - d("r1"), d("n"))
                * F.try_divide(d("n") - d("c1"), F.greatest(d("n") - 1, F.lit(1.0)))
            ),
        )
    )
    reach = FISHER_REACH * (F.col("sd") + 1.0)
    low = F.greatest(F.lit(0), F.col("r1") + F.col("c1") - F.col("n"))
    high = F.least(F.col("r1"), F.col("c1"))
    lo = F.least(F.greatest(low, F.floor(F.col("centre") - reach)), F.col("n11"))
    hi = F.greatest(F.least(high, F.ceil(F.col("centre") + reach)), F.col("n11"))
    spans = table.where(F.col("n") > 0).withColumn("lo", lo.cast("long")).withColumn("hi", hi.cast("long"))
    chunked = spans.withColumn(
        "chunk",
        F.explode(
            F.sequence(F.lit(0).cast("long"), F.floor((F.col("hi") - F.col("lo")) / FISHER_CHUNK))
        ),
    ).withColumn("first", F.col("lo") + F.col("chunk") * FISHER_CHUNK)
    listed = chunked.select(
        "n11", "r1", "c1", "n", "lo", "chunk",
        F.explode(
            F.sequence("first", F.least(F.col("hi"), F.col("first") + (FISHER_CHUNK - 1)))
        ).alias("x"),
    )
    step = F.when(
        F.col("x") > F.col("lo"),
        F.log(d("r1") - d("x") + 1.0)
        + F.log(d("c1") - d("x") + 1.0)
        - F.log(d("x"))
        - F.log(d("n") - d("r1") - d("c1") + d("x")),
    ).otherwise(0.0)
    within = Window.partitionBy("chunk").orderBy("x")
    local = listed.withColumn("rel", F.sum(step).over(within))
    ends = local.groupBy("chunk").agg(F.max_by("rel", "x").alias("rise"))
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk
    starts = ends.select("chunk", F.coalesce(F.sum("rise").over(earlier), F.lit(0.0)).alias("start"))
    logp = local.join(starts, "chunk").withColumn("lp", F.col("rel") + F.col("start"))
    ref = logp.agg(
        F.struct(
            F.max("lp").alias("top"),
            F.max(F.when(F.col("x") == F.col("n11"), F.col("lp"))).alias("seen"),
        ).alias("ref")
    )
    weighed = logp.withColumn("ref", ref.scalar())
    p = F.exp(F.col("lp") - F.col("ref.top"))
    extreme = F.col("lp") <= F.col("ref.seen") + 1e-7
    tail = weighed.agg((F.sum(F.when(extreme, p).otherwise(0.0)) / F.sum(p)).alias("p_value"))
    return table.select(
        F.lit(variable).alias("variable"), "n11", "n12", "n21", "n22"
    ).withColumn("p_value", F.least(tail.scalar(), F.lit(1.0)))


def compare_groups(
    df: DataFrame,
    by: str,
    groups: Sequence,
    categorical: dict[str, Sequence],
    continuous: Sequence[str] = (),
) -> DataFrame:
    """One row per variable with the test chosen as a baseline table does.

    Categorical: chi-square, or Fisher's exact test for a 2x2 table with an expected count below 5; a
    larger table like that keeps chi-square and is marked ``sparse``. Continuous: rank-sum.
    """
    known = df.where(F.col(by).isin(*groups))
    out = None
    for variable, levels in categorical.items():
        chi = chi_square(known, by, variable)
        sparse = F.col("min_expected") < 5
        if len(levels) == 2:
            exact = fisher_2x2(known, by, variable, groups, levels).select("p_value")
            use, p_exact = sparse, exact.scalar()
        else:
            use, p_exact = F.lit(False), F.lit(None).cast("double")
        part = chi.select(
            "variable",
            F.when(use, F.lit("fisher")).otherwise(F.lit("chisq")).alias("test"),
            "statistic",
            F.when(use, p_exact).otherwise(F.col("p_value")).alias("p_value"),
            sparse.alias("sparse"),
        )
        out = part if out is None else out.unionByName(part)
    for variable in continuous:
        part = rank_sum(known, by, variable, groups).select(
            "variable", F.lit("rank_sum").alias("test"), F.col("w").alias("statistic"), "p_value", F.lit(False).alias("sparse")
        )
        out = part if out is None else out.unionByName(part)
    return out
