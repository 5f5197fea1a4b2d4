"""Descriptive tables as plain long tables, cluster means and the cluster share of variance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.operators.joins import attach
from trialweave.operators.ranges import group_quantiles
from trialweave.session import cut_lineage

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def group_mean(
    df: DataFrame,
    key: str,
    value: str,
    name: str,
    spread: Sequence[str],
    hot: Sequence | None = None,
) -> DataFrame:
    """Mean of the non-missing values of each group, on every row of the group.

    Averages are formed before the shuffle and joined back, so a group holding much of the table
    is never brought together, as a window over the group would do.
    """
    means = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias(name))
    return attach(df, means, key, spread, "left", hot)


def _long(df: DataFrame, by: Sequence[str], variables: Sequence[str], kind: str) -> DataFrame:
    cells = [
        F.struct(F.lit(v).alias("variable"), F.col(v).cast(kind).alias("value")) for v in variables
    ]
    return df.select(*by, F.explode(F.array(*cells)).alias("c")).select(
        *by, F.col("c.variable").alias("variable"), F.col("c.value").alias("value")
    )


def summarise_categorical(df: DataFrame, by: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Count and share of the non-missing values, per group, variable and level.

    The window runs over the counted label sets, which are closed and small.
    """
    counts = (
        _long(df, by, variables, "string")
        .where(F.col("value").isNotNull())
        .groupBy(*by, "variable", F.col("value").alias("level"))
        .agg(F.count("*").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy(*by, "variable"))
    return counts.withColumn("pct", 100.0 * F.col("n") / total)


def summarise_continuous(df: DataFrame, by: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Median and quartiles of the non-missing values, per group and variable."""
    return group_quantiles(
        _long(df, by, variables, "double"), [*by, "variable"], "value", QUARTILES, "average"
    )


def summarise_missing(df: DataFrame, by: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Rows and missing values, per group and variable."""
    return (
        _long(df, by, variables, "string")
        .groupBy(*by, "variable")
        .agg(F.count("*").alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_missing"))
    )


def flatten_summary(
    df: DataFrame,
    by: Sequence[str],
    categorical: Sequence[str] = (),
    continuous: Sequence[str] = (),
) -> DataFrame:
    """All statistics in one table: (by..., variable, level, stat, value)."""
    parts = []
    if categorical:
        cat = summarise_categorical(df, by, categorical)
        parts.append(_stats(cat, [*by, "variable", "level"], ["n", "pct"]))
    if continuous:
        con = summarise_continuous(df, by, continuous).withColumn("level", F.lit(""))
        parts.append(_stats(con, [*by, "variable", "level"], list(QUARTILES)))
    missing = summarise_missing(df, by, [*categorical, *continuous]).withColumn("level", F.lit(""))
    parts.append(_stats(missing, [*by, "variable", "level"], ["n_rows", "n_missing"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _stats(df: DataFrame, ids: Sequence[str], stats: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value")) for s in stats]
    return df.select(*ids, F.explode(F.array(*cells)).alias("c")).select(*ids, "c.stat", "c.value")


def summarise_strata(
    df: DataFrame,
    strata: Sequence[str],
    by: Sequence[str],
    categorical: Sequence[str] = (),
    continuous: Sequence[str] = (),
) -> DataFrame:
    """The descriptive table inside each stratum: strata are further group keys, not a loop."""
    return flatten_summary(df, [*strata, *by], categorical, continuous)


def icc(df: DataFrame, outcome: str, cluster: str, by: Sequence[str] = ()) -> DataFrame:
    """Cluster share of the outcome variance by the one-way analysis-of-variance estimator."""
    y = F.col(outcome)
    per = cut_lineage(
        df.where(y.isNotNull() & F.col(cluster).isNotNull())
        .groupBy(*by, cluster)
        .agg(F.count(y).alias("n"), F.avg(y).alias("m"), (F.var_pop(y) * F.count(y)).alias("ss")),
        "cluster-moments",
    )
    n = F.col("n").cast("double")
    centre = per.agg((F.sum(n * F.col("m")) / F.sum(n)).alias("g")).first()["g"] or 0.0
    d = F.col("m") - F.lit(float(centre))  # keeps the sums of squares small
    sums = per.groupBy(*by).agg(
        F.count("*").alias("n_clusters"),
        F.sum("n").alias("n_units"),
        F.sum(n * n).alias("n2"),
        (F.sum(n * d * d) - F.sum(n * d) * F.sum(n * d) / F.sum(n)).alias("ssb"),
        F.sum("ss").alias("ssw"),
    )
    k, total = F.col("n_clusters"), F.col("n_units")
    out = (
        sums.withColumn("ms_between", F.try_divide("ssb", k - 1))
        .withColumn("ms_within", F.try_divide("ssw", total - k))
        .withColumn("n0", F.try_divide(total - F.col("n2") / total, k - 1))
    )
    between, within = F.col("ms_between"), F.col("ms_within")
    return out.select(
        *by,
        "n_clusters",
        "n_units",
        between,
        within,
        F.try_divide(between - within, between + (F.col("n0") - 1) * within).alias("icc"),
    )
