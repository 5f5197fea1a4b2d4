"""Probabilities, intervals and contrasts from posterior draws or from a fit table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions.recode import at_least_flag, greater_flag, less_flag
from trialweave.functions.tails import normal_cdf
from trialweave.operators.model import Fit, Formula
from trialweave.operators.ranges import group_quantiles, number_rows
from trialweave.schema import NONINFERIORITY_MARGIN
from trialweave.session import cut_lineage

INTERVAL = {"estimate": 0.5, "lower": 0.025, "upper": 0.975}
DECISIONS = ("p_noninferior", "p_low_above_high", "p_high_above_control", "p_low_above_control")


def decision_flags(draws: DataFrame, high: str, low: str, margin: float = NONINFERIORITY_MARGIN) -> DataFrame:
    """0/1 per draw: low not worse than high by more than the margin, low above high, each above
    control. The margin itself counts as not worse; the other comparisons are strict."""
    gap = F.col(low) - F.col(high)
    flags = (at_least_flag(gap, -margin), greater_flag(gap), greater_flag(F.col(high)), greater_flag(F.col(low)))
    return draws.withColumns(dict(zip(DECISIONS, flags)))


def decision_probs(
    draws: DataFrame, high: str, low: str, margin: float = NONINFERIORITY_MARGIN, by: Sequence[str] = ()
) -> DataFrame:
    flagged = decision_flags(draws, high, low, margin)
    return flagged.groupBy(*by).agg(*[F.avg(c).alias(c) for c in DECISIONS])


def direction_prob(draws: DataFrame, coefficient: str, by: Sequence[str] = ()) -> DataFrame:
    """Probability that a coefficient is below zero."""
    return draws.groupBy(*by).agg(F.avg(less_flag(F.col(coefficient))).alias("p_below_zero"))


def _moment(fit: Fit, weights: Mapping[str, float]) -> tuple[Column, Column]:
    """Mean and standard deviation of a weighted sum of coefficients, per fit cell."""
    names = fit.formula.names
    p = len(names)
    at = {names.index(n): w for n, w in weights.items()}
    mean = sum((F.col("beta")[j] * w for j, w in at.items()), F.lit(0.0))
    var = sum(
        (F.col("cov")[j * p + k] * (v * w) for j, v in at.items() for k, w in at.items()), F.lit(0.0)
    )
    return mean, F.sqrt(var)


def decision_probs_from_fit(fit: Fit, high: str, low: str, margin: float = NONINFERIORITY_MARGIN) -> DataFrame:
    """The four probabilities without draws: normal tail areas weighted over the fit cells."""
    asks = (({low: 1.0, high: -1.0}, margin), ({low: 1.0, high: -1.0}, 0.0), ({high: 1.0}, 0.0), ({low: 1.0}, 0.0))
    table = fit.table
    for name, (weights, shift) in zip(DECISIONS, asks):
        mean, sd = _moment(fit, weights)
        table = table.withColumn(name, F.col("weight") * normal_cdf((mean + shift) / sd))
    return table.groupBy(*fit.by).agg(*[F.sum(c).alias(c) for c in DECISIONS])


def direction_prob_from_fit(fit: Fit, coefficient: str) -> DataFrame:
    mean, sd = _moment(fit, {coefficient: 1.0})
    weighed = fit.table.withColumn("_p", F.col("weight") * normal_cdf(-mean / sd))
    return weighed.groupBy(*fit.by).agg(F.sum("_p").alias("p_below_zero"))


def pool_probabilities(per_imp: DataFrame, columns: Sequence[str] = DECISIONS, by: Sequence[str] = ()) -> DataFrame:
    """Equal-weight mixture over imputations: the mean of the per-imputation probabilities."""
    return per_imp.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])


def pool_imputations(per_imp: DataFrame, by: Sequence[str] = ("coefficient",)) -> DataFrame:
    """Mixture mean and variance from one (estimate, sd) row per imputation."""
    e, s = F.col("estimate"), F.col("sd")
    return per_imp.groupBy(*by).agg(
        F.count("*").alias("n_imp"),
        F.avg(e).alias("pooled_mean"),
        F.avg(s * s).alias("within_var"),
        F.var_pop(e).alias("between_var"),
        F.sqrt(F.avg(s * s) + F.var_pop(e)).alias("pooled_sd"),
    )


def _melt(draws: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("coefficient"), F.col(c).cast("double").alias("value")) for c in columns]
    return draws.select(*by, F.explode(F.array(*cells)).alias("c")).select(*by, "c.coefficient", "c.value")


def posterior_summary(
    draws: DataFrame, columns: Sequence[str], by: Sequence[str] = (), range_rows: int | None = None
) -> DataFrame:
    """Mean, standard deviation and 95% interval per coefficient."""
    long = _melt(draws, columns, by)
    keys = [*by, "coefficient"]
    moments = long.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    ends = group_quantiles(long, keys, "value", {"lower": 0.025, "upper": 0.975}, "linear", range_rows)
    return moments.join(ends.drop("n_values"), keys)


def split_rhat(
    draws: DataFrame, columns: Sequence[str], chain: str = "chain", draw: str = "draw",
    range_rows: int | None = None,
) -> DataFrame:
    """Split-chain ratio of total to within-chain spread (1 = chains agree)."""
    numbered = number_rows(draws, [chain], [draw], "_no", range_rows)
    sizes = cut_lineage(
        draws.groupBy(chain).agg(F.floor(F.count("*") / 2).alias("_half"), F.count("*").alias("_len")),
        "chain-sizes",
    )
    no = F.col("_no")
    half = F.when(no <= F.col("_half"), 1).when(no > F.col("_len") - F.col("_half"), 2)
    halves = numbered.join(sizes, chain).withColumn("half", half)
    per = (
        _melt(halves.where(F.col("half").isNotNull()), columns, [chain, "half"])
        .groupBy("coefficient", chain, "half")
        .agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    )
    n, within = F.avg("n"), F.avg("v")
    return per.groupBy("coefficient").agg(
        F.sqrt(((n - 1) / n * within + F.var_samp("m")) / within).alias("rhat")
    )


def variance_ratio(
    predictions: DataFrame,
    draw: str,
    without: str,
    whole: str,
    range_rows: int | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Per draw the variance of predictions without cluster effects over that with them, then the
    mean, median and 95% interval over draws, per group."""
    ratios = predictions.groupBy(*by, draw).agg(F.try_divide(F.var_samp(without), F.var_samp(whole)).alias("ratio"))
    return summarise_ratios(ratios, by, range_rows)


def summarise_ratios(ratios: DataFrame, by: Sequence[str] = (), range_rows: int | None = None) -> DataFrame:
    """Mean, median and 95% interval of ``ratio`` over draws, per group."""
    per = cut_lineage(ratios, "ratios")
    mean = per.groupBy(*by).agg(F.count("ratio").alias("n_draws"), F.avg("ratio").alias("mean"))
    ends = group_quantiles(
        per, by, "ratio", {"median": 0.5, "lower": 0.025, "upper": 0.975}, "linear", range_rows
    )
    return mean.join(ends.withColumnRenamed("n_values", "n_draws"), [*by, "n_draws"])


def pair_label(a: str, b: str) -> str:
    return f"{b}-{a}"


def contrast_vectors(
    rows: DataFrame, formula: Formula, arms: Sequence[str], factor: str = "arm", by: Sequence[str] = ()
) -> DataFrame:
    """Mean design difference for each pair of arms: (by..., contrast, vec ARRAY).

    With an identity link the average difference of predictions is the difference of the mean
    design vectors times the coefficients, so rows x draws x arms never has to be formed.
    """
    names = formula.depends_on(factor)
    at = [formula.names.index(n) for n in names]
    means = []
    for arm in arms:
        xs = formula.columns(replace={factor: F.lit(arm)})
        means.append(F.array(*[F.avg(xs[j]) for j in at]).alias(f"_mean_{arm}"))
    one = rows.groupBy(*by).agg(*means)
    pairs = [
        F.struct(
            F.lit(pair_label(a, b)).alias("contrast"),
            F.zip_with(F.col(f"_mean_{b}"), F.col(f"_mean_{a}"), lambda x, y: x - y).alias("vec"),
        )
        for a, b in combinations(arms, 2)
    ]
    return one.select(*by, F.explode(F.array(*pairs)).alias("p")).select(*by, "p.contrast", "p.vec")


def pairwise_contrasts(
    draws: DataFrame,
    vectors: DataFrame,
    coefficients: Sequence[Column | str],
    by: Sequence[str] = (),
    keep: Sequence[str] = (),
    range_rows: int | None = None,
    match: Sequence[str] = (),
) -> DataFrame:
    """Median and 95% interval over draws for each contrast (and group of the vectors).

    ``coefficients`` are the draw columns in the order of the vectors; ``keep`` are further group
    columns of the draws. The vectors are one row per pair of arms and closed label. A draw meets the vectors
    that agree with it on ``match``, group columns of both.
    """
    cells = F.struct(*[F.col(b) for b in by], "contrast", "vec")
    if match:
        own = vectors.groupBy(*match).agg(F.collect_list(cells).alias("_v"))
        long = draws.join(own, list(match)).withColumn("_c", F.explode("_v")).drop("_v")
        keep = [*keep, *match]
    else:
        every = vectors.agg(F.collect_list(cells).alias("v")).scalar()
        long = draws.select("*", F.explode(every).alias("_c"))
    beta = [F.col(c) if isinstance(c, str) else c for c in coefficients]
    value = sum((F.col("_c.vec")[j] * b for j, b in enumerate(beta)), F.lit(0.0))
    named = long.select(
        *keep, *[F.col(f"_c.{b}").alias(b) for b in by], F.col("_c.contrast").alias("contrast"), value.alias("_value")
    )
    return group_quantiles(named, [*keep, *by, "contrast"], "_value", INTERVAL, "linear", range_rows)
