"""Interim, two-stage and sensitivity re-analyses.

One parametrised chain: choose clusters, assign arms in stratified blocks, replace the outcome by
the prediction where the arm changed, fit per imputation, pool. The caller compares the reported
probabilities with whatever stopping threshold applies.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions.recode import in_list, not_in_list, recode_member, substitute_outcome
from trialweave.operators.cohort import (
    assign_blocks,
    block_arm,
    enrolment_rank,
    representative_units,
)
from trialweave.operators.decide import (
    contrast_vectors,
    decision_probs_from_fit,
    direction_prob_from_fit,
    pairwise_contrasts,
    pool_probabilities,
    summarise_ratios,
)
from trialweave.operators.impute import impute_pmm, screened_predictors
from trialweave.operators.joins import (
    attach,
    attach_new_arm,
    drop_listed,
    keep_listed,
    predictions_matched,
)
from trialweave.operators.model import (
    Fit,
    Formula,
    Priors,
    centring,
    default_priors,
    draws_from_fit,
    fit_from_sums,
    fit_random_intercept,
)
from trialweave.operators.predict import Predictor, imputed_rows, imputed_size_sums, variance_shares
from trialweave.operators.reshape import union_strict
from trialweave.schema import ARMS, ASSIGNMENT_SEED, CONTROL_ARM, FIT_SEED
from trialweave.session import cut_lineage

STRATA = ("remoteness", "stype")


def up_to_cluster(units: DataFrame, cut: int) -> DataFrame:
    """The clusters enrolled first."""
    return units.where(F.col("cluster_id") <= cut)


def choose_clusters(
    units: DataFrame,
    ids: Iterable[int] | DataFrame,
    keep: bool = True,
    hot: Sequence | None = None,
) -> DataFrame:
    """Units of the listed clusters, or (``keep=False``) of all others, missing ids included.

    A short list becomes a filter; a table of ids a semi or anti join.
    """
    if isinstance(ids, DataFrame):
        pick = keep_listed if keep else drop_listed
        return pick(units, ids, "cluster_id", ["unit_id"], hot)
    ids = list(ids)
    return units.where(in_list("cluster_id", ids) if keep else not_in_list("cluster_id", ids))


def stage_data(
    units: DataFrame,
    preds: DataFrame,
    arms: Sequence[str] = ARMS,
    strata: Sequence[str] = STRATA,
    seed: int = ASSIGNMENT_SEED,
    independent_strata: bool = False,
    hot: Sequence | None = None,
    strata_from: DataFrame | None = None,
) -> DataFrame:
    """Re-assigned units with predictions, one row per unit and imputation.

    Clusters without a stratum get no arm and their units drop out at the join to the predictions.
    ``strata_from`` is a cheaper table of the same units to read the strata from, when the unit
    table carries joins the strata do not need.
    """
    source = units if strata_from is None else strata_from
    assigned = assigned_clusters(source, arms, strata, seed, independent_strata)
    return with_predictions(units, assigned, preds, hot)


def assigned_clusters(
    units: DataFrame, arms: Sequence[str], strata: Sequence[str], seed: int, independent_strata: bool = False
) -> DataFrame:
    """(cluster_id, treatment): the clusters of the units, assigned in blocks."""
    first = representative_units(units.select("unit_id", "cluster_id", *strata))
    clusters = cut_lineage(first.drop("unit_id"), "clusters")  # one row per cluster, read twice
    return assign_blocks(clusters, strata, arms, seed, "cluster_id", independent_strata).select("cluster_id", "treatment")


def with_predictions(
    units: DataFrame, assigned: DataFrame, preds: DataFrame, hot: Sequence | None = None
) -> DataFrame:
    """The units under their new arms, with the outcome predicted where the arm changed."""
    placed = attach_new_arm(units, assigned, hot=hot)
    return predictions_matched(placed, preds).withColumn(
        "outcome", substitute_outcome("outcome", "old_arm", "arm", "pred")
    )


def two_stage_data(
    first: DataFrame,
    second: DataFrame,
    preds: DataFrame,
    first_arms: Sequence[str] = ARMS,
    second_arms: Sequence[str] = tuple(a for a in ARMS if a != CONTROL_ARM),
    strata: Sequence[str] = STRATA,
    seed: int = ASSIGNMENT_SEED,
    hot: Sequence | None = None,
) -> DataFrame:
    """A first stage with all arms and a second stage, on other clusters, with an arm dropped."""
    one = assigned_clusters(first, first_arms, strata, seed)
    two = assigned_clusters(second, second_arms, strata, seed)
    return with_predictions(union_strict(first, second), union_strict(one, two), preds, hot)


def place(units: DataFrame, assigned: DataFrame, predictor: Predictor, hot: Sequence | None = None) -> DataFrame:
    """The units under their new arms, with ``old_arm`` and their cluster's ``effects``: one join by cluster.

    Units of clusters without an arm leave; so do, as they have no prediction, units with a missing predictor.
    """
    keyed = predictor.effects(assigned.withColumnRenamed("treatment", "arm"))
    placed = attach(units.withColumnRenamed("arm", "old_arm"), keyed, "cluster_id", ["unit_id"], "inner", hot, deal=True)
    return placed.where(~F.exists(predictor.design(), lambda x: x.isNull()))


@dataclass(frozen=True)
class Analysis:
    """A fitted re-analysis; probabilities and contrasts are worked out when asked for.

    ``design`` holds the rows that contrasts are averaged over, where ``data`` has them once per imputation.
    """

    data: DataFrame
    fit: Fit
    arms: Sequence[str] = ARMS
    ndraws: int = 1000
    seed: int = FIT_SEED
    design: DataFrame | None = None

    @property
    def _looks(self) -> list[str]:
        return [c for c in self.fit.by if c != "imp"]

    def decisions(self) -> DataFrame:
        """The four decision probabilities, averaged over the imputations."""
        return pool_probabilities(decision_probs_from_fit(self.fit, "arm_H", "arm_L"), by=self._looks)

    def contrasts(self) -> DataFrame:
        """Average difference for each pair of arms over the draws of all imputations."""
        formula, looks = self.fit.formula, self._looks
        vectors = contrast_vectors(self.data if self.design is None else self.design, formula, self.arms, by=looks)
        at = [formula.names.index(n) for n in formula.depends_on("arm")]
        draws = draws_from_fit(self.fit, self.ndraws, self.seed)
        return pairwise_contrasts(draws, vectors, [F.col("beta")[j] for j in at], match=looks)


def analyse_placed(
    placed: DataFrame,
    predictor: Predictor,
    formula: Formula,
    arms: Sequence[str] = ARMS,
    ndraws: int = 1000,
    priors: Priors | None = None,
    cuts: Sequence[int] = (),
) -> Analysis:
    """Fit the imputed outcomes of ``place`` for each draw, from sums: no row is copied per draw.

    With ``cuts`` there is a fit per look (1, 2, ...: clusters up to the first, second, ... cut) and draw. The
    arms of the clusters do not depend on the cut, so a cluster's sums count in its first look and all later ones.
    """
    centre = centring(placed, formula)
    part = sum(((F.col("cluster_id") > c).cast("int") for c in sorted(cuts)), F.lit(0)) if cuts else None
    sums = cut_lineage(imputed_size_sums(placed, predictor, formula, centre, part, max(len(cuts), 1)), "size-sums")
    by = ["look", "imp"] if cuts else ["imp"]
    fit = fit_from_sums(sums, formula, by, centre, _at_mean(priors, sums, centre[formula.outcome], formula))
    design = placed.select("*", *_looks_of(len(cuts), part)) if cuts else placed
    return Analysis(imputed_rows(placed, predictor), fit, arms, ndraws, design=design)


def _looks_of(n: int, part: Column | str = "part") -> list[Column]:
    """The looks that a part counts in: its own and all later ones."""
    first = (F.col(part) if isinstance(part, str) else part) + 1
    return [F.explode(F.sequence(first.cast("int"), F.lit(n))).alias("look")]


def _at_mean(priors: Priors | None, sums: DataFrame, centre: float, formula: Formula) -> Priors:
    """Priors with the intercept's at the mean of all imputed outcomes, unless it is set."""
    priors = priors or Priors()
    if priors.intercept_mean is not None:
        return priors
    p = len(formula.names)
    t = F.col("v")[p - 1 + p * (p - 1) // 2]  # behind the design's sums and their products
    mean = sums.where("n > 0").agg(F.sum(t) / F.sum(F.col("n") * F.col("n_clusters"))).first()[0]
    return replace(priors, intercept_mean=centre + (mean or 0.0))


def analyse(
    data: DataFrame,
    formula: Formula,
    by: Sequence[str] = ("imp",),
    arms: Sequence[str] = ARMS,
    ndraws: int = 1000,
    priors: Priors | None = None,
    seed: int = FIT_SEED,
) -> Analysis:
    """Fit the outcome model, separately per imputation unless ``by`` is empty."""
    fit = fit_random_intercept(data, formula, by, priors)
    return Analysis(data, fit, arms, ndraws, seed)


def interim_analysis(
    units: DataFrame,
    preds: DataFrame | Predictor,
    formula: Formula,
    cut: int | None = None,
    ids: Iterable[int] | DataFrame | None = None,
    arms: Sequence[str] = ARMS,
    strata: Sequence[str] = STRATA,
    seed: int = ASSIGNMENT_SEED,
    ndraws: int = 1000,
    priors: Priors | None = None,
    hot: Sequence | None = None,
) -> Analysis:
    """What the trial would have shown had it stopped after the chosen clusters.

    Predictions are a table, or a ``Predictor`` that works them out where an arm changed.
    """
    if (cut is None) == (ids is None):
        raise ValueError("choose the clusters either by a cut or by a list")
    chosen = up_to_cluster(units, cut) if cut is not None else choose_clusters(units, ids, hot=hot)
    if isinstance(preds, Predictor):
        placed = place(chosen, assigned_clusters(chosen, arms, strata, seed), preds, hot)
        return analyse_placed(cut_lineage(placed, "placed"), preds, formula, arms, ndraws, priors)
    data = cut_lineage(stage_data(chosen, preds, arms, strata, seed, hot=hot), "interim")
    return analyse(data, formula, ("imp",), arms, ndraws, priors)


def interim_looks(
    units: DataFrame,
    predictor: Predictor,
    formula: Formula,
    cuts: Sequence[int],
    arms: Sequence[str] = ARMS,
    strata: Sequence[str] = STRATA,
    seed: int = ASSIGNMENT_SEED,
    ndraws: int = 1000,
    priors: Priors | None = None,
    hot: Sequence | None = None,
) -> Analysis:
    """``interim_analysis`` at several cuts in one pass; results have a column ``look`` = 1, 2, ... by ascending cut."""
    chosen = up_to_cluster(units, max(cuts))
    placed = place(chosen, assigned_clusters(chosen, arms, strata, seed), predictor, hot)
    return analyse_placed(cut_lineage(placed, "placed"), predictor, formula, arms, ndraws, priors, sorted(cuts))


def look_sums(placed: DataFrame, cuts: Sequence[int], outcome: str = "outcome") -> DataFrame:
    """What each look holds: (look, arm, n_clusters, n_units, n_outcome, n_changed, sum_seen), from sums per cluster.

    ``n_changed`` counts observed outcomes that are replaced, ``sum_seen`` adds up those that are not.
    """
    cuts = sorted(cuts)
    y, same = F.col(outcome), F.col("arm") == F.col("old_arm")
    per = placed.groupBy("cluster_id", "arm").agg(
        F.count("*").alias("n_units"),
        F.count(y).alias("n_outcome"),
        F.count_if(y.isNotNull() & ~same).alias("n_changed"),
        F.sum(F.when(same, y)).alias("sum_seen"),
    )
    part = sum(((F.col("cluster_id") > c).cast("int") for c in cuts), F.lit(0))
    steps = per.groupBy(part.alias("part"), "arm").agg(
        F.count("*").alias("n_clusters"), *[F.sum(c).alias(c) for c in ("n_units", "n_outcome", "n_changed", "sum_seen")]
    )
    every = steps.select(*_looks_of(len(cuts)), *[c for c in steps.columns if c != "part"])
    return every.groupBy("look", "arm").agg(
        *[F.sum(c).alias(c) for c in ("n_clusters", "n_units", "n_outcome", "n_changed", "sum_seen")]
    )


def two_stage_analysis(
    units: DataFrame,
    preds: DataFrame | Predictor,
    formula: Formula,
    first_ids: Iterable[int] | DataFrame,
    second_ids: Iterable[int] | DataFrame | None = None,
    dropped_arm: str = CONTROL_ARM,
    strata: Sequence[str] = STRATA,
    seed: int = ASSIGNMENT_SEED,
    ndraws: int = 1000,
    priors: Priors | None = None,
    hot: Sequence | None = None,
) -> Analysis:
    """Both stages and the analysis of their union; the second stage is a list or the rest."""
    first = choose_clusters(units, first_ids, hot=hot)
    second = (
        choose_clusters(units, first_ids, False, hot)
        if second_ids is None
        else choose_clusters(units, second_ids, hot=hot)
    )
    rest = tuple(a for a in ARMS if a != dropped_arm)
    if isinstance(preds, Predictor):
        one, two = assigned_clusters(first, ARMS, strata, seed), assigned_clusters(second, rest, strata, seed)
        placed = place(union_strict(first, second), union_strict(one, two), preds, hot)
        return analyse_placed(cut_lineage(placed, "placed"), preds, formula, ARMS, ndraws, priors)
    data = cut_lineage(
        two_stage_data(first, second, preds, ARMS, rest, strata, seed, hot), "two-stage"
    )
    return analyse(data, formula, ("imp",), ARMS, ndraws, priors)


def counterfactual_predictions(
    imputed: DataFrame,
    fit: Fit,
    ndraws: int = 100,
    seed: int = FIT_SEED,
    arms: Sequence[str] = ARMS,
    hot: Sequence | None = None,
) -> DataFrame:
    """Predictions of every unit under every arm, one set per posterior draw (as ``imp``).

    The fit is one without groups, as the model of a single imputation is. Units with a missing predictor
    have no prediction and no row; ``incomplete_rows`` counts them. Re-analyses take a ``Predictor`` instead.
    """
    return Predictor.of_fit(fit, ndraws, seed).table(imputed, arms, hot=hot)


def variance_decomposition(
    rows: DataFrame,
    draws: DataFrame,
    formula: Formula,
    cluster_means: DataFrame,
    by: Sequence[str] = (),
    seed: int = FIT_SEED,
    noise: bool = True,
) -> DataFrame:
    """Share of the predictive variance that is left without the cluster effects, per group, over draws."""
    return summarise_ratios(variance_shares(rows, draws, formula, cluster_means, by, seed, noise), by)


def variance_from_fit(
    rows: DataFrame,
    formula: Formula,
    by: Sequence[str] = (),
    ndraws: int = 1000,
    priors: Priors | None = None,
    seed: int = FIT_SEED,
) -> DataFrame:
    """``variance_decomposition`` of a fit per group, such as one for each cohort."""
    fit = fit_random_intercept(rows, formula, by, priors)
    return variance_decomposition(rows, draws_from_fit(fit, ndraws, seed), formula, fit.cluster_means, by, seed)


@dataclass(frozen=True)
class Prepared:
    """What every re-analysis starts from: imputed units, their fit, and what predicts from it."""

    units: DataFrame
    main: Analysis
    ndraws: int = 100
    seed: int = FIT_SEED
    hot: Sequence | None = None

    @cached_property
    def predictor(self) -> Predictor:
        return Predictor.of_fit(self.main.fit, self.ndraws, self.seed)

    @cached_property
    def predictions(self) -> DataFrame:
        """Every unit under every arm and draw; not needed by the re-analyses, and not written."""
        return self.predictor.table(self.units, ARMS, hot=self.hot)


def prepare(
    units: DataFrame,
    formula: Formula,
    factors: dict[str, Sequence[str]],
    numeric: Sequence[str] = (),
    mincor: float = 0.1,
    ndraws: int = 100,
    seed: int = FIT_SEED,
    priors: Priors | None = None,
    hot: Sequence | None = None,
) -> Prepared:
    """Impute missing baselines once and fit; predictions are worked out when asked for.

    ``factors`` and ``numeric`` are the candidate predictors of the baseline; those correlated with it or
    with its missingness are used. Where none is, every observed baseline is an equally likely donor.
    """
    used, plain = screened_predictors(units, "baseline", factors, numeric, mincor)
    imputed = cut_lineage(impute_pmm(units, "baseline", used, plain, seed=seed), "imputed")
    main = analyse(imputed, formula, (), priors=priors, seed=seed)
    return Prepared(imputed.drop("imp"), main, ndraws, seed, hot)


def main_analysis(
    units: DataFrame,
    formula: Formula,
    factors: dict[str, Sequence[str]],
    numeric: Sequence[str] = (),
    mincor: float = 0.1,
    ndraws: int = 100,
    seed: int = FIT_SEED,
    priors: Priors | None = None,
    hot: Sequence | None = None,
) -> tuple[Analysis, DataFrame]:
    """The fit on the imputed units and the predictions that follow from it, unwritten."""
    ready = prepare(units, formula, factors, numeric, mincor, ndraws, seed, priors, hot)
    return ready.main, ready.predictions


def seed_pipeline(
    units: DataFrame,
    formula: Formula,
    factors: dict[str, Sequence[str]],
    seeds: Sequence[int],
    numeric: Sequence[str] = (),
    mincor: float = 0.1,
    ndraws: int = 1000,
    fit_seed: int = FIT_SEED,
    priors: Priors | None = None,
    proper: bool = False,
) -> Analysis:
    """Imputation, fit and draws under several seeds side by side: one job, results with a column ``seed``.

    A seed's donors are those it has alone, and its draws have a stream of their own.
    """
    used, plain = screened_predictors(units, "baseline", factors, numeric, mincor)
    made = impute_pmm(units, "baseline", used, plain, proper=proper, seeds=seeds)
    return analyse(cut_lineage(made, "imputed"), formula, ("seed",), ndraws=ndraws, priors=priors, seed=fit_seed)


def exclusion_sensitivity(
    units: DataFrame,
    excluded: Iterable[int] | DataFrame,
    formula: Formula,
    factors: dict[str, Sequence[str]],
    numeric: Sequence[str] = (),
    mincor: float = 0.1,
    ndraws: int = 10,
    seed: int = FIT_SEED,
    priors: Priors | None = None,
    hot: Sequence | None = None,
) -> tuple[Analysis, DataFrame]:
    """The main analysis without the listed clusters."""
    kept = cut_lineage(choose_clusters(units, excluded, False, hot), "kept")
    return main_analysis(kept, formula, factors, numeric, mincor, ndraws, seed, priors, hot)


def within_arm_data(
    imputed: DataFrame,
    first_ids: Iterable[int] | DataFrame,
    arm: str = "H",
    hot: Sequence | None = None,
) -> DataFrame:
    """One arm only, labelled by the source trial of the cluster (listed ids: the first trial)."""
    rows = imputed.where(F.col("arm") == arm)
    if not isinstance(first_ids, DataFrame):
        return rows.withColumn("trial", recode_member("cluster_id", first_ids, "Sup", "Noninf"))
    listed = first_ids.select("cluster_id").distinct().withColumn("trial", F.lit("Sup"))
    marked = attach(rows, listed, "cluster_id", ["unit_id"], "left", hot)
    return marked.withColumn("trial", F.coalesce("trial", F.lit("Noninf")))


def within_arm_comparison(
    data: DataFrame, formula: Formula, ndraws: int = 1000, seed: int = FIT_SEED,
    priors: Priors | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Contrast of the two source trials inside one arm: direction probability and interval.

    Without given priors they follow the data: flat coefficients, scales of the outcome's spread.
    """
    priors = priors or default_priors(data, formula.outcome)
    fit = fit_random_intercept(data, formula, (), priors)
    levels = formula.factors["trial"]
    coefficient = f"trial_{levels[1]}"
    draws = draws_from_fit(fit, ndraws, seed)
    vectors = contrast_vectors(data, formula, levels, factor="trial")
    at = [formula.names.index(n) for n in formula.depends_on("trial")]
    return (
        direction_prob_from_fit(fit, coefficient),
        pairwise_contrasts(draws, vectors, [F.col("beta")[j] for j in at]),
    )


def seed_comparison(
    clusters: DataFrame, seeds: Sequence[int], strata: Sequence[str] = STRATA, arms: Sequence[str] = ARMS
) -> DataFrame:
    """Assignments under several seeds in one table; the enrolment order is computed once."""
    ranked = enrolment_rank(clusters, strata)
    each = [
        F.struct(F.lit(s).alias("seed"), block_arm(F.col("rownumber"), arms, s).alias("treatment"))
        for s in seeds
    ]
    return ranked.select("*", F.explode(F.array(*each)).alias("s")).select(
        *ranked.columns, "s.seed", "s.treatment"
    )
