"""Registered queries: each operator on the bound test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.bindings import IMPUTATIONS, SEGMENTS, SES, Views
from trialweave.functions.recode import (
    cohort_flag,
    id_number,
    level_index,
    not_in_list,
    recode_equal,
    recode_member,
    recode_threshold,
    substitute_outcome,
    with_levels,
)
from trialweave.operators import (
    cohort,
    decide,
    describe,
    hypothesis,
    impute,
    joins,
    model,
    ranges,
    reshape,
    sketch,
)
from trialweave.plans import harmonise, interim
from trialweave.schema import ARMS, FIT_SEED, SENSITIVITY_SEED
from trialweave.session import cut_lineage, fresh_path
from trialweave.sources import tables
from trialweave.sources.sums import SumStore

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

STRATA = ("remoteness", "stype")
SEED = 1
EXCLUDED_DECILES = (2, 4)


def query(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    REGISTRY[fn.__name__] = lambda spark, folder: fn(Views(spark, folder))
    return fn


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# Sources and sinks


@query
def q_csv_roundtrip(v: Views) -> DataFrame:
    clusters = v.clusters
    path = fresh_path(v.spark, "clusters-csv")
    tables.write_units_csv(clusters, path)
    return tables.read_units_csv(v.spark, path, clusters.schema)


@query
def q_stage_roundtrip(v: Views) -> DataFrame:
    path = fresh_path(v.spark, "predictions")
    tables.save_table(v.preds, path, ["imp"])
    kept = tables.load_table(v.spark, path)
    return kept.groupBy("imp", "arm").agg(F.count("*").alias("n"), F.sum("pred").alias("sum_pred"))


@query
def q_csv_quarantine(v: Views) -> DataFrame:
    """What cannot be read in files with broken lines and fields, one of them with its columns in another order."""
    c = v.clusters
    key = F.col("cluster_id")
    decile = F.when(key % 13 == 0, "n/a").otherwise(F.coalesce(F.col("decile").cast("string"), F.lit("NA")))
    name = F.concat(F.lit('"'), "stype", F.lit(', "" "'))
    number = F.when(key % 11 == 0, F.concat(F.lit("x"), key.cast("string"))).otherwise(key.cast("string"))
    tail = F.when(key % 29 == 0, ",surplus").otherwise("")
    path = fresh_path(v.spark, "broken-csv")
    for part, header, cells in (
        ("a", "cluster_id,decile,stype", (number, decile, name)),
        ("b", "decile,stype,cluster_id", (decile, name, number)),
    ):
        own = c.where((key % 2 == 0) if part == "a" else (key % 2 == 1))
        lines = own.select(F.concat(F.concat_ws(",", *cells), tail).alias(header))
        lines.write.option("header", True).option("sep", "\u0001").option("escapeQuotes", False).csv(f"{path}/{part}")
    schema = c.select("cluster_id", "decile", "stype").schema
    read = tables.read_checked_csv(v.spark, f"{path}/*", schema)
    fields = read.counts.groupBy("column_name").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_unreadable").alias("n_bad"))
    lines = read.quarantine.agg(F.lit("(line)").alias("column_name"), F.lit(0).cast("long").alias("n_rows"), F.count("*").alias("n_bad"))
    good = read.rows.agg(F.lit("(stype)").alias("column_name"), F.count("stype").alias("n_rows"), F.count_if(F.col("stype").endswith(', " ')).alias("n_bad"))
    return fields.unionByName(lines).unionByName(good)


# Recodes and filters


@query
def q_recode_threshold(v: Views) -> DataFrame:
    return v.clusters.select("cluster_id", recode_threshold("decile", 6, "Most", "Least").alias("ses"))


@query
def q_recode_member(v: Views) -> DataFrame:
    label = F.nullif("stype", F.lit("BUILDING"))
    return v.clusters.select(
        "cluster_id", recode_member(label, ["MACHINERY", "FURNITURE"], "listed", "other").alias("label")
    )


@query
def q_recode_equal(v: Views) -> DataFrame:
    label = F.nullif("stype", F.lit("BUILDING"))
    return v.clusters.select("cluster_id", recode_equal(label, "MACHINERY", "yes", "no").alias("label"))


@query
def q_levels(v: Views) -> DataFrame:
    levels = [s for s in reversed(SEGMENTS) if s != "BUILDING"]
    label = with_levels("stype", levels)
    return (
        v.clusters.groupBy(label.alias("level"), level_index(label, levels).alias("level_no"))
        .agg(F.count("*").alias("n"))
    )


def _text_id() -> Column:
    key = F.col("cluster_id")
    return F.when(key % 13 == 0, F.concat(F.lit("x"), key.cast("string"))).otherwise(key.cast("string"))


@query
def q_cohort_flag(v: Views) -> DataFrame:
    return v.clusters.select(
        "cluster_id", cohort_flag(_text_id(), v.share_of_clusters(62)).alias("cohort")
    )


@query
def q_id_cast(v: Views) -> DataFrame:
    return v.clusters.select("cluster_id", id_number(_text_id()).alias("id_no"))


@query
def q_filter_conj(v: Views) -> DataFrame:
    return v.clusters.where((F.col("remoteness") == "Major Cities") & (F.col("stype") == "MACHINERY"))


@query
def q_interim_cut(v: Views) -> DataFrame:
    return interim.up_to_cluster(v.units, v.share_of_clusters(56)).select(
        "unit_id", "cluster_id", "arm", "outcome"
    )


@query
def q_filter_in(v: Views) -> DataFrame:
    ids = v.clusters.where(F.col("decile").isin(*EXCLUDED_DECILES)).select("cluster_id")
    kept = joins.keep_listed(v.bare_units, ids, "cluster_id", ["unit_id"], v.hot_clusters)
    return kept.select("unit_id", "cluster_id")


@query
def q_filter_not_in(v: Views) -> DataFrame:
    ids = v.clusters.where(F.col("decile") == 7).select("cluster_id")
    rest = v.bare_units.where(not_in_list("decile", EXCLUDED_DECILES))
    kept = joins.drop_listed(rest, ids, "cluster_id", ["unit_id"], v.hot_clusters)
    return kept.select("unit_id", "cluster_id", "decile")


@query
def q_case_when(v: Views) -> DataFrame:
    return decide.decision_flags(v.draws, "b_h", "b_l").select("draw", *decide.DECISIONS)


# Joins


@query
def q_left_join(v: Views) -> DataFrame:
    units = v.table("orders").select(F.col("o_orderkey").alias("unit"))
    return joins.left_join(units, v.measured, "unit", "unit_id")


@query
def q_slot_join(v: Views) -> DataFrame:
    clusters = v.clusters
    ranked = cohort.enrolment_rank(clusters, STRATA).select("cluster_id", *STRATA, "rownumber")
    slots = ranges.number_rows(clusters.select("cluster_id"), [], ["cluster_id"]).select("rownumber")
    return joins.slot_join(ranked, cohort.block_schedule(slots, ARMS, SEED))


@query
def q_reallocate(v: Views) -> DataFrame:
    assigned = cohort.assign_blocks(v.clusters, STRATA, ARMS, SEED)
    placed = joins.attach_new_arm(v.bare_units, assigned, keep_old="old_arm", hot=v.hot_clusters)
    return placed.select("unit_id", "cluster_id", "old_arm", "arm")


@query
def q_right_join(v: Views) -> DataFrame:
    first = interim.up_to_cluster(v.bare_units, v.share_of_clusters(56)).select(
        "unit_id", "arm", "cluster_id"
    )
    return joins.predictions_right(first, v.preds)


@query
def q_pred_join(v: Views) -> DataFrame:
    first = interim.up_to_cluster(v.bare_units, v.share_of_clusters(56)).select(
        "unit_id", "arm", "cluster_id"
    )
    return joins.predictions_matched(first, v.preds)


@query
def q_unassigned(v: Views) -> DataFrame:
    """Units whose cluster has no stratum get no arm; they are counted."""
    assigned = cohort.assign_blocks(v.clusters, ("remoteness", "decile"), ARMS, SEED)
    placed = joins.attach_new_arm(v.bare_units, assigned, hot=v.hot_clusters)
    return joins.count_unassigned(placed)


# Descriptive tables and tests


def _representatives(v: Views) -> DataFrame:
    """One unit per cluster, with the cluster mean of the baseline."""
    units = describe.group_mean(
        v.units, "cluster_id", "baseline", "base_pa", ["unit_id"], v.hot_clusters
    )
    return cut_lineage(cohort.representative_units(units), "representatives")


@query
def q_cluster_mean(v: Views) -> DataFrame:
    out = describe.group_mean(
        v.units, "cluster_id", "baseline", "base_pa", ["unit_id"], v.hot_clusters
    )
    return rounded(out.select("unit_id", "cluster_id", "base_pa"), "base_pa", digits=9)


@query
def q_tbl_categorical(v: Views) -> DataFrame:
    out = describe.summarise_categorical(_representatives(v), ["arm"], ["stype", "ses", "remoteness"])
    return rounded(out, "pct")


@query
def q_tbl_continuous(v: Views) -> DataFrame:
    out = describe.summarise_continuous(_representatives(v), ["arm"], ["base_pa", "baseline"])
    return rounded(out, "q1", "median", "q3", digits=10)


@query
def q_tbl_missing(v: Views) -> DataFrame:
    return describe.summarise_missing(
        _representatives(v), ["arm"], ["stype", "ses", "remoteness", "base_pa", "baseline"]
    )


@query
def q_tbl_strata(v: Views) -> DataFrame:
    out = describe.summarise_strata(
        _representatives(v), ["cohort"], ["arm"], ["stype", "ses", "remoteness"], ["base_pa"]
    )
    return rounded(out, "value", digits=10)


@query
def q_test_chisq(v: Views) -> DataFrame:
    reps = _representatives(v)
    parts = [hypothesis.chi_square(reps, "cohort", x, p_value=False) for x in ("stype", "ses", "remoteness")]
    return rounded(reshape.union_strict(*parts), "statistic", "min_expected")


@query
def q_test_ranksum(v: Views) -> DataFrame:
    units = cut_lineage(v.units.select("cohort", "baseline", "outcome", "decile"), "measured-units")
    parts = [
        hypothesis.rank_sum(units, "cohort", x, (1, 0), p_value=False)
        for x in ("baseline", "outcome", "decile")
    ]
    return rounded(reshape.union_strict(*parts), "w", "tie_term", "z")


@query
def q_test_fisher(v: Views) -> DataFrame:
    reps = _representatives(v)
    parts = [
        hypothesis.fisher_2x2(reps, "cohort", x, (1, 0), levels)
        for x, levels in (("ses", ("Most", "Least")), ("remoteness", ("Major Cities", "Regional/Remote")))
    ]
    return rounded(reshape.union_strict(*parts), "p_value")


@query
def q_compare_groups(v: Views) -> DataFrame:
    """Baseline comparison with the chosen test and its p-value per variable."""
    return hypothesis.compare_groups(
        _representatives(v),
        "cohort",
        (1, 0),
        {"stype": SEGMENTS, "ses": SES, "remoteness": ("Major Cities", "Regional/Remote")},
        ("base_pa",),
    )


@query
def q_compare_tests(v: Views) -> DataFrame:
    """The chosen test and its statistic per variable, without p-values."""
    return rounded(q_compare_groups(v).drop("p_value"), "statistic")


def _coded(v: Views) -> DataFrame:
    return v.units.select(
        "baseline",
        "outcome",
        "cohort",
        "decile",
        level_index("arm", ARMS).alias("arm_no"),
        level_index("stype", SEGMENTS).alias("stype_no"),
        level_index("ses", SES).alias("ses_no"),
        level_index("remoteness", ("Major Cities", "Regional/Remote")).alias("remoteness_no"),
        (F.col("baseline") * 2 + 1).alias("baseline_scaled"),
        F.lit(7).alias("fixed"),
    )


@query
def q_select_predictors(v: Views) -> DataFrame:
    out = impute.select_predictors(
        _coded(v),
        "baseline",
        ["baseline_scaled", "outcome", "cohort", "decile", "arm_no", "stype_no", "ses_no", "remoteness_no"],
    )
    return rounded(out, "cor_value", "cor_missing")


@query
def q_audit_columns(v: Views) -> DataFrame:
    out = impute.audit_columns(
        _coded(v), ["baseline", "baseline_scaled", "fixed", "cohort", "decile", "stype_no"]
    )
    return rounded(out, "correlation")


# Draws


@query
def q_decision_probs(v: Views) -> DataFrame:
    return rounded(decide.decision_probs(v.draws, "b_h", "b_l"), *decide.DECISIONS)


@query
def q_direction_prob(v: Views) -> DataFrame:
    return rounded(decide.direction_prob(v.draws, "b_h", ["imp"]), "p_below_zero")


@query
def q_posterior_summary(v: Views) -> DataFrame:
    out = decide.posterior_summary(v.draws, ["b_h", "b_l"], ["imp"])
    return rounded(rounded(out, "mean", "sd"), "lower", "upper", digits=9)


@query
def q_posterior_summary_ranges(v: Views) -> DataFrame:
    """The same summary by range-wise selection, as used for draws beyond one task."""
    out = decide.posterior_summary(v.draws, ["b_h", "b_l"], ["imp"], range_rows=50)
    return rounded(rounded(out, "mean", "sd"), "lower", "upper", digits=9)


@query
def q_split_rhat(v: Views) -> DataFrame:
    return rounded(decide.split_rhat(v.draws, ["b_h", "b_l"]), "rhat")


@query
def q_variance_ratio(v: Views) -> DataFrame:
    draw = (F.col("unit_id") % 40).alias("draw")
    rows = v.units.select(draw, F.col("outcome").alias("whole"), (F.col("baseline") / 2).alias("without"))
    out = decide.variance_ratio(rows, "draw", "without", "whole")
    return rounded(out, "mean", "median", "lower", "upper")


@query
def q_pool(v: Views) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("coefficient"), F.col(c).alias("value")) for c in ("b_h", "b_l")]
    per_imp = (
        v.draws.select("imp", F.explode(F.array(*cells)).alias("c"))
        .groupBy("imp", "c.coefficient")
        .agg(F.avg("c.value").alias("estimate"), F.stddev_samp("c.value").alias("sd"))
    )
    out = decide.pool_imputations(per_imp)
    return rounded(out, "pooled_mean", "within_var", "between_var", "pooled_sd")


@query
def q_contrasts(v: Views) -> DataFrame:
    formula = model.Formula("outcome", "cluster_id", {"arm": ARMS})
    vectors = decide.contrast_vectors(v.bare_units, formula, ARMS)
    out = decide.pairwise_contrasts(v.draws, vectors, ["b_h", "b_l"])
    return rounded(out, "estimate", "lower", "upper", digits=9)


@query
def q_contrasts_by(v: Views) -> DataFrame:
    levels = ("Major Cities", "Regional/Remote")
    formula = model.Formula(
        "outcome", "cluster_id", {"arm": ARMS, "remoteness": levels}, interactions=[("arm", "remoteness")]
    )
    vectors = decide.contrast_vectors(v.bare_units, formula, ARMS, by=["remoteness"])
    out = decide.pairwise_contrasts(
        v.draws,
        vectors,
        ["b_h", "b_l", F.col("b_l") / 2, F.col("b_h") / 4],
        by=["remoteness"],
    )
    return rounded(out, "estimate", "lower", "upper", digits=9)


@query
def q_icc(v: Views) -> DataFrame:
    out = describe.icc(v.units, "outcome", "cluster_id", ["cohort"])
    return rounded(out, "ms_between", "ms_within", "icc")


# Order


@query
def q_first_per_unit(v: Views) -> DataFrame:
    rows = v.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    return cohort.first_row(
        rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    )


@query
def q_first_per_cluster(v: Views) -> DataFrame:
    return cohort.representative_units(v.units).select("cluster_id", "unit_id", "arm", "baseline")


@query
def q_enrolment_rank(v: Views) -> DataFrame:
    return cohort.enrolment_rank(v.clusters, STRATA).select("cluster_id", *STRATA, "rownumber")


@query
def q_enrolment_rank_ranges(v: Views) -> DataFrame:
    """The same numbering by ranges, as used for strata beyond one task."""
    numbered = ranges.number_rows(v.clusters, STRATA, ["cluster_id"], range_rows=50)
    return numbered.select("cluster_id", *STRATA, "rownumber")


@query
def q_sort(v: Views) -> DataFrame:
    return v.clusters.select("cluster_id", "decile").orderBy(
        F.col("decile").asc_nulls_last(), F.col("cluster_id").asc_nulls_last()
    )


# Reshape


@query
def q_union_fill(v: Views) -> DataFrame:
    a = v.clusters.select("cluster_id", "decile")
    b = v.clusters.select("cluster_id", "stype")
    return reshape.union_fill(a, b)


@query
def q_stage_union(v: Views) -> DataFrame:
    cut = v.share_of_clusters(56)
    early = v.clusters.where(F.col("cluster_id") <= cut)
    late = v.clusters.where(F.col("cluster_id") > cut)
    one = cohort.assign_blocks(early, STRATA, ARMS, SEED)
    two = cohort.assign_blocks(late, STRATA, ("H", "L"), SEED)
    return reshape.union_strict(one, two).select("cluster_id", "rownumber", "block_id", "treatment")


@query
def q_pivot_time(v: Views) -> DataFrame:
    return v.measured


@query
def q_duplicate_keys(v: Views) -> DataFrame:
    return reshape.duplicate_keys(v.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query
def q_stack_imp(v: Views) -> DataFrame:
    return reshape.stack_imputations(v.units, IMPUTATIONS).select("imp", "id", "unit_id", "outcome")


@query
def q_harmonise(v: Views) -> DataFrame:
    return harmonise.harmonise_trials(
        v.wide_source,
        _labelled(v.long_source),
        v.share_of_clusters(62),
        city_labels=["Major Cities"],
    )


def _labelled(rows: DataFrame) -> DataFrame:
    """Bound labels as the long source spells them."""
    return rows.withColumns(
        {
            "SEIFACAT16": recode_equal(
                "SEIFACAT16", "Least", "2. Least Disadvantaged [NSW 2016]", "1. Most Disadvantaged [NSW 2016]"
            ),
            "RemoteDICHOM16": recode_equal(
                "RemoteDICHOM16",
                "Major Cities",
                "1. Major Cities of Australia",
                "2. Inner/Outer Regional/Remote Australia",
            ),
        }
    )


@query
def q_assign_blocks(v: Views) -> DataFrame:
    out = cohort.assign_blocks(v.clusters, STRATA, ARMS, SEED)
    return out.select("cluster_id", *STRATA, "rownumber", "block_id", "treatment")


@query
def q_seed_compare(v: Views) -> DataFrame:
    out = interim.seed_comparison(v.clusters, (FIT_SEED, SENSITIVITY_SEED), STRATA, ARMS)
    return out.select("cluster_id", "seed", "treatment")


@query
def q_counterfactual(v: Views) -> DataFrame:
    return reshape.expand_arms(v.units.select("unit_id", "arm", "baseline"), ARMS)


@query
def q_substitute_outcome(v: Views) -> DataFrame:
    units = v.units.select("unit_id", "outcome")
    rows = v.preds.join(units, "unit_id")
    return rows.select(
        "unit_id",
        "arm",
        "imp",
        substitute_outcome("outcome", "old_arm", "arm", "pred").alias("outcome"),
        substitute_outcome("outcome", "old_arm", "arm", "pred", keep_missing=False).alias("outcome_filled"),
    )


# Model


@query
def q_fit_stats(v: Views) -> DataFrame:
    formula = _small_formula()
    sums = model.size_sums(model.cluster_sums(v.units, formula), len(formula.names))
    squares = ("q3_3", "r3", "yy", "ss3_3", "st3", "tt")
    plain = [c for c in sums.columns if c not in (*squares, "n", "n_clusters")]
    return rounded(rounded(sums, *plain), *squares, digits=2)


def _small_formula() -> model.Formula:
    return model.Formula("outcome", "cluster_id", {"arm": ARMS}, ("baseline", "cohort"))


@query
def q_fit(v: Views) -> DataFrame:
    """Coefficients of the main regression, complete rows only."""
    units = cut_lineage(v.units, "units")
    return model.coefficient_summary(model.fit_random_intercept(units, v.formula))


@query
def q_fit_variance(v: Views) -> DataFrame:
    return model.variance_summary(model.fit_random_intercept(v.units, _small_formula(), ["cohort"]))


@query
def q_score_mean(v: Views) -> DataFrame:
    formula = model.Formula("outcome", "cluster_id", {"arm": ARMS}, ("baseline",))
    units = v.units
    means = model.cluster_means(model.cluster_sums(units, formula), formula)
    draws = _draw_means(v)
    rows = reshape.expand_arms(units.select("unit_id", "cluster_id", "arm", "baseline"), ARMS)
    scored = model.score_draws(rows, draws, formula, means, noise=False, hot=v.hot_clusters)
    out = scored.groupBy("cluster_id", "arm").agg(
        F.count("*").alias("n_rows"), F.count("pred").alias("n_pred"), F.avg("pred").alias("mean_pred")
    )
    return rounded(out, "mean_pred")


def _draw_means(v: Views) -> DataFrame:
    return v.draws.groupBy(F.col("imp").alias("draw")).agg(
        F.lit(20.0).alias("sigma"),
        F.lit(5.0).alias("tau"),
        F.array(F.lit(361.0 / 9.0), F.avg("b_h"), F.avg("b_l"), F.first("imp") * 0.1).alias("beta"),
    )


@query
def q_variance_decomposition(v: Views) -> DataFrame:
    """Share of the predictive variance without cluster effects, per cohort, on given draws."""
    formula = model.Formula("outcome", "cluster_id", {"arm": ARMS}, ("baseline",))
    units = cut_lineage(v.units, "units")
    means = model.cluster_means(model.cluster_sums(units, formula), formula)
    out = interim.variance_decomposition(
        units, _draw_means(v), formula, means, ["cohort"], noise=False
    )
    return rounded(out, "mean", "median", "lower", "upper")


@query
def q_variance_from_fit(v: Views) -> DataFrame:
    """The same from a fit for each cohort, on imputed units."""
    formula = model.Formula("outcome", "cluster_id", {k: x for k, x in v.formula.factors.items()}, ("baseline",))
    return interim.variance_from_fit(cut_lineage(_imputed(v), "imputed"), formula, ["cohort"])


@query
def q_gls_fixed(v: Views) -> DataFrame:
    """Coefficients of the outcome on the cohort at a fixed ratio of the variances."""
    formula = model.Formula("outcome", "cluster_id", {}, ("cohort",))
    sizes = model.size_sums(model.cluster_sums(v.units, formula), 2)
    beta = F.col("beta")
    return model.gls_coefficients(sizes, 2, 0.25).select(
        F.round(beta[0], 6).alias("intercept"), F.round(beta[1], 6).alias("slope")
    )


@query
def q_left_out(v: Views) -> DataFrame:
    """Rows that the fit of each cohort leaves out once baselines are imputed, by reason."""
    return model.incomplete_rows(_imputed(v), v.formula, ["cohort"])


@query
def q_score_draws(v: Views) -> DataFrame:
    """Spread of the predictions with cluster and residual noise, on imputed units."""
    return _prepared(v).predictions.groupBy("arm", "imp").agg(
        F.count("pred").alias("n"), F.avg("pred").alias("mean"), F.stddev_samp("pred").alias("sd")
    )


# Imputation


@query
def q_pmm_candidates(v: Views) -> DataFrame:
    level = v.table("orders").select(
        F.col("o_orderkey").alias("unit_id"), F.floor(F.col("o_totalprice") / 50).cast("double").alias("yhat")
    )
    rows = cut_lineage(v.measured.select("unit_id", "baseline").join(level, "unit_id", "right"), "scored")
    donors = rows.where(F.col("baseline").isNotNull()).select(
        F.col("unit_id").alias("donor_id"), "yhat", F.col("baseline").alias("y")
    )
    open_rows = rows.where(F.col("baseline").isNull()).select("unit_id", F.lit(1).alias("imp"), "yhat")
    return impute.draw_donors(donors, open_rows, 1, SEED).select("unit_id", "donor_id", "distance", "y")


FACTORS = {"arm": ARMS, "stype": SEGMENTS, "remoteness": ("Major Cities", "Regional/Remote")}
#: Posterior draws behind the predictions of the registered re-analyses: the operators' default.
NDRAWS = 100


def _imputed(v: Views) -> DataFrame:
    return impute.impute_pmm(cut_lineage(v.units, "units"), "baseline", FACTORS, ("cohort",), seed=SEED)


def _prepared(v: Views, ndraws: int = NDRAWS) -> interim.Prepared:
    """Imputed units with the fit and the predictions that every re-analysis starts from.

    The test tables' values are unrelated to the candidates, so that a screen would keep none; all are used.
    """
    units = cut_lineage(v.units, "units")
    return interim.prepare(units, v.formula, FACTORS, ("cohort",), 0.0, ndraws, hot=v.hot_clusters)


@query
def q_impute_pmm(v: Views) -> DataFrame:
    return _imputed(v).select("unit_id", "imp", "baseline", "outcome")


@query
def q_impute_proper(v: Views) -> DataFrame:
    """Five imputations on one predictor, each with coefficients of its own, and the nearest donor."""
    order = v.table("orders").select(
        F.col("o_orderkey").alias("unit_id"), F.floor(F.col("o_totalprice") / 5000).cast("double").alias("price")
    )
    rows = cut_lineage(order.join(v.measured.select("unit_id", "baseline"), "unit_id", "left"), "priced")
    made = impute.impute_pmm(rows, "baseline", {}, ("price",), donors=1, m=5, seed=SEED, proper=True)
    return made.select("unit_id", "imp", "baseline")


SEEDS = (1, 2, 3)


@query
def q_seed_units(v: Views) -> DataFrame:
    """The baselines of all units under three imputation seeds."""
    units = cut_lineage(v.units, "units")
    made = impute.impute_pmm(units, "baseline", FACTORS, ("cohort",), seeds=SEEDS)
    return made.select("seed", "unit_id", "imp", "baseline")


@query
def q_seed_pipeline(v: Views) -> DataFrame:
    """Imputation, fit and decision probabilities under three seeds, side by side."""
    units = cut_lineage(v.units, "units")
    return interim.seed_pipeline(units, v.formula, FACTORS, SEEDS, ("cohort",), 0.0).decisions()


@query
def q_store_exclusion(v: Views) -> DataFrame:
    """Sums of the regression without the first trial's high-dose clusters, from a store of sums per cluster."""
    formula = model.Formula("outcome", "cluster_id", {"arm": ARMS, "ses": SES}, ("cohort",))
    store = SumStore.create(cut_lineage(v.units, "units"), formula, fresh_path(v.spark, "sums"))
    out = store.totals(_early_high(v))
    return rounded(out.select("n_clusters", "n", "sum_arm_H", "sum_arm_L", "sum_ses_Most", "sum_cohort", "sum_outcome"), *[
        "sum_arm_H", "sum_arm_L", "sum_ses_Most", "sum_cohort", "sum_outcome",
    ])


@query
def q_quantile_sketch(v: Views) -> DataFrame:
    """Whether quartiles per arm, merged from stored sketches per arm and stratum, have ranks within the stated error."""
    units = cut_lineage(v.units, "units")
    parts = cut_lineage(sketch.quantile_sketches(units, ["arm", "stype"], "outcome"), "sketches")
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    found = cut_lineage(sketch.sketch_quantiles(sketch.merge_sketches(parts, ["arm"]), ["arm"], probs), "quartiles")
    y = F.col("outcome")
    counts = units.where(y.isNotNull()).join(found, "arm").groupBy("arm", "n_values").agg(
        *[F.count_if(y <= F.col(c)).alias(c) for c in probs], *[F.count_if(y < F.col(c)).alias(f"{c}_below") for c in probs]
    )
    slack = F.lit(sketch.rank_error()) * F.col("n_values") + 1
    cells = [
        F.struct(
            F.lit(c).alias("quantile"),
            ((F.col(c) >= p * F.col("n_values") - slack) & (F.col(f"{c}_below") <= p * F.col("n_values") + slack)).alias("within"),
        )
        for c, p in probs.items()
    ]
    return counts.select("arm", F.col("n_values").alias("n"), F.inline(F.array(*cells)))


# Whole analyses


@query
def q_interim_data(v: Views) -> DataFrame:
    cut = v.share_of_clusters(56)
    out = interim.stage_data(
        interim.up_to_cluster(v.units, cut),
        v.preds,
        ARMS,
        STRATA,
        SEED,
        hot=v.hot_clusters,
        strata_from=interim.up_to_cluster(v.bare_units, cut),
    )
    return out.select("unit_id", "cluster_id", "arm", "old_arm", "imp", "outcome")


@query
def q_two_stage_data(v: Views) -> DataFrame:
    out = _two_stage(v, cut_lineage(v.units, "units"))
    return out.select("unit_id", "cluster_id", "arm", "old_arm", "imp", "outcome")


def _two_stage(v: Views, units: DataFrame) -> DataFrame:
    """First stage: clusters in deciles 1 to 5; second stage: all the others."""
    ids = v.clusters.where(F.col("decile") <= 5).select("cluster_id")
    first = interim.choose_clusters(units, ids, hot=v.hot_clusters)
    second = interim.choose_clusters(units, ids, False, v.hot_clusters)
    return interim.two_stage_data(first, second, v.preds, strata=STRATA, seed=SEED, hot=v.hot_clusters)


@query
def q_sensitivity_data(v: Views) -> DataFrame:
    kept = interim.choose_clusters(v.units, _early_high(v), False, v.hot_clusters)
    return reshape.expand_arms(kept, ARMS).select("unit_id", "cluster_id", "old_arm", "arm", "outcome")


def _early_high(v: Views) -> DataFrame:
    """Clusters of the first trial that were in the high-dose arm."""
    early = v.clusters.where((F.col("cluster_id") <= v.share_of_clusters(62)) & (F.col("arm") == "H"))
    return early.select("cluster_id")


def _within_arm(v: Views) -> DataFrame:
    return interim.within_arm_data(_imputed(v), _early_high(v), "H", v.hot_clusters)


@query
def q_within_arm_data(v: Views) -> DataFrame:
    return _within_arm(v).groupBy("trial", "stype").agg(
        F.count("*").alias("n"), F.count("outcome").alias("n_outcome"), r6(F.avg("outcome")).alias("mean_outcome")
    )


@query
def q_within_arm_result(v: Views) -> DataFrame:
    """The two source trials inside one arm, on imputed units, with priors that follow the data."""
    formula = model.Formula(
        "outcome",
        "cluster_id",
        {
            "trial": ("Noninf", "Sup"),
            "ses": SES,
            "remoteness": ("Major Cities", "Regional/Remote"),
            "stype": SEGMENTS,
        },
        ("baseline",),
    )
    below, contrast = interim.within_arm_comparison(cut_lineage(_within_arm(v), "within-arm"), formula)
    return contrast.withColumn("p_below_zero", below.scalar())


def _interim(v: Views, part: int) -> interim.Analysis:
    ready = _prepared(v)
    return interim.interim_analysis(
        ready.units, ready.predictor, v.formula, cut=v.share_of_clusters(part), hot=v.hot_clusters
    )


@query
def q_interim_decisions(v: Views) -> DataFrame:
    return _interim(v, 56).decisions()


@query
def q_interim_contrasts(v: Views) -> DataFrame:
    return _interim(v, 37).contrasts()


LOOKS = (27, 37, 56)


@query
def q_interim_looks(v: Views) -> DataFrame:
    """What the looks after 27, 37 and 56 parts of the clusters hold, per arm, in one pass."""
    units = cut_lineage(v.units, "units")
    cuts = [v.share_of_clusters(k) for k in LOOKS]
    assigned = interim.assigned_clusters(interim.up_to_cluster(v.bare_units, max(cuts)), ARMS, STRATA, SEED)
    placed = joins.attach(
        units.withColumnRenamed("arm", "old_arm"), assigned.withColumnRenamed("treatment", "arm"),
        "cluster_id", ["unit_id"], "inner", v.hot_clusters,
    )
    return rounded(interim.look_sums(placed, cuts), "sum_seen")


def _looks(v: Views) -> interim.Analysis:
    ready = _prepared(v)
    cuts = [v.share_of_clusters(k) for k in LOOKS]
    return interim.interim_looks(ready.units, ready.predictor, v.formula, cuts, hot=v.hot_clusters)


@query
def q_interim_looks_decisions(v: Views) -> DataFrame:
    """The decision probabilities at all looks, from one pass over the units."""
    return _looks(v).decisions()


def _in_deciles(v: Views, low: int, high: int) -> DataFrame:
    return v.clusters.where(F.col("decile").between(low, high)).select("cluster_id")


def _two_stage_analysis(v: Views, second: DataFrame | None = None) -> interim.Analysis:
    ready = _prepared(v)
    first = _in_deciles(v, 1, 5)
    return interim.two_stage_analysis(
        ready.units, ready.predictor, v.formula, first, second, hot=v.hot_clusters
    )


@query
def q_two_stage_decisions(v: Views) -> DataFrame:
    return _two_stage_analysis(v).decisions()


@query
def q_two_stage_contrasts(v: Views) -> DataFrame:
    """Both stages, the second one an explicit list of clusters."""
    return _two_stage_analysis(v, _in_deciles(v, 6, 8)).contrasts()


@query
def q_two_stage_units(v: Views) -> DataFrame:
    """How many units of the two-stage analysis stand in each arm and imputation."""
    data = _two_stage_analysis(v, _in_deciles(v, 6, 8)).data
    return data.groupBy("arm", "imp").agg(F.count("*").alias("n"), F.count("outcome").alias("n_outcome"))


@query
def q_main_contrasts(v: Views) -> DataFrame:
    """Imputation, fit and pairwise contrasts on all units."""
    return _prepared(v).main.contrasts()


@query
def q_sensitivity_decisions(v: Views) -> DataFrame:
    found, _ = interim.exclusion_sensitivity(
        cut_lineage(v.units, "units"), _early_high(v), v.formula, FACTORS, ("cohort",), hot=v.hot_clusters
    )
    return found.decisions()
