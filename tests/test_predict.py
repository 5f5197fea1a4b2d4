"""Predictions on demand against the table of all predictions, and looks against single interim analyses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.operators import grams, model, predict
from trialweave.operators.joins import attach
from trialweave.operators.reshape import expand_arms
from trialweave.plans import interim
from trialweave.session import shuffle_partitions

from test_model import ARMS, FORMULA, SCHEMA, make

STRATA = ("half",)
F_OUT = model.Formula("outcome", "cluster_id", FORMULA.factors, FORMULA.numeric)


@pytest.fixture(scope="module")
def units(spark):
    rows = make(seed=21, clusters=70)
    rows += [(5000 + i, 900, "H", "p", 1001.0, None) for i in range(3)]  # a cluster without outcomes
    rows += [(6000, 3, "L", None, 1000.0, 5.0), (6001, 4, "L", "q", 1000.0, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("y", "outcome")
    return df.withColumn("half", F.when(F.col("cluster_id") % 2 == 0, "even").otherwise("odd")).cache()


@pytest.fixture(scope="module")
def given(spark, units):
    fit = model.fit_random_intercept(units, F_OUT)
    draws = model.draws_from_fit(fit, 4).cache()
    return fit, draws, predict.Predictor.of_draws(draws, F_OUT, fit.cluster_means)


def test_table_equals_the_row_by_row_scores(units, given):
    fit, draws, predictor = given
    rows = expand_arms(units, ARMS)
    want = model.score_draws(rows, draws, F_OUT, fit.cluster_means).where("pred is not null")
    want = {(r.unit_id, r.arm, r.draw): (r.old_arm, r.pred) for r in want.collect()}
    got = {(r.unit_id, r.arm, r.imp): (r.old_arm, r.pred) for r in predictor.table(units, ARMS).collect()}
    assert set(got) == set(want) and len(got) == 12 * units.where("s is not null").count()
    for k, (old, pred) in want.items():
        assert got[k][0] == old and got[k][1] == pytest.approx(pred, abs=1e-9)


def test_a_missing_cluster_gets_one_new_effect(spark, units, given):
    fit, draws, predictor = given
    rows = units.limit(5).withColumn("cluster_id", F.lit(None).cast("long"))
    want = model.score_draws(expand_arms(rows, ARMS), draws, F_OUT, fit.cluster_means)
    want = {(r.unit_id, r.arm, r.draw): r.pred for r in want.collect()}
    got = {(r.unit_id, r.arm, r.imp): r.pred for r in predictor.table(rows, ARMS).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def by_table(units, predictor, chosen, assigned):
    return interim.with_predictions(chosen, assigned, predictor.table(units, ARMS))


def flat(sums, p, keys):
    """Block sums as the columns of ``size_sums``, what is needed in total per group apart."""
    up, down = grams.triangle(p - 1)
    sized, total = {}, {}
    for r in sums.collect():
        key, v = tuple(r[k] for k in keys), list(r.v)
        names = [f"q{j + 1}_{k + 1}" for j, k in zip(up, down)] + ["yy"] + [f"r{j}" for j in range(1, p)]
        if r.n:
            names = [f"s{j}" for j in range(1, p)] + [f"ss{j + 1}_{k + 1}" for j, k in zip(up, down)] + ["t", "tt"]
            names += [f"st{j}" for j in range(1, p)]
        assert len(v) == len(names)
        (sized if r.n else total)[(*key, r.n) if r.n else key] = {**dict(zip(names, v)), "n_clusters": r.n_clusters}
    return sized, total


def check_sums(got, want, p, keys):
    sized, total = flat(got, p, keys)
    rows = want.collect()
    assert len(sized) == len(rows)
    added = {}
    for r in rows:
        key = tuple(r[k] for k in keys)
        for name, value in sized[(*key, r.n)].items():
            assert value == pytest.approx(r[name], rel=1e-9, abs=1e-6), (key, r.n, name)
        for name in total[key]:
            if name != "n_clusters":
                added[key, name] = added.get((key, name), 0.0) + r[name]
    for (key, name), value in added.items():
        assert total[key][name] == pytest.approx(value, rel=1e-9, abs=1e-6), (key, name)


@pytest.mark.parametrize("block", [2000, 7])
def test_sums_of_imputed_outcomes_equal_those_of_the_copied_rows(units, given, monkeypatch, block):
    monkeypatch.setattr(grams, "BLOCK_ROWS", block)
    monkeypatch.setattr(grams, "HELD", 2)
    predictor = given[2]
    assigned = interim.assigned_clusters(units, ARMS, STRATA, 7)
    placed = interim.place(units, assigned, predictor)
    centre = model.centring(placed, F_OUT)
    copied = by_table(units, predictor, units, assigned)
    p = len(F_OUT.names)
    want = model.size_sums(model.cluster_sums(copied, F_OUT, ["imp"], centre), p, ["imp"])
    check_sums(predict.imputed_size_sums(placed, predictor, F_OUT, centre), want, p, ["imp"])
    rows = {(r.unit_id, r.imp): (r.arm, r.old_arm, r.outcome) for r in copied.collect()}
    made = {(r.unit_id, r.imp): (r.arm, r.old_arm, r.outcome) for r in predict.imputed_rows(placed, predictor).collect()}
    assert set(made) == set(rows)
    for k, (arm, old, y) in rows.items():
        assert made[k][:2] == (arm, old) and (made[k][2] == y or made[k][2] == pytest.approx(y, abs=1e-9))


def test_analyses_on_demand_equal_those_of_a_table(units, given):
    predictor = given[2]
    preds = predictor.table(units, ARMS)
    for one, two in (
        [interim.interim_analysis(units, p, F_OUT, cut=50, strata=STRATA, ndraws=50) for p in (preds, predictor)],
        [interim.two_stage_analysis(units, p, F_OUT, range(30), strata=STRATA, ndraws=50) for p in (preds, predictor)],
    ):
        assert list(two.decisions().first()) == pytest.approx(list(one.decisions().first()), abs=1e-6)
        a, b = ({r.contrast: r for r in x.contrasts().collect()} for x in (one, two))
        assert set(a) == set(b) and len(a) == 3
        for k in a:
            assert list(b[k])[1:] == pytest.approx(list(a[k])[1:], abs=1e-4)
        assert one.data.groupBy("imp", "arm").agg(F.count("outcome")).exceptAll(two.data.groupBy("imp", "arm").agg(F.count("outcome"))).count() == 0


def test_looks_equal_single_interim_analyses(units, given):
    predictor = given[2]
    cuts = (30, 64, 45)
    every = interim.interim_looks(units, predictor, F_OUT, cuts, strata=STRATA, ndraws=40)
    found = {r.look: r for r in every.decisions().collect()}
    contrasts = {(r.look, r.contrast): r.estimate for r in every.contrasts().collect()}
    assert len(contrasts) == 9
    for look, cut in enumerate(sorted(cuts), 1):
        one = interim.interim_analysis(units, predictor, F_OUT, cut=cut, strata=STRATA, ndraws=40)
        assert list(found[look])[1:] == pytest.approx(list(one.decisions().first()), abs=1e-5)
        for r in one.contrasts().collect():
            assert abs(contrasts[look, r.contrast] - r.estimate) < 3  # other streams, the same distribution


def test_no_prediction_table_in_the_plan_of_a_reanalysis(units, given):
    placed = interim.place(units, interim.assigned_clusters(units, ARMS, STRATA, 7), given[2])
    sums = predict.imputed_size_sums(placed, given[2], F_OUT, {})
    text = sums._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text.split("MapInArrow")[-1] and "CartesianProduct" not in text


def test_too_many_draws_are_refused(spark, given, monkeypatch):
    fit, draws, _ = given
    monkeypatch.setattr(predict, "MOST_NUMBERS", 10)
    with pytest.raises(ValueError):
        predict.Predictor.of_draws(draws, F_OUT, fit.cluster_means)
    with pytest.raises(ValueError):
        predict.Predictor.of_draws(draws.where("draw > 1"), F_OUT, fit.cluster_means)


def test_block_sums_equal_plain_sums(spark, monkeypatch):
    """Groups, a cluster that spreads over tasks and blocks, missing keys, incomplete rows."""
    monkeypatch.setattr(grams, "BLOCK_ROWS", 5)
    monkeypatch.setattr(grams, "HELD", 2)
    df = spark.createDataFrame(make(seed=3), SCHEMA).withColumn("g", F.when(F.col("unit_id") % 3 > 0, F.col("unit_id") % 3))
    df = df.withColumn("cluster_id", F.when(F.col("unit_id") % 4 == 0, 5).when(F.col("unit_id") % 17 > 0, F.col("cluster_id")))
    df = df.withColumn("y", F.when(F.col("unit_id") % 11 > 0, F.col("y"))).repartition(5)
    centre = model.centring(df, FORMULA)
    p = len(FORMULA.names)
    want = model.size_sums(model.cluster_sums(df, FORMULA, ["g"], centre), p, ["g"])
    rows = model.design_rows(df, FORMULA, ["g"], centre)
    made = grams.cluster_blocks(rows, ["g"], p - 1, 1, lambda b: b.column(3).to_numpy()[:, None])
    check_sums(grams.size_blocks(grams.merged_clusters(made, ["g"]), ["g"], p - 1, 1), want, p, ["g"])


def test_means_of_clusters_from_blocks(spark):
    df = spark.createDataFrame(make(seed=6), SCHEMA)
    fit = model.fit_random_intercept(df, FORMULA)
    want = model.cluster_means(model.cluster_sums(df, FORMULA), FORMULA)
    got = {r.cluster_id: r for r in fit.cluster_means.collect()}
    for r in want.collect():
        assert got[r.cluster_id].n == r.n and got[r.cluster_id].y_mean == pytest.approx(r.y_mean)
        assert got[r.cluster_id].x_mean == pytest.approx(r.x_mean)


def test_two_hundred_columns_in_one_pass(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((900, 200))
    beta = rng.standard_normal(200)
    c = rng.integers(0, 45, 900)
    y = 3 + x @ beta + rng.normal(0, 1, 45)[c] + rng.normal(0, 0.5, 900)
    df = spark.createDataFrame([(int(a), float(b), r.tolist()) for a, b, r in zip(c, y, x)], "c long, y double, x array<double>")
    names = [f"v{j}" for j in range(200)]
    df = df.select("c", "y", *[F.col("x")[j].alias(n) for j, n in enumerate(names)])
    fit = model.fit_random_intercept(df, model.Formula("y", "c", {}, names))
    got = {r.coefficient: r.estimate for r in model.coefficient_summary(fit).collect()}
    assert max(abs(got[n] - b) for n, b in zip(names, beta)) < 0.15


def test_an_unresolved_group_leaves_the_others(spark, monkeypatch):
    df = spark.createDataFrame(make(seed=4), SCHEMA).withColumn("g", F.lit(1))
    monkeypatch.setattr(model, "MOST_ROUNDS", 1)
    rows = model.fit_random_intercept(df, FORMULA, ["g"]).table.select("g", "resolved").distinct().collect()
    assert [tuple(r) for r in rows] == [(1, False)]


def test_blocks_of_draws_do_not_change_the_shares(spark, monkeypatch):
    formula = model.Formula("outcome", "cluster_id", {"arm": ("a", "b")}, ("baseline",))
    units = spark.createDataFrame(
        [(i, i % 7, "ab"[i % 2], float(i % 11), float(i * i % 13), i % 3) for i in range(200)],
        "unit_id long, cluster_id long, arm string, baseline double, outcome double, g int",
    )
    draws = spark.createDataFrame([(d, 2.0 + d / 100, 1.0, [0.5, d / 50, 0.3]) for d in range(1, 31)], "draw int, sigma double, tau double, beta array<double>")
    means = model.cluster_means(model.cluster_sums(units, formula), formula)

    def shares():
        return {(r.g, r.draw): r.ratio for r in predict.variance_shares(units, draws, formula, means, ["g"]).collect()}

    whole = shares()
    monkeypatch.setattr(predict, "DRAWS_AT_ONCE", 8)
    assert len(whole) == 90 and shares() == pytest.approx(whole, rel=1e-9)


def test_predictions_are_dealt_over_all_tasks_of_a_shuffle(spark, units, given):
    predictor, tasks = given[2], shuffle_partitions(spark)
    assert tasks > 1  # the rows are few bytes, so that they would go to one task by their size
    clusters = units.select("cluster_id").distinct()
    assert predictor.effects(clusters).rdd.getNumPartitions() == tasks
    assert predictor.table(units, ARMS).rdd.getNumPartitions() == tasks
    assigned = interim.assigned_clusters(units, ARMS, STRATA, 7)
    assert interim.place(units, assigned, predictor).rdd.getNumPartitions() == tasks


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("hot", [{}, {3: 64}])
def test_dealt_rows_meet_what_they_meet_otherwise(spark, how, hot):
    facts = spark.createDataFrame([(i, 3 if i % 2 else i % 7) for i in range(60)] + [(60, None), (60, None), (5, 5)], "unit_id long, cluster_id long")
    keyed = spark.createDataFrame([(k, [float(k)]) for k in (0, 1, 3, 5)] + [(None, [9.0])], "cluster_id long, effects array<double>")
    want = attach(facts, keyed, "cluster_id", ["unit_id"], how, hot).collect()
    assert sorted(attach(facts, keyed, "cluster_id", ["unit_id"], how, hot, deal=True).collect(), key=str) == sorted(want, key=str)
