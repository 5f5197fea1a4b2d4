"""The regression from sums against dense algebra, and what is derived from it."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialweave.functions.tails import normal_cdf_array
from trialweave.operators import decide, model
from trialweave.plans import interim

ARMS = ("Ctrl", "H", "L")
FORMULA = model.Formula("y", "cluster_id", {"arm": ARMS, "s": ("p", "q")}, ("x",))
TRUE = {"Intercept": 30.0, "arm_H": 12.0, "arm_L": 4.0, "s_q": -3.0, "x": 0.5}


def make(seed=0, clusters=60, tau=4.0, sigma=6.0):
    rng = np.random.default_rng(seed)
    out, uid = [], 0
    for c in range(clusters):
        arm, u = ARMS[c % 3], rng.normal(0, tau)
        for _ in range(int(rng.integers(2, 9))):
            s, x = "pq"[int(rng.integers(0, 2))], float(rng.normal(1000, 5))
            y = 30 + {"Ctrl": 0, "H": 12, "L": 4}[arm] - 3 * (s == "q") + 0.5 * (x - 1000) + u + rng.normal(0, sigma)
            out.append((uid, c, arm, s, x, float(y)))
            uid += 1
    return out


SCHEMA = "unit_id long, cluster_id long, arm string, s string, x double, y double"


@pytest.fixture(scope="module")
def data():
    return make()


@pytest.fixture(scope="module")
def fit(spark, data):
    blank = [(10_000, 1, "H", "p", 1000.0, None), (10_001, 1, "H", None, 1000.0, 5.0)]
    return model.fit_random_intercept(spark.createDataFrame(data + blank, SCHEMA), FORMULA)


def dense(data):
    x = np.array([[1, a == "H", a == "L", s == "q", v] for _, _, a, s, v, _ in data], dtype=float)
    return x, np.array([r[5] for r in data]), np.array([r[1] for r in data])


def dense_posterior(data, sigma, tau, priors):
    """Coefficients given the variances, by the full covariance matrix."""
    x, y, c = dense(data)
    v = sigma**2 * np.eye(len(y)) + tau**2 * (c[:, None] == c[None])
    mean = x.mean(0)
    xc = x - np.r_[0, mean[1:]]
    vi = np.linalg.inv(v)
    prec = xc.T @ vi @ xc + np.eye(x.shape[1]) / priors.coefficient_sd**2
    beta = np.linalg.solve(prec, xc.T @ vi @ y)
    back = np.eye(len(beta))
    back[0, 1:] = -mean[1:]
    logp = 0.5 * beta @ prec @ beta - 0.5 * y @ vi @ y - 0.5 * np.linalg.slogdet(v)[1] - 0.5 * np.linalg.slogdet(prec)[1]
    return back @ beta, back @ np.linalg.inv(prec) @ back.T, logp


def test_cells_match_dense_algebra(fit, data):
    cells = fit.table.orderBy(F.col("weight").desc()).limit(3).collect()
    for r in cells:
        beta, cov, _ = dense_posterior(data, r.sigma, r.tau, model.Priors())
        assert np.allclose(r.beta, beta, rtol=1e-5, atol=1e-5)
        assert np.allclose(np.reshape(r["cov"], (5, 5)), cov, rtol=1e-4, atol=1e-6)


def test_weights_match_dense_likelihood(fit, data):
    rows = fit.table.where(F.col("weight") > 1e-4).orderBy("cell").collect()
    assert sum(r.weight for r in fit.table.select("weight").collect()) == pytest.approx(1.0)
    pick = rows[:: max(1, len(rows) // 12)]
    priors = model.Priors()
    prior = lambda v: -2.0 * np.log1p((v / priors.scale) ** 2 / 3)
    want = np.array([dense_posterior(data, r.sigma, r.tau, priors)[2] + prior(r.sigma) + prior(r.tau) + np.log(r.sigma * r.tau) for r in pick])
    got = np.array([np.log(r.weight) for r in pick])
    assert np.allclose(got - got[0], want - want[0], atol=1e-4)


def test_fit_recovers_the_truth(fit):
    got = {r.coefficient: r for r in model.coefficient_summary(fit).collect()}
    assert set(got) == set(FORMULA.names)
    for name, value in TRUE.items():
        r = got[name]
        target = value - 500 if name == "Intercept" else value
        assert abs(r.estimate - target) < 4 * r.sd
    v = model.variance_summary(fit).first()
    assert abs(v.sigma - 6) < 1.2 and abs(v.tau - 4) < 1.8
    assert 0.1 < v.icc < 0.6


def test_refining_the_grid_changes_nothing(spark, data, fit, monkeypatch):
    monkeypatch.setattr(model, "FINE_POINTS", 81)
    monkeypatch.setattr(model, "SIGMA_POINTS", 61)
    finer = model.fit_random_intercept(spark.createDataFrame(data, SCHEMA), FORMULA)
    a = {r.coefficient: (r.estimate, r.sd) for r in model.coefficient_summary(fit).collect()}
    b = {r.coefficient: (r.estimate, r.sd) for r in model.coefficient_summary(finer).collect()}
    for name in a:
        assert a[name] == pytest.approx(b[name], rel=1e-3, abs=1e-3)


def test_no_cluster_effect(spark):
    rows = make(seed=3, tau=0.0)
    v = model.variance_summary(model.fit_random_intercept(spark.createDataFrame(rows, SCHEMA), FORMULA)).first()
    assert v.tau < 1.5 and abs(v.sigma - 6) < 1.0


def test_groups_are_fitted_apart_and_partitioning_is_irrelevant(spark, data, fit):
    other = make(seed=7)
    both = spark.createDataFrame([(*r, 1) for r in data] + [(*r, 2) for r in other], SCHEMA + ", imp int")
    grouped = model.fit_random_intercept(both.repartition(8), FORMULA, ["imp"])
    one = {r.coefficient: (r.estimate, r.sd) for r in model.coefficient_summary(fit).collect()}
    for r in model.coefficient_summary(grouped).where("imp = 1").collect():
        if r.coefficient != "Intercept":  # sits far outside the data, so it carries the rounding of x
            assert (r.estimate, r.sd) == pytest.approx(one[r.coefficient], rel=1e-4, abs=1e-4)


def test_draws_agree_with_the_fit(fit):
    draws = model.draws_from_fit(fit, 4000, seed=5)
    beta = np.array([r.beta for r in draws.select("beta").collect()])
    again = np.array([r.beta for r in model.draws_from_fit(fit, 4000, seed=5).select("beta").collect()])
    assert np.array_equal(beta, again)
    summary = {r.coefficient: r for r in model.coefficient_summary(fit).collect()}
    for j, name in enumerate(FORMULA.names):
        r = summary[name]
        assert abs(beta[:, j].mean() - r.estimate) < 5 * r.sd / np.sqrt(4000)
        assert beta[:, j].std() == pytest.approx(r.sd, rel=0.06)


def test_probabilities_agree_with_draws(fit):
    exact = decide.decision_probs_from_fit(fit, "arm_H", "arm_L", 6.0).first()
    draws = model.draws_from_fit(fit, 20_000, seed=1)
    named = draws.select(F.col("beta")[1].alias("h"), F.col("beta")[2].alias("l"))
    counted = decide.decision_probs(named, "h", "l", 6.0).first()
    for name in decide.DECISIONS:
        assert exact[name] == pytest.approx(counted[name], abs=0.015)
    below = decide.direction_prob_from_fit(fit, "arm_L").first()[0]
    assert below == pytest.approx(1 - exact.p_low_above_control, abs=1e-9)
    assert normal_cdf_array(np.array([0.0]))[0] == 0.5


def test_scores(spark, fit, data):
    units = spark.createDataFrame(data, SCHEMA)
    draws = model.draws_from_fit(fit, 40, seed=2)
    mean = model.score_draws(units, draws, FORMULA, fit.cluster_means, noise=False).select("unit_id", "draw", "pred")
    got = {(r.unit_id, r.draw): r.pred for r in mean.collect()}
    x, y, c = dense(data)
    for r in draws.collect()[:3]:
        line = x @ np.array(r.beta)
        for i in (0, 17, 120):
            same = c == c[i]
            n = same.sum()
            u = n * r.tau**2 / (r.sigma**2 + n * r.tau**2) * (y[same] - line[same]).mean()
            assert got[(i, r.draw)] == pytest.approx(line[i] + u, abs=1e-6)
    noisy = model.score_draws(units, draws, FORMULA, fit.cluster_means, seed=4).select("unit_id", "draw", "pred")
    same = model.score_draws(units.repartition(5), draws, FORMULA, fit.cluster_means, seed=4).select("unit_id", "draw", "pred")
    a = {(r.unit_id, r.draw): r.pred for r in noisy.collect()}
    assert a == pytest.approx({(r.unit_id, r.draw): r.pred for r in same.collect()})
    gap = np.array([a[k] - got[k] for k in a])
    assert abs(gap.mean()) < 0.4 and 5.5 < gap.std() < 7.5
    fresh = units.withColumn("cluster_id", F.lit(9999).cast("long"))
    assert model.score_draws(fresh, draws, FORMULA, fit.cluster_means).where("pred is null").count() == 0


def test_decision_hand_case(spark):
    draws = spark.createDataFrame([(16.4, 0.0), (10.0, 12.0), (50.0, 20.0), (-1.0, -2.0)], "h double, l double")
    assert tuple(decide.decision_probs(draws, "h", "l").first()) == (0.75, 0.25, 0.75, 0.5)
    assert decide.direction_prob(draws, "h").first()[0] == 0.25


def test_contrast_hand_case(spark):
    draws = spark.createDataFrame([(10.0, 4.0), (20.0, 8.0)], "h double, l double")
    rows = spark.createDataFrame([("H",), ("L",)], "arm string")
    vectors = decide.contrast_vectors(rows, model.Formula("y", "c", {"arm": ARMS}), ARMS)
    for limit in (None, 0):
        got = decide.pairwise_contrasts(draws, vectors, ["h", "l"], range_rows=limit)
        assert {r.contrast: pytest.approx((r.estimate, r.lower, r.upper)) for r in got.collect()} == {
            "H-Ctrl": (15, 10.25, 19.75), "L-Ctrl": (6, 4.1, 7.9), "L-H": (-9, -11.85, -6.15)
        }


def test_contrasts_equal_average_prediction_differences(spark, data):
    f = model.Formula("y", "cluster_id", {"arm": ARMS, "s": ("p", "q")}, interactions=[("arm", "s")])
    units = spark.createDataFrame(data, SCHEMA)
    names = f.depends_on("arm")
    assert names == ["arm_H", "arm_L", "arm_H:s_q", "arm_L:s_q"]
    got = {r.contrast: r.vec for r in decide.contrast_vectors(units, f, ARMS).collect()}
    share = np.mean([r[3] == "q" for r in data])
    assert got["L-H"] == pytest.approx([-1, 1, -share, share])
    by = {(r.s, r.contrast): r.vec for r in decide.contrast_vectors(units, f, ARMS, by=["s"]).collect()}
    assert by[("q", "H-Ctrl")] == [1, 0, 1, 0] and by[("p", "H-Ctrl")] == [1, 0, 0, 0]


def test_split_rhat_hand_case(spark):
    draws = spark.createDataFrame([(1, i, float(i)) for i in (1, 2, 3, 4)] + [(2, i, i + 1.0) for i in (1, 2, 3, 4)], "chain int, draw int, b double")
    assert decide.split_rhat(draws, ["b"]).first().rhat == pytest.approx(1.957890, abs=1e-6)


def test_pooling(spark):
    per = spark.createDataFrame([("b", 1.0, 2.0), ("b", 3.0, 2.0)], "coefficient string, estimate double, sd double")
    r = decide.pool_imputations(per).first()
    assert (r.n_imp, r.pooled_mean, r.within_var, r.between_var) == (2, 2.0, 4.0, 1.0)
    assert r.pooled_sd == pytest.approx(5**0.5)


def test_variance_ratio(spark):
    rows = spark.createDataFrame([(d, float(i), float(i * (d + 1))) for d in range(3) for i in range(5)], "d int, a double, b double")
    r = decide.variance_ratio(rows, "d", "a", "b").first()
    ratios = [1.0, 0.25, 1 / 9]
    assert (r.n_draws, r["mean"], r.median) == (3, pytest.approx(np.mean(ratios)), 0.25)


def test_interim_and_two_stage_analyses(spark):
    rows = [(*r[:3], r[3], r[4], r[5]) for r in make(seed=11, clusters=90)]
    units = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("y", "outcome")
    f = model.Formula("outcome", "cluster_id", {"arm": ARMS, "s": ("p", "q")}, ("x",))
    fit = model.fit_random_intercept(units, f)
    preds = interim.counterfactual_predictions(units, fit, ndraws=3)
    assert preds.count() == len(rows) * 9
    strata = ("half",)
    units = units.withColumn("half", F.when(F.col("cluster_id") % 2 == 0, "even").otherwise("odd"))
    got = interim.interim_analysis(units, preds, f, cut=44, strata=strata, ndraws=400)
    p = got.decisions().first()
    assert all(0 <= x <= 1 for x in p) and p.p_high_above_control > 0.95
    c = {r.contrast: r for r in got.contrasts().collect()}
    assert set(c) == {"H-Ctrl", "L-Ctrl", "L-H"}
    assert c["H-Ctrl"].lower < 12 < c["H-Ctrl"].upper and c["H-Ctrl"].n_values == 1200
    ids = spark.range(45).select(F.col("id").alias("cluster_id"))
    stages = interim.two_stage_data(
        interim.choose_clusters(units, ids), interim.choose_clusters(units, ids, False), preds, strata=strata
    )
    late = stages.where(F.col("cluster_id") >= 45)
    assert late.where(F.col("arm") == "Ctrl").count() == 0
    assert stages.count() == len(rows) * 3
    moved = stages.where((F.col("arm") == F.col("old_arm"))).join(units.select("unit_id", F.col("outcome").alias("seen")), "unit_id")
    assert moved.where(F.col("outcome") != F.col("seen")).count() == 0


def test_within_arm_comparison(spark):
    units = spark.createDataFrame(make(seed=13), SCHEMA).withColumnRenamed("y", "outcome")
    data = interim.within_arm_data(units, range(30), "H")
    assert {r[0] for r in data.select("trial").distinct().collect()} == {"Sup", "Noninf"}
    f = model.Formula("outcome", "cluster_id", {"trial": ("Noninf", "Sup"), "s": ("p", "q")}, ("x",))
    below, contrast = interim.within_arm_comparison(data, f, 300)
    assert 0 <= below.first()[0] <= 1
    assert contrast.first().contrast == "Sup-Noninf"


def test_main_and_sensitivity_analyses(spark):
    rng = np.random.default_rng(17)
    rows = [(*r[:4], None if rng.random() < 0.15 else r[4], r[5]) for r in make(seed=17)]
    units = spark.createDataFrame(rows, "unit_id long, cluster_id long, arm string, s string, baseline double, outcome double")
    f = model.Formula("outcome", "cluster_id", {"arm": ARMS, "s": ("p", "q")}, ("baseline",))
    found, preds = interim.main_analysis(units, f, {"arm": ARMS, "s": ("p", "q")}, mincor=0.0, ndraws=2)
    assert found.data.where("baseline is null").count() == 0
    assert preds.count() == len(rows) * 3 * 2 and preds.where("pred is null").count() == 0
    assert preds.schema["imp"].dataType.simpleString() == "int"
    low = interim.exclusion_sensitivity(units, range(10), f, {"arm": ARMS, "s": ("p", "q")}, mincor=0.0)[0]
    assert low.data.where("cluster_id < 10").count() == 0
    assert 0 <= low.decisions().first().p_noninferior <= 1
    with pytest.raises(ValueError):
        interim.interim_analysis(units, preds, f)


@pytest.mark.parametrize("clusters", [1e2, 1e4, 1e6, 1e9])
def test_grid_resolves_any_number_of_clusters(clusters):
    """Balanced clusters of ten from their sums alone: the spread of tau agrees with theory."""
    n, sigma, tau = 10, 6.0, 4.0
    between = sigma**2 + n * tau**2  # expected mean square between clusters
    yy = clusters * ((n - 1) * sigma**2 + between)
    tt = clusters * n * between
    lam = np.exp(np.linspace(np.log(1e-8), np.log(1e6), model.COARSE_POINTS))
    for _ in range(model.MOST_ROUNDS):
        w, keep = lam / (1 + n * lam), 1 / (1 + n * lam)
        frame = pd.DataFrame(
            {
                "lam": lam, "total": n * clusters, "logdet": clusters * np.log1p(n * lam), "c": yy - w * tt,
                "a": [[n * clusters * k] for k in keep], "b": [[0.0] for _ in keep], "mean": [[1.0] for _ in keep],
            }
        )
        lam, logp, (_, taus, _, _) = model._solve(frame, 1, model.Priors(), True)
        grid, done = model.refine(lam, logp)
        if done:
            break
        lam = np.array(grid)
    assert done
    p = np.exp(logp - logp.max())
    p /= p.sum()
    mean = (p * taus).sum()
    got = np.sqrt((p * (taus - mean) ** 2).sum())
    # tau^2 = (between - within) / n, with independent chi-square mean squares
    var = (2 * between**2 / clusters + 2 * sigma**4 / (clusters * (n - 1))) / n**2
    want = np.sqrt(var) / (2 * tau)
    assert abs(mean / tau - 1) < (0.05 if clusters < 1e3 else 5e-3) and abs(got / want - 1) < (0.15 if clusters < 1e3 else 0.05)


def test_draw_streams_differ_for_every_key():
    keys = [("ab",), ("ba",), (-1,), (1,), ("1",)]
    firsts = {tuple(model._stream(1, *k, 0).random(3)) for k in keys}
    assert len(firsts) == len(keys)
