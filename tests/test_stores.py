"""Stores of sums and sketches, checked CSV files, proper imputation, seeds and variance shares."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.operators import impute, model, predict, sketch
from trialweave.plans import interim
from trialweave.sources.sums import SumStore
from trialweave.sources.tables import read_checked_csv

from test_model import ARMS, FORMULA, SCHEMA, make


def test_refits_from_the_store_equal_refits_from_rows(spark, tmp_path):
    units = spark.createDataFrame(make(seed=31), SCHEMA).cache()
    store = SumStore.create(units.where("unit_id < 150"), FORMULA, str(tmp_path / "sums"))
    store.add(units.where("unit_id >= 150"))
    late = spark.createDataFrame([(9001, 2, "H", "p", 1001.0, 30.0), (9002, 999, "L", "q", 999.0, 41.0)], SCHEMA)
    store.add(late)
    store = SumStore.open(spark, str(tmp_path / "sums"))
    assert store.latest() == 2 and store.formula.factors == FORMULA.factors and store.formula.names == FORMULA.names

    def same(fit, rows):
        want = {r.coefficient: (r.estimate, r.sd) for r in model.coefficient_summary(model.fit_random_intercept(rows, FORMULA)).collect()}
        got = {r.coefficient: (r.estimate, r.sd) for r in model.coefficient_summary(fit).collect()}
        for k, w in want.items():
            # the intercept's prior sits at the mean of each table; its spread of 1000 leaves that much
            near = 1e-3 if k == "Intercept" else 1e-7
            assert got[k] == pytest.approx(w, rel=near, abs=near), k

    gone = [3, 7, 999, None]
    same(store.fit(gone), units.where("cluster_id not in (3, 7)").unionByName(late.where("cluster_id = 2")))
    same(store.fit(spark.createDataFrame([(3,), (7,)], "c long"), as_of=1), units.where("cluster_id not in (3, 7)"))
    assert store.remove(late) == 3 and store.remove(units.where("cluster_id = 5")) == 4
    same(store.fit(), units.where("cluster_id != 5"))
    plan = store._merged((), None)._jdf.queryExecution().executedPlan().toString()
    assert "sums" in plan and "unit_id" not in plan


def test_sketches_merge_and_keep_their_ranks(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal(30_000), np.full(10_000, 0.25)])
    df = spark.createDataFrame([(i % 7, float(v)) for i, v in enumerate(x)], "g long, v double")
    df = df.unionByName(spark.createDataFrame([(0, None), (1, math.nan), (9, None)], "g long, v double"))
    parts = sketch.quantile_sketches(df, ["g"], "v", 512)
    assert parts.where("g = 9 and sketch is null").count() == 1
    got = sketch.sketch_quantiles(sketch.merge_sketches(parts, []), [], {"a": 0.1, "m": 0.5, "b": 0.9}).first()
    assert got.n_values == 40_000
    slack = sketch.rank_error(512) * len(x)
    for name, p in (("a", 0.1), ("m", 0.5), ("b", 0.9)):
        assert (x < got[name]).sum() - slack <= p * len(x) <= (x <= got[name]).sum() + slack


def test_checked_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v,s\n1,2.5,"x, ""y"""\n2,oops,NA\n3,4\n\n4,,z,extra\nfive,6,\n')
    (tmp_path / "b.csv").write_text("s,w,k\r\nq,1,10\r\nr,2,\r\n")
    schema = "k int, v double, s string"
    from pyspark.sql import types as T

    read = read_checked_csv(spark, str(tmp_path / "*.csv"), T._parse_datatype_string(schema))
    rows = [tuple(r)[1:] for r in read.rows.orderBy("s", "k").collect()]
    assert sorted(rows, key=repr) == sorted([(1, 2.5, 'x, "y"'), (2, None, None), (None, 6.0, None), (10, None, "q"), (None, None, "r")], key=repr)
    assert sorted(r.line for r in read.quarantine.collect()) == ["3,4", "4,,z,extra"]
    heads = [(r.file[-5:], r.missing, r.unknown) for r in read.headers.collect()]
    assert heads == [("b.csv", ["v"], ["w"])]
    counts = {(r.file[-5:], r.column_name): (r.n_rows, r.n_unreadable) for r in read.counts.collect()}
    assert counts == {
        ("a.csv", "k"): (3, 1), ("a.csv", "v"): (3, 1), ("a.csv", "s"): (3, 0),
        ("b.csv", "k"): (2, 0), ("b.csv", "v"): (2, 0), ("b.csv", "s"): (2, 0),
    }


def linear(n=4000, seed=5, off=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(3 + off, 2, n)
    y = 5 + 1.5 * (x - off) + rng.normal(0, 4, n)
    return [(i, float(a), None if rng.random() < 0.3 else float(b)) for i, (a, b) in enumerate(zip(x, y))]


def test_least_squares_keeps_digits_of_large_values(spark):
    rows = linear(off=1e8)
    df = spark.createDataFrame(rows, "unit_id long, x double, y double")
    fit = impute.least_squares(df, impute.dummies({}, ["x"]), "y", ridge=0.0)
    seen = np.array([(a, b) for _, a, b in rows if b is not None])
    want = np.polyfit(seen[:, 0] - 1e8, seen[:, 1], 1)
    assert fit.beta[1] == pytest.approx(want[0], rel=1e-6) and fit.rows == len(seen)


def test_coefficients_vary_between_imputations_as_theory_says(spark):
    rows = linear(400)
    df = spark.createDataFrame(rows, "unit_id long, x double, y double")
    fit = impute.least_squares(df, impute.dummies({}, ["x"]), "y")
    seen = np.array([(1.0, a, b) for _, a, b in rows if b is not None])
    x, y = seen[:, :2], seen[:, 2]
    rss = ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()
    assert fit.rss == pytest.approx(rss, rel=1e-6)
    draws = np.array([fit.draw(3, i) for i in range(4000)])
    want = rss / (len(y) - 4) * np.linalg.inv(x.T @ x)  # the mean of the inverse chi-square
    assert np.allclose(np.cov(draws.T), want, rtol=0.1)
    assert np.allclose(draws.mean(0), fit.beta, atol=4 * np.sqrt(np.diag(want) / 4000).max())


def test_proper_imputations_spread_between_sets(spark):
    """Few donors and many open values: the sets differ by their coefficients, or hardly at all."""
    rng = np.random.default_rng(12)
    rows = [(i, float(rng.normal(3, 2)), None) for i in range(2500)]
    rows = [(i, x, 5 + 1.5 * x + float(rng.normal(0, 4)) if i < 80 else None) for i, x, _ in rows]
    df = spark.createDataFrame(rows, "unit_id long, x double, y double")
    spread = {}
    for proper in (False, True):
        made = impute.impute_pmm(df, "y", {}, ["x"], donors=5, m=20, proper=proper)
        assert made.count() == 20 * len(rows) and made.where("y is null").count() == 0
        means = [r.m for r in made.where("unit_id >= 80").groupBy("imp").agg(F.avg("y").alias("m")).collect()]
        spread[proper] = np.var(means, ddof=1)
    theory = 16 / 80  # of the line at the mean of x
    assert spread[True] > 8 * spread[False] and theory / 3 < spread[True] < 3 * theory


def test_seeds_together_equal_each_alone(spark):
    rng = np.random.default_rng(4)
    rows = [(*r[:4], None if rng.random() < 0.2 else r[4], r[5]) for r in make(seed=14)]
    units = spark.createDataFrame(rows, "unit_id long, cluster_id long, arm string, s string, baseline double, outcome double")
    factors = {"arm": ARMS, "s": ("p", "q")}
    every = impute.impute_pmm(units, "baseline", factors, seeds=(4, 9), m=2, proper=True)
    for seed in (4, 9):
        one = impute.impute_pmm(units, "baseline", factors, seed=seed, m=2, proper=True)
        assert sorted(one.collect()) == sorted(every.where(F.col("seed") == seed).drop("seed").collect())
    f = model.Formula("outcome", "cluster_id", factors, ("baseline",))
    found = interim.seed_pipeline(units, f, factors, (4, 9), mincor=0.0, ndraws=30)
    assert {r.seed for r in found.decisions().collect()} == {4, 9}
    assert {(r.seed, r.contrast) for r in found.contrasts().collect()} == {(s, c) for s in (4, 9) for c in ("H-Ctrl", "L-Ctrl", "L-H")}


def test_variance_shares_equal_those_of_all_predictions(spark):
    """Without noise exactly; with it on average, as the closed form takes the residual's variance itself."""
    df = spark.createDataFrame(make(seed=15), SCHEMA).withColumn("g", F.col("cluster_id") % 2)
    df = df.withColumn("s", F.when(F.col("unit_id") % 9 > 0, F.col("s"))).cache()
    fit = model.fit_random_intercept(df, FORMULA, ["g"])
    draws = model.draws_from_fit(fit, 12).cache()
    got = predict.variance_shares(df, draws, FORMULA, fit.cluster_means, ["g"], noise=False)
    got = {(r.g, r.draw): r.ratio for r in got.collect()}
    assert len(got) == 24
    for g in (0, 1):
        rows, own = df.where(F.col("g") == g), draws.where(F.col("g") == g).drop("g")
        means = fit.cluster_means.where(F.col("g") == g).drop("g")
        parts = [model.score_draws(rows, own, FORMULA, means, noise=False, cluster_effect=e) for e in (True, False)]
        whole, without = ({r.draw: r.v for r in p.groupBy("draw").agg(F.var_samp("pred").alias("v")).collect()} for p in parts)
        for d in whole:
            assert got[g, d] == pytest.approx(without[d] / whole[d], rel=1e-9)
    noisy = predict.variance_shares(df, draws, FORMULA, fit.cluster_means, ["g"])
    closed = np.mean([r.ratio for r in noisy.collect()])
    assert 0.5 < closed < 1.3
    summary = interim.variance_from_fit(df, FORMULA, ["g"], 40).collect()
    assert {r.g for r in summary} == {0, 1} and all(r.lower <= r.median <= r.upper and r.n_draws == 40 for r in summary)
    all_rows = predict.variance_shares(df, draws.where("g = 0").drop("g"), FORMULA, fit.cluster_means.where("g = 0").drop("g"), noise=False)
    assert all_rows.count() == 12
