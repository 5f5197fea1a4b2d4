"""Descriptive tables, tests, screening and matching against hand cases and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.functions import noise, tails
from trialweave.operators import ranges, describe, hypothesis, impute


def frame(spark, columns, data):
    return spark.createDataFrame(data, columns)


def test_chi_square_hand_case(spark):
    data = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 20 + [("b", "y")] * 10 + [("b", None), (None, "x")]
    r = hypothesis.chi_square(frame(spark, "g string, v string", data), "g", "v").first()
    assert (r.df, r.min_expected) == (1, 15.0)
    assert r.statistic == pytest.approx(6.666667, abs=1e-6)
    assert r.p_value == pytest.approx(0.009823, abs=1e-6)


def test_chi_square_with_an_empty_cell(spark):
    data = [("a", "x")] * 4 + [("b", "y")] * 6 + [("b", "z")] * 2
    r = hypothesis.chi_square(frame(spark, "g string, v string", data), "g", "v").first()
    table = np.array([[4, 0, 0], [0, 6, 2]])
    expected = np.outer(table.sum(1), table.sum(0)) / table.sum()
    assert r.statistic == pytest.approx(((table - expected) ** 2 / expected).sum())
    assert r.df == 2


@pytest.mark.parametrize("df", [1, 2, 3, 4, 7, 10])
def test_chi_square_tail(df):
    x = np.linspace(0, 400, 2_000_001)[1:]
    density = np.exp((df / 2 - 1) * np.log(x) - x / 2 - math.lgamma(df / 2) - df / 2 * math.log(2))
    for at in (0.5, 3.0, 12.0):
        tail = np.trapezoid(density[x >= at], x[x >= at])
        assert tails.chisq_tail_value(at, df) == pytest.approx(tail, abs=2e-4)
    assert tails.chisq_tail_value(0.0, df) == 1.0


def test_rank_sum_hand_case(spark):
    df = frame(spark, "g string, v double", [("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 2.0), ("b", 3.0), ("b", None)])
    r = hypothesis.rank_sum(df, "g", "v", ("a", "b")).first()
    assert (r.w, r.tie_term) == (1.0, 24.0)
    assert r.z == pytest.approx(-0.968246, abs=1e-6)
    assert r.p_value == pytest.approx(math.erfc(0.968246 / math.sqrt(2)), abs=1e-6)


def test_rank_sum_by_ranges_equals_single(spark):
    rng = np.random.default_rng(3)
    data = [("a" if rng.random() < 0.4 else "b", float(rng.integers(0, 60)) if rng.random() < 0.7 else 5.0) for _ in range(4000)]
    df = frame(spark, "g string, v double", data).repartition(6)
    one = hypothesis.rank_sum(df, "g", "v", ("a", "b"), range_rows=None).first()
    many = hypothesis.rank_sum(df, "g", "v", ("a", "b"), range_rows=50).first()
    assert (one.w, one.tie_term) == (many.w, many.tie_term)
    assert one.z == pytest.approx(many.z)
    v = np.array([x for _, x in data])
    a = np.array([g == "a" for g, _ in data])
    less = (v[a][:, None] > v[~a][None]).sum() + 0.5 * (v[a][:, None] == v[~a][None]).sum()
    assert one.w == less


def fisher_brute(n11, n12, n21, n22):
    r1, c1, n = n11 + n12, n11 + n21, n11 + n12 + n21 + n22
    p = {k: math.comb(r1, k) * math.comb(n - r1, c1 - k) / math.comb(n, c1) for k in range(max(0, r1 + c1 - n), min(r1, c1) + 1)}
    return sum(x for x in p.values() if x <= p[n11] * (1 + 1e-7))


@pytest.mark.parametrize("cells", [(3, 1, 1, 3), (0, 5, 9, 40), (12, 3, 300, 45), (2, 0, 0, 0)])
def test_fisher(spark, cells):
    labels = [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]
    data = [pair for pair, n in zip(labels, cells) for _ in range(n)]
    r = hypothesis.fisher_2x2(frame(spark, "g string, v string", data), "g", "v", ("a", "b"), ("x", "y")).first()
    assert (r.n11, r.n12, r.n21, r.n22) == cells
    assert r.p_value == pytest.approx(fisher_brute(*cells), abs=1e-9)
    if cells == (3, 1, 1, 3):
        assert r.p_value == pytest.approx(0.485714, abs=1e-6)


def test_fisher_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(hypothesis, "FISHER_CHUNK", 7)
    labels = [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]
    data = [pair for pair, n in zip(labels, (30, 70, 55, 60)) for _ in range(n)]
    r = hypothesis.fisher_2x2(frame(spark, "g string, v string", data), "g", "v", ("a", "b"), ("x", "y")).first()
    assert r.p_value == pytest.approx(fisher_brute(30, 70, 55, 60), abs=1e-9)


def test_group_comparison_chooses_the_test(spark):
    data = [(0, "x", "u", 1.0)] * 20 + [(1, "y", "u", 2.0)] * 20 + [(1, "x", "w", 3.0)] * 2 + [(2, "x", "w", 9.0)]
    df = frame(spark, "g int, v string, s string, c double", data)
    got = {r.variable: r for r in hypothesis.compare_groups(df, "g", (0, 1), {"v": ("x", "y"), "s": ("u", "w")}, ["c"]).collect()}
    assert (got["v"].test, got["s"].test, got["c"].test) == ("chisq", "fisher", "rank_sum")
    assert got["s"].p_value == pytest.approx(fisher_brute(20, 0, 20, 2), abs=1e-9)
    assert all(0 <= r.p_value <= 1 for r in got.values())


def test_icc_hand_case(spark):
    df = frame(spark, "c string, y double", [("A", 1.0), ("A", 3.0), ("B", 5.0), ("B", 7.0), ("B", None)])
    assert describe.icc(df, "y", "c").first().icc == pytest.approx(0.777778, abs=1e-6)


def test_summary_tables(spark):
    df = frame(spark, "g string, v string, x double", [("a", "p", 1.0), ("a", "q", 2.0), ("a", None, None), ("a", "p", 3.0), ("b", "q", 4.0)])
    cat = {(r.g, r.level): (r.n, r.pct) for r in describe.summarise_categorical(df, ["g"], ["v"]).collect()}
    assert cat[("a", "p")][0] == 2 and cat[("a", "p")][1] == pytest.approx(200 / 3)
    con = {r.g: (r.q1, r.median, r.q3) for r in describe.summarise_continuous(df, ["g"], ["x"]).collect()}
    assert con == {"a": (1.0, 2.0, 3.0), "b": (4.0, 4.0, 4.0)}
    mis = {(r.g, r.variable): (r.n_rows, r.n_missing) for r in describe.summarise_missing(df, ["g"], ["v", "x"]).collect()}
    assert mis[("a", "v")] == (4, 1) and mis[("b", "x")] == (1, 0)
    flat = describe.flatten_summary(df, ["g"], ["v"], ["x"])
    assert flat.columns == ["g", "variable", "level", "stat", "value"]


def test_group_mean_of_missing_is_missing(spark):
    df = frame(spark, "u int, c int, x double", [(1, 1, 2.0), (2, 1, None), (3, 2, None), (4, None, 5.0)])
    got = {r.u: r.m for r in describe.group_mean(df, "c", "x", "m", ["u"]).collect()}
    assert got == {1: 2.0, 2: 2.0, 3: None, 4: None}


def test_predictor_screening(spark):
    rng = np.random.default_rng(4)
    data = []
    for i in range(2000):
        a, b, c = (float(x) for x in rng.normal(size=3))
        data.append((None if c > 1.0 else a + 0.1 * b, a, b, c, 1.0))
    df = frame(spark, "y double, near double, weak double, hides double, fixed double", data)
    got = {r.predictor: r for r in impute.select_predictors(df, "y", ["near", "weak", "hides", "fixed"], 0.15).collect()}
    y, near = (np.array([r[i] for r in data if r[0] is not None]) for i in (0, 1))
    assert got["near"].cor_value == pytest.approx(np.corrcoef(y, near)[0, 1])
    gone = np.array([r[0] is None for r in data], dtype=float)
    assert got["hides"].cor_missing == pytest.approx(np.corrcoef([r[3] for r in data], gone)[0, 1])
    assert [got[k].keep for k in ("near", "weak", "hides", "fixed")] == [True, False, True, False]
    found = {(r.column_name, r.other): r.finding for r in impute.audit_columns(df.withColumn("twin", F.col("near") * -3), ["near", "twin", "fixed"]).collect()}
    assert found == {("fixed", ""): "constant", ("near", "twin"): "collinear"}


def allowed_donors(donors, target, k):
    """Donors nearer than the k-th distance or at it."""
    far = sorted(abs(d[1] - target) for d in donors)[min(k, len(donors)) - 1]
    return {d[0] for d in donors if abs(d[1] - target) <= far}


@pytest.mark.parametrize("rows", [None, 50])
@pytest.mark.parametrize("k", [1, 5])
def test_drawn_donors_are_among_the_nearest(spark, k, rows):
    rng = np.random.default_rng(5)
    values = np.r_[rng.integers(0, 40, 300) / 4.0, rng.normal(500, 1, 200).round(3), np.full(150, 7.25)]
    donors = [(int(i), float(v), float(i)) for i, v in zip(rng.permutation(len(values)), values)]
    targets = [float(x) for x in np.r_[rng.uniform(-50, 900, 200).round(2), np.full(300, 7.25), values[:40], np.full(100, 5000.0)]]
    d = frame(spark, "donor_id long, yhat double, y double", donors).repartition(5)
    t = frame(spark, "unit_id long, imp int, yhat double", [(i, 1, x) for i, x in enumerate(targets)]).repartition(3)
    got = impute.draw_donors(d, t, k, seed=3, range_rows=rows).collect()
    assert len(got) == len(targets)
    pools = {x: allowed_donors(donors, x, k) for x in set(targets)}
    where = {i: v for i, v, _ in donors}
    for r in got:
        assert r.donor_id in pools[r.yhat] and r.y == float(r.donor_id)
        assert r.distance == abs(where[r.donor_id] - r.yhat)
    again = impute.draw_donors(d.repartition(2), t, k, seed=3, range_rows=200).collect()
    assert {r.unit_id: r.donor_id for r in got} == {r.unit_id: r.donor_id for r in again}


@pytest.mark.parametrize("levels", [(7.0,), (6.0, 8.0)])
def test_tied_donors_are_used_evenly(spark, levels):
    """400 donors at one distance, on one side or both: 4,000 targets use all of them about equally."""
    d = spark.range(400).select(
        F.col("id").alias("donor_id"),
        F.element_at(F.array(*[F.lit(x) for x in levels]), (F.col("id") % len(levels) + 1).cast("int")).alias("yhat"),
        F.col("id").cast("double").alias("y"),
    )
    t = spark.range(4000).select(F.col("id").alias("unit_id"), F.lit(1).alias("imp"), F.lit(7.0).alias("yhat"))
    used = [r["count"] for r in impute.draw_donors(d, t, 5, seed=1).groupBy("donor_id").count().collect()]
    assert len(used) == 400 and max(used) < 30 and sum(used) == 4000


def test_nearest_donor_hand_case(spark):
    d = frame(spark, "donor_id long, yhat double, y double", [(1, 1.0, 10.0), (2, 3.0, 30.0)])
    t = frame(spark, "unit_id long, imp int, yhat double", [(1, 1, 1.9), (2, 1, 2.1)])
    assert {r.yhat: r.y for r in impute.draw_donors(d, t, 1).collect()} == {1.9: 10.0, 2.1: 30.0}
    tied = frame(spark, "unit_id long, imp int, yhat double", [(i, 1, 2.0) for i in range(40)])
    assert {r.y for r in impute.draw_donors(d, tied, 1).collect()} == {10.0, 30.0}


def test_one_path_for_missing_and_odd_numbers(spark):
    """NULL, NaN, infinities and repeats rank alike in one range and in many."""
    values = [None, float("nan"), float("inf"), float("-inf"), *([2.5] * 30), *map(float, range(200)), None, float("nan")]
    df = frame(spark, "id long, g int, v double", [(i, i % 2, v) for i, v in enumerate(values)]).repartition(4)
    probs = {"low": 0.25, "mid": 0.5, "top": 1.0}
    outs = [sorted(map(repr, ranges.group_quantiles(df, ["g"], "v", probs, range_rows=n).collect())) for n in (None, 20)]
    assert outs[0] == outs[1] and len(outs[0]) == 2
    numbered = [
        sorted((r.id, r.rownumber) for r in ranges.number_rows(df, ["g"], ["v", "id"], range_rows=n).collect())
        for n in (None, 20)
    ]
    assert numbered[0] == numbered[1] and len(numbered[0]) == len(values)
    sums = [repr(hypothesis.rank_sum(df, "g", "v", (0, 1), range_rows=n).first()) for n in (None, 20)]
    assert sums[0] == sums[1]


def test_imputation_uses_observed_neighbours(spark):
    rng = np.random.default_rng(6)
    data = []
    for i in range(1500):
        x, g = float(rng.normal()), "abc"[int(rng.integers(0, 3))]
        y = 10 * x + {"a": 0, "b": 5, "c": 9}[g] + float(rng.normal())
        data.append((i, None if rng.random() < 0.2 else y, x, None if rng.random() < 0.05 else g))
    df = frame(spark, "unit_id long, y double, x double, g string", data)
    factors = {"g": ("a", "b", "c")}
    got = impute.impute_pmm(df, "y", factors, ["x"], donors=5, m=2, seed=9)
    rows = {(r.unit_id, r.imp): r for r in got.collect()}
    assert len(rows) == 3000
    observed = {r[1] for r in data if r[1] is not None}
    for i, y, x, g in data:
        for imp in (1, 2):
            r = rows[(i, imp)]
            if y is not None:
                assert r.y == y
            elif g is None:
                assert r.y is None
            else:
                assert r.y in observed
                assert abs(r.y - (10 * x + {"a": 0, "b": 5, "c": 9}[g])) < 8
    again = impute.impute_pmm(df.repartition(3), "y", factors, ["x"], donors=5, m=2, seed=9, range_rows=50)
    assert {(r.unit_id, r.imp): r.y for r in again.collect()} == {k: r.y for k, r in rows.items()}


def test_hash_noise_is_normal_and_stable(spark):
    z = noise.hash_normal(F.col("id"), seed=1).alias("z")
    a = [r.z for r in spark.range(20_000).select("id", z).orderBy("id").collect()]
    b = [r.z for r in spark.range(20_000).repartition(7).select("id", z).orderBy("id").collect()]
    assert a == b
    assert abs(np.mean(a)) < 0.03 and abs(np.std(a) - 1) < 0.03
    assert abs(np.mean(np.array(a) ** 4) - 3) < 0.25
    picks = [r[0] for r in spark.range(6000).select(noise.hash_pick(F.lit(3), F.col("id"), seed=2)).collect()]
    assert set(picks) == {1, 2, 3} and abs(picks.count(2) - 2000) < 200


def test_target_rows_only_look_up_their_place(spark):
    donors = spark.createDataFrame([(i, float(i // 3), i / 10) for i in range(60)], "donor_id long, yhat double, y double")
    targets = spark.createDataFrame([(900 + i, 1, i * 0.37) for i in range(40)], "unit_id long, imp int, yhat double")
    drawn = impute.draw_donors(donors, targets, 5, seed=1)
    assert "lambda" not in drawn._jdf.queryExecution().optimizedPlan().toString()
    for r in drawn.collect():
        near = sorted(abs(d // 3 - r.yhat) for d in range(60))[:5]
        assert r.distance in near and r.distance == abs(r.donor_id // 3 - r.yhat) and r.y == r.donor_id / 10


def test_ranges_do_not_grow_with_the_rows(spark):
    df = spark.range(20_000).select(F.col("id").cast("double").alias("v")).repartition(4)
    assert len(ranges.plan_ranges(df, "v", 5).cuts) < ranges.MOST_RANGES == 2_000
    got = ranges.group_quantiles(df, [], "v", {"low": 0.025, "high": 0.975}, range_rows=5).first()
    assert (got.n_values, got.low, got.high) == (20_000, pytest.approx(499.975), pytest.approx(19499.025))
