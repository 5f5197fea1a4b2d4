"""Numbering, quantiles, joins, unions, pivots and assignment."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from trialweave.operators import cohort, joins, ranges, reshape


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("limit", [None, 0])
def test_row_numbers_match_brute_force(spark, limit):
    rng = np.random.default_rng(1)
    data = [(int(i), "hot" if rng.random() < 0.6 else str(int(i) % 3)) for i in rng.permutation(3000)]
    data += [(10_000 + i, None) for i in range(5)]
    df = spark.createDataFrame(data, "id long, g string").repartition(7)
    got = dict(rows(ranges.number_rows(df, ["g"], ["id"], "no", limit), "id", "no"))
    want, seen = {}, {}
    for i, g in sorted(data):
        seen[g] = seen.get(g, 0) + 1
        want[i] = seen[g]
    assert got == want


@pytest.mark.parametrize("limit", [None, 0])
def test_quantiles_match_numpy(spark, limit):
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=997).round(2), "b": np.r_[np.zeros(700), rng.exponential(size=351)], "c": [4.0]}
    data = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("z", None)]
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    probs = {"lo": 0.025, "mid": 0.5, "hi": 0.975}
    for kind, method in (("linear", "linear"), ("average", "averaged_inverted_cdf")):
        got = {r.g: r for r in ranges.group_quantiles(df, ["g"], "x", probs, kind, limit).collect()}
        assert set(got) == set(groups)
        for g, xs in groups.items():
            assert got[g].n_values == len(xs)
            for name, p in probs.items():
                assert got[g][name] == pytest.approx(float(np.quantile(xs, p, method=method)), abs=1e-12)


def test_quantile_hand_cases(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", float(x)) for x in (1, 2, 3, 4, 5)], "g string, x double")
    quartiles = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    for limit in (None, 0):
        got = ranges.group_quantiles(df, ["g"], "x", quartiles, "average", limit)
        assert rows(got, "g", "q1", "q2", "q3") == [("a", 1.5, 2.5, 3.5), ("b", 2.0, 3.0, 4.0)]


def test_quantiles_without_groups(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    for limit in (None, 0):
        got = ranges.group_quantiles(df, [], "x", {"m": 0.5}, "linear", limit).collect()
        assert [(r.n_values, r.m) for r in got] == [(1001, 500.0)]


def test_sampled_cut_points_change_no_result(spark, monkeypatch):
    df = spark.range(20_000).select(
        F.pmod(F.xxhash64("id"), F.lit(997)).cast("double").alias("x"), (F.col("id") % 2).alias("g")
    )
    probs = {"a": 0.1, "b": 0.5}
    want = rows(ranges.group_quantiles(df, ["g"], "x", probs), "g", "a", "b")
    monkeypatch.setattr(ranges, "CUT_SAMPLE", 200)
    assert len(ranges.plan_ranges(df, "x", 0).cuts) >= 2
    assert rows(ranges.group_quantiles(df, ["g"], "x", probs, "linear", 0), "g", "a", "b") == want
    monkeypatch.setattr(ranges, "CUT_SAMPLE", 0)
    assert rows(ranges.group_quantiles(df, ["g"], "x", probs, "linear", 0), "g", "a", "b") == want


def test_first_row_puts_missing_last(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, 2, "y"), (2, None, "z")], "u int, t int, v string")
    assert rows(cohort.first_row(df, ["u"], ["t"]), "u", "v") == [(1, "y"), (2, "z")]
    plan = cohort.first_row(df, ["u"], ["t"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_blocks_hold_each_arm_once(spark):
    df = spark.createDataFrame([(i, "s") for i in range(7)] + [(99, None)], "cluster_id long, s string")
    got = cohort.assign_blocks(df, ["s"], ("Ctrl", "H", "L"), 1).orderBy("cluster_id").collect()
    assert [r.block_id for r in got] == [0, 0, 0, 1, 1, 1, 2]
    for b in (0, 1):
        assert sorted(r.treatment for r in got if r.block_id == b) == ["Ctrl", "H", "L"]


def test_strata_share_the_sequence_unless_asked(spark):
    df = spark.createDataFrame([(i, "s" if i % 2 else "t") for i in range(600)], "cluster_id long, s string")
    same = cohort.assign_blocks(df, ["s"], seed=5)
    by = {s: [r.treatment for r in same.where(F.col("s") == s).orderBy("cluster_id").collect()] for s in "st"}
    assert by["s"] == by["t"]
    other = cohort.assign_blocks(df, ["s"], seed=5, independent_strata=True)
    by = {s: [r.treatment for r in other.where(F.col("s") == s).orderBy("cluster_id").collect()] for s in "st"}
    assert by["s"] != by["t"]
    orders = {tuple(by["s"][i : i + 3]) for i in range(0, 300, 3)}
    assert len(orders) == 6


def test_assignment_ignores_partitioning(spark):
    df = spark.range(500).select(F.col("id").alias("cluster_id"), (F.col("id") % 4).alias("s"))
    want = rows(cohort.assign_blocks(df.coalesce(1), ["s"], seed=3), "cluster_id", "treatment")
    assert rows(cohort.assign_blocks(df.repartition(8), ["s"], seed=3), "cluster_id", "treatment") == want


def test_attach_is_exact_with_hot_keys(spark):
    facts = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 400).alias("k")
    )
    keyed = spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert 7 in joins.hot_keys(facts, "k")
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = facts.join(keyed, "k", how)
        got = joins.attach(facts, keyed, "k", ["id"], how)
        assert sorted(got.columns) == sorted(plain.columns)
        key = lambda r: tuple((x is None, x) for x in r)
        columns = sorted(plain.columns)
        assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(
            map(tuple, plain.select(*columns).collect()), key=key
        )
    with pytest.raises(ValueError):
        joins.attach(facts, keyed, "k", ["id"], "right")


def test_attach_spreads_a_hot_key(spark):
    facts = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    keyed = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in off}
    try:
        for k, x in off.items():
            spark.conf.set(k, x)
        sizes = joins.attach(facts, keyed, "k", ["id"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)
    assert max(r["count"] for r in sizes) < 4000


def test_left_join_matches_missing_keys(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (None, "y")], "rk int, r string")
    assert sorted(rows(joins.left_join(left, right, "k", "rk").fillna("-"), "l", "r")) == [("a", "x"), ("b", "y"), ("c", "-")]


def test_unassigned_units_are_counted_and_dropped(spark):
    units = spark.createDataFrame([(1, 10, "H", "s"), (2, 11, "H", None)], "unit_id long, cluster_id long, arm string, s string")
    assigned = cohort.assign_blocks(units.select("cluster_id", "s"), ["s"])
    placed = joins.attach_new_arm(units, assigned)
    assert joins.count_unassigned(placed).first()[0] == 1
    preds = units.select("unit_id", F.explode(F.array(*map(F.lit, ("Ctrl", "H", "L")))).alias("arm"), F.lit(1.0).alias("pred"))
    assert rows(joins.predictions_matched(placed, preds), "unit_id") == [(1,)]


def test_right_join_with_filter_is_inner(spark):
    units = spark.createDataFrame([(1, 10, "H")], "unit_id long, cluster_id long, arm string")
    preds = spark.createDataFrame([(1, "H", 1.0), (1, "L", 2.0)], "unit_id long, arm string, pred double")
    outer = joins.predictions_right(units, preds)
    assert outer.count() == 2
    kept = outer.where(F.col("cluster_id").isNotNull())
    assert rows(kept, "unit_id", "arm", "pred") == rows(joins.predictions_matched(units, preds), "unit_id", "arm", "pred")


def test_unions(spark):
    a = spark.createDataFrame([(1, "v")], "k int, v string")
    b = spark.createDataFrame([(2, "w")], "k int, w string")
    assert rows(reshape.union_fill(a, b).fillna("-"), "k", "v", "w") == [(1, "v", "-"), (2, "-", "w")]
    with pytest.raises(AnalysisException):
        reshape.union_strict(a, b)


def test_pivot_and_duplicates(spark):
    df = spark.createDataFrame([("u1", 1, 10.0), ("u1", 2, 20.0), ("u2", 1, 5.0), ("u2", 1, 4.0)], "u string, t int, v double")
    got = reshape.pivot_time(df, "u", "t", "v", {1: "one", 2: "two"}).fillna(-1.0)
    assert rows(got, "u", "one", "two") == [("u1", 10.0, 20.0), ("u2", 4.0, -1.0)]
    assert rows(reshape.duplicate_keys(df, ["u", "t"]), "u", "t", "n_rows") == [("u2", 1, 2)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_stack_and_expand(spark):
    df = spark.createDataFrame([(7, "H"), (3, "L")], "unit_id long, arm string")
    stacked = reshape.stack_imputations(df, 2)
    assert rows(stacked, "imp", "id", "unit_id") == [(1, 1, 3), (1, 2, 7), (2, 1, 3), (2, 2, 7)]
    wide = reshape.expand_arms(df, ("Ctrl", "H", "L"))
    assert wide.count() == 6
    assert rows(wide.where(F.col("unit_id") == 7), "old_arm", "arm") == [("H", "Ctrl"), ("H", "H"), ("H", "L")]
