"""Physical plans: what must and must not be in them."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from trialweave.bindings import Views
from trialweave.operators import cohort, joins, ranges
from trialweave.session import cut_lineage

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    [
        "q_slot_join", "q_reallocate", "q_right_join", "q_cluster_mean", "q_tbl_strata", "q_test_chisq",
        "q_contrasts_by", "q_counterfactual", "q_harmonise", "q_score_mean", "q_interim_data",
        "q_seed_compare", "q_stack_imp",
    ],
)
def test_no_cross_joins(spark, name):
    text = plan(queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_interim_cut_reaches_both_scans(spark):
    text = plan(queries()["q_interim_cut"](spark, FOLDER))
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(o_custkey", text)
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(c_custkey", text)


def test_only_needed_columns_are_read(spark):
    text = plan(queries()["q_decision_probs"](spark, FOLDER))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    read = {c.split(":")[0] for s in schemas for c in s.split(",")}
    needed = {"o_custkey", "o_totalprice", "c_custkey", "c_acctbal"}
    assert needed <= read <= needed | {"o_orderkey"}  # the order key spreads hot clusters


def test_attributes_and_measurements_share_one_shuffle(spark):
    from trialweave.plans.harmonise import recode_long

    rows = spark.createDataFrame([], Views(spark, FOLDER).long_source.schema)
    assert plan(recode_long(rows)).count("Exchange hashpartitioning") == 1


def test_numbering_beyond_one_task_never_windows_over_a_whole_group(spark):
    df = spark.range(5000).select(F.col("id").alias("cluster_id"), F.lit("s").alias("s"))
    text = plan(ranges.number_rows(df, ["s"], ["cluster_id"], range_rows=50))
    windows = re.findall(r"Window \[row_number\(\)[^\n]*", text)
    assert windows and all("_range" in w for w in windows)


def test_cut_lineage_writes_to_the_named_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    df = cut_lineage(spark.range(10), "x")
    assert all(f.startswith("file://" + shared) or f.startswith("file:" + shared) for f in df.inputFiles())
    assert plan(df).count("Range") == 0


def test_first_rows_are_limited_before_the_shuffle(spark):
    text = plan(cohort.representative_units(Views(spark, FOLDER).bare_units))
    before, after = text.split("Exchange hashpartitioning(cluster_id", 1)
    assert "WindowGroupLimit" in before and "WindowGroupLimit" in after


def test_cold_keys_are_not_copied(spark):
    facts = spark.range(2000).select("id", (F.col("id") % 500).alias("k"))
    keyed = spark.range(500).select(F.col("id").alias("k"), (F.col("id") + 1).alias("v"))
    assert joins.hot_keys(facts, "k") == {}
    assert "Generate" not in plan(joins.attach(facts, keyed, "k", ["id"]))


@pytest.mark.parametrize("how", ["attach", "left_join"])
def test_hot_and_missing_keys_are_spread(spark, how):
    """Half the keys missing, a third one key: no task gets twice the mean."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        k = F.when(F.col("id") % 2 == 0, None).when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000)
        facts = spark.range(60_000).select("id", k.cast("long").alias("k"))
        keyed = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") + 1).alias("v"))
        if how == "attach":
            out = joins.attach(facts, keyed, "k", ["id"])
        else:
            out = joins.left_join(facts, keyed.withColumnRenamed("k", "r"), "k", "r")
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 60_000 and max(sizes) < 2 * 60_000 / 8
        assert out.where("v = k + 1").count() == out.where("k is not null").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
