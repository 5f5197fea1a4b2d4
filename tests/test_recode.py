"""Recodes and filters: hand cases, above all for missing values."""

from pyspark.sql import functions as F

from trialweave.functions import recode as r
from trialweave.operators import joins
from trialweave.schema import LONG_SOURCE, WIDE_SOURCE
from trialweave.sources.tables import load_table, read_units_csv, save_table, write_units_csv


def values(df):
    return [row[0] for row in df.collect()]


def column(spark, data, kind):
    return spark.createDataFrame([(i, x) for i, x in enumerate(data)], f"i int, x {kind}").orderBy("i")


def test_threshold_keeps_missing(spark):
    df = column(spark, [5, 6, None], "int")
    assert values(df.select(r.recode_threshold("x", 6, "Most", "Least"))) == ["Most", "Least", None]


def test_member_sends_missing_to_other(spark):
    df = column(spark, ["Major Cities of Australia", "Inner Regional Australia", None], "string")
    got = values(df.select(r.recode_member("x", ["Major Cities of Australia"], "Major Cities", "Regional/Remote")))
    assert got == ["Major Cities", "Regional/Remote", "Regional/Remote"]


def test_equal_keeps_missing(spark):
    df = column(spark, [2, 1, None], "int")
    assert values(df.select(r.recode_equal("x", 2, "Ctrl", "H"))) == ["Ctrl", "H", None]


def test_levels_are_closed(spark):
    df = column(spark, ["H", "Ctrl", "X", None], "string")
    assert values(df.select(r.with_levels("x", ["Ctrl", "H"]))) == ["H", "Ctrl", None, None]
    assert values(df.select(r.level_index("x", ["Ctrl", "H"]))) == [2, 1, None, None]


def test_cohort_flag_and_id(spark):
    df = column(spark, ["62", "63", "x", None], "string")
    assert values(df.select(r.cohort_flag("x", 62))) == [1, 0, None, None]
    assert values(df.select(r.id_number("x"))) == [62, 63, None, None]


def test_not_in_keeps_missing(spark):
    df = column(spark, [1, 2, None], "int")
    assert values(df.where(r.not_in_list("x", [2, 4])).select("x")) == [1, None]
    assert values(df.where(r.in_list("x", [2, 4])).select("x")) == [2]


def test_listed_ids_as_table(spark):
    df = column(spark, [1, 2, None, 2], "int")
    ids = spark.createDataFrame([(2,), (4,), (None,)], "x int")
    for hot in ([], [2]):
        assert sorted(values(joins.keep_listed(df, ids, "x", ["i"], hot).select("i"))) == [1, 3]
        assert sorted(values(joins.drop_listed(df, ids, "x", ["i"], hot).select("i"))) == [0, 2]


def test_substitute_outcome(spark):
    df = spark.createDataFrame(
        [(0, None, "H", "L", 9.0), (1, 50.0, "H", "H", 9.0), (2, 50.0, "H", "L", 9.0)],
        "i int, y double, old string, new string, p double",
    ).orderBy("i")
    assert values(df.select(r.substitute_outcome("y", "old", "new", "p"))) == [None, 50.0, 9.0]
    assert values(df.select(r.substitute_outcome("y", "old", "new", "p", keep_missing=False))) == [9.0, 50.0, 9.0]


def test_nan_is_missing(spark):
    df = column(spark, [1.0, float("nan"), None], "double")
    assert values(df.select(r.missing_to_null("x"))) == [1.0, None, None]


def test_csv_missing_marks(spark, tmp_path):
    path = str(tmp_path / "units.csv")
    with open(path, "w") as f:
        f.write("tname,schoolid,stype,RA_name,Decile,dose_fin,base_total_pa_fin,fu_total_pa_fin,Allocation_Date\n")
        f.write("1,2,1,NA,NA,H,12.5,NA,2020-01-02\n")
        f.write("2,3,,Major,5,,NaN,7,NA\n")
        f.write("3,oops,2,Minor,6,L,,8,\n")
    rows = read_units_csv(spark, path, WIDE_SOURCE).orderBy("tname").collect()
    assert (rows[0].RA_name, rows[0].Decile, rows[0].fu_total_pa_fin) == (None, None, None)
    assert (rows[0].base_total_pa_fin, str(rows[0].Allocation_Date)) == (12.5, "2020-01-02")
    assert (rows[1].stype, rows[1].base_total_pa_fin, rows[1].fu_total_pa_fin) == (None, None, 7.0)
    assert (rows[2].schoolid, rows[2].base_total_pa_fin, rows[2].dose_fin) == (None, None, "L")
    kept = read_units_csv(spark, path, WIDE_SOURCE, blank_text=["stype", "dose_fin"]).orderBy("tname").collect()
    assert (kept[1].stype, kept[1].dose_fin, kept[0].RA_name) == ("", "", None)
    assert (kept[0].base_total_pa_fin, kept[1].base_total_pa_fin, kept[2].schoolid) == (12.5, None, None)
    assert len(LONG_SOURCE.fields) == 9


def test_csv_written_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "a"), (2, 2.5, None)], "k int, v double, s string")
    path = str(tmp_path / "out")
    write_units_csv(df, path)
    assert read_units_csv(spark, path, df.schema).orderBy("k").collect() == df.orderBy("k").collect()


def test_stage_table_prunes_imputations(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0)], "unit_id int, imp int, pred double")
    path = str(tmp_path / "preds")
    save_table(df, path, ["imp"])
    kept = load_table(spark, path).where(F.col("imp") == 2)
    assert [tuple(r) for r in kept.select("unit_id", "pred", "imp").collect()] == [(1, 3.0, 2)]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(imp" in plan
