"""Every registered query on the smallest tables against its SQL in another engine."""

import glob
import math
import os

import duckdb
import pytest

from __spark_entry__ import entry
from trialweave.catalog.oracle import SQL
from trialweave.catalog.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"


SKEWED = (
    "q_filter_in",
    "q_filter_not_in",
    "q_reallocate",
    "q_cluster_mean",
    "q_harmonise",
    "q_icc",
    "q_interim_data",
    "q_two_stage_data",
    "q_within_arm_data",
    "q_first_per_cluster",
    "q_test_ranksum",
)


def connect(folder):
    c = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """The tables with one cluster and one unit holding a third of all rows."""
    out = str(tmp_path_factory.mktemp("skewed"))
    c = duckdb.connect()
    changes = {
        "orders": "replace (case when o_orderkey % 3 = 0 then 7 else o_custkey end as o_custkey)",
        "lineitem": "replace (case when l_partkey % 3 = 0 then 5 else l_orderkey end as l_orderkey)",
    }
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path)[:-8]
        c.execute(
            f"copy (select * {changes.get(name, '')} from '{path}') to '{out}/{name}.parquet' (format parquet)"
        )
    return out


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6) or (math.isnan(a) and math.isnan(b))
    return a == b


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    check(spark, con, FOLDER, name)


@pytest.mark.parametrize("name", SKEWED)
def test_equals_sql_with_hot_keys(spark, skewed, name):
    check(spark, connect(skewed), skewed, name)


def check(spark, con, folder, name):
    df = REGISTRY[name](spark, folder)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    got = [tuple(r) for r in df.select(*sorted(names)).collect()]
    at = [names.index(n) for n in sorted(names)]
    want = [tuple(r[i] for i in at) for r in cur.fetchall()]
    assert len(got) == len(want)
    order = lambda r: repr(tuple(round(x, 3) if isinstance(x, float) else x for x in r))
    for g, w in zip(sorted(got, key=order), sorted(want, key=order)):
        assert all(close(x, y) for x, y in zip(g, w)), (g, w)


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(SQL)))
def test_runs(spark, name):
    assert REGISTRY[name](spark, FOLDER).collect()


def test_entry(spark):
    assert entry(spark).count() > 0
