"""Trial-shaped views of the star-schema test tables.

Customers stand for clusters, orders for units, lineitem rows for measurements.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.functions.recode import recode_threshold
from trialweave.operators.joins import attach, hot_keys
from trialweave.operators.model import Formula
from trialweave.operators.reshape import pivot_time
from trialweave.schema import ARMS, REMOTENESS_LABELS

# Label sets of the test tables.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SES = ("Least", "Most")
IMPUTATIONS = 3


@dataclass(frozen=True)
class Views:
    spark: SparkSession
    folder: str

    @cached_property
    def _opened(self) -> dict[str, DataFrame]:
        return {}

    def table(self, name: str) -> DataFrame:
        """A raw table; its files are listed and its schema is read once."""
        if name not in self._opened:
            self._opened[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._opened[name]

    @cached_property
    def hot_clusters(self) -> list:
        """Clusters that may hold over 1% of the units, from one column of the unit table."""
        return hot_keys(self.table("orders"), "o_custkey")

    @cached_property
    def hot_units(self) -> list:
        """Units that may hold over 1% of the measurements."""
        return hot_keys(self.table("lineitem"), "l_orderkey")

    @cached_property
    def last_cluster(self) -> int:
        return self.table("customer").agg(F.max("c_custkey")).first()[0]

    def share_of_clusters(self, k: int) -> int:
        """Largest cluster id among the first k of 109 parts of the id range."""
        return k * self.last_cluster // 109

    @cached_property
    def clusters(self) -> DataFrame:
        c, n = self.table("customer"), self.table("nation")
        key = F.col("c_custkey")
        city = F.col("n_regionkey").isin(0, 1)
        return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
            key.alias("cluster_id"),
            F.when(city, REMOTENESS_LABELS[0]).otherwise(REMOTENESS_LABELS[1]).alias("remoteness"),
            F.col("c_mktsegment").alias("stype"),
            F.element_at(F.array(*[F.lit(a) for a in ARMS]), (key % 3 + 1).cast("int")).alias("arm"),
            F.when(key % 17 != 0, key % 10 + 1).alias("decile"),
        )

    @cached_property
    def measurements(self) -> DataFrame:
        """One row per measurement; a unit can have several per time."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("unit_id"),
            F.when(F.col("l_linenumber") <= 3, 1).otherwise(2).alias("time"),
            (F.col("l_extendedprice") / 1000).alias("value"),
        )

    @cached_property
    def measured(self) -> DataFrame:
        return pivot_time(self.measurements, "unit_id", "time", "value", {1: "baseline", 2: "outcome"})

    @cached_property
    def bare_units(self) -> DataFrame:
        """Units with their cluster's attributes, before measurements."""
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("unit_id"), F.col("o_custkey").alias("cluster_id")
        )
        cut = self.share_of_clusters(62)
        placed = attach(orders, self.clusters, "cluster_id", ["unit_id"], "inner", self.hot_clusters)
        return placed.withColumns(
            {
                "ses": recode_threshold("decile", 6, SES[1], SES[0]),
                "cohort": F.when(F.col("cluster_id") <= cut, 1).otherwise(0),
            }
        )

    @cached_property
    def units(self) -> DataFrame:
        return self.bare_units.join(self.measured, "unit_id", "left").select(
            "unit_id", "cluster_id", "remoteness", "stype", "arm", "decile", "ses",
            "baseline", "outcome", "cohort",
        )

    @cached_property
    def preds(self) -> DataFrame:
        """Stand-in predictions: every unit under every arm and imputation."""
        cells = [
            F.struct(F.lit(a).alias("arm"), F.lit(ix).alias("ix"), F.lit(i).alias("imp"))
            for ix, a in enumerate(ARMS)
            for i in range(1, IMPUTATIONS + 1)
        ]
        rows = self.bare_units.select(
            "unit_id", F.col("arm").alias("old_arm"), F.explode(F.array(*cells)).alias("c")
        )
        pred = F.col("unit_id") % 97 + 10 * F.col("c.ix") + F.col("c.imp")
        return rows.select("unit_id", "c.arm", "old_arm", pred.cast("double").alias("pred"), "c.imp")

    @cached_property
    def draws(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("cluster_id"), "o_totalprice")
        customers = self.table("customer").select(F.col("c_custkey").alias("cluster_id"), "c_acctbal")
        key = F.col("o_orderkey")
        return attach(
            orders, customers, "cluster_id", ["o_orderkey"], "inner", self.hot_clusters
        ).select(
            key.alias("draw"),
            (key % 5 + 1).alias("imp"),
            (key % 4 + 1).alias("chain"),
            ((F.col("o_totalprice") - 150000) / 10000).alias("b_h"),
            (F.col("c_acctbal") / 200 - 10).alias("b_l"),
        )

    @property
    def wide_source(self) -> DataFrame:
        """Raw rows of the one-row-per-unit trial: the clusters after the cohort cut."""
        late = self.units.where(F.col("cohort") == 0)
        return late.select(
            F.col("unit_id").alias("tname"),
            F.col("cluster_id").alias("schoolid"),
            "stype",
            F.col("remoteness").alias("RA_name"),
            F.col("decile").alias("Decile"),
            F.col("arm").alias("dose_fin"),
            F.col("baseline").alias("base_total_pa_fin"),
            F.col("outcome").alias("fu_total_pa_fin"),
        )

    @property
    def long_source(self) -> DataFrame:
        """Raw rows of the one-row-per-measurement trial: the clusters up to the cohort cut."""
        early = self.bare_units.where(F.col("cohort") == 1)
        rows = attach(
            self.measurements, early, "unit_id", ["time", "value"], "inner", self.hot_units
        )
        return rows.select(
            F.col("unit_id").alias("teacher_IDFIN"),
            F.col("cluster_id").alias("SCHOOLID"),
            "time",
            F.col("value").alias("total_paCTA"),
            F.when(F.col("arm") == "Ctrl", 2).otherwise(1).alias("intcont"),
            F.col("ses").alias("SEIFACAT16"),
            F.col("remoteness").alias("RemoteDICHOM16"),
            F.col("stype").alias("STYPE"),
        )

    @property
    def formula(self) -> Formula:
        return Formula(
            outcome="outcome",
            cluster="cluster_id",
            factors={"arm": ARMS, "ses": SES, "remoteness": REMOTENESS_LABELS, "stype": SEGMENTS},
            numeric=("baseline", "cohort"),
        )
