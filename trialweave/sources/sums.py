"""Versioned sums per cluster in parquet: refits without reading a unit again.

Each version adds units to the store or takes them out; a cluster's sums are those of all versions together. Fits
leave out any clusters by leaving out their sums.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.functions.recode import not_in_list
from trialweave.operators import grams
from trialweave.operators.model import Fit, Formula, Priors, centring, design_rows, fit_from_sums

_ROW = ["own", "cluster", "salt", "count", "v"]


class SumStore:
    """Sums of the regression ``formula`` in ``path``, taken about fixed ``centre`` values so that versions add up."""

    def __init__(self, spark: SparkSession, path: str, formula: Formula, centre: Mapping[str, float]) -> None:
        self.spark, self.path, self.formula, self.centre = spark, path.rstrip("/"), formula, dict(centre)

    @classmethod
    def create(cls, units: DataFrame, formula: Formula, path: str) -> SumStore:
        """A new store whose version 0 holds ``units``."""
        store = cls(units.sparkSession, path, formula, centring(units, formula))
        about = {
            "outcome": formula.outcome,
            "cluster": formula.cluster,
            "factors": {k: list(v) for k, v in formula.factors.items()},
            "numeric": list(formula.numeric),
            "interactions": [list(i) for i in formula.interactions],
            "centre": store.centre,
        }
        row = store.spark.createDataFrame([(json.dumps(about),)], "about string")
        row.write.mode("errorifexists").parquet(f"{store.path}/about")
        store._write(units, 1.0, 0)
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SumStore:
        about = json.loads(spark.read.parquet(f"{path.rstrip('/')}/about").first().about)
        factors = {k: tuple(v) for k, v in about["factors"].items()}
        pairs = tuple(tuple(i) for i in about["interactions"])
        formula = Formula(about["outcome"], about["cluster"], factors, tuple(about["numeric"]), pairs)
        return cls(spark, path, formula, about["centre"])

    def latest(self) -> int:
        """The last version, from the folder names alone."""
        return self.spark.read.parquet(f"{self.path}/sums").agg(F.max("version")).first()[0]

    def add(self, units: DataFrame) -> int:
        """A version with further units, of new or known clusters; returns its number."""
        return self._write(units, 1.0, self.latest() + 1)

    def remove(self, units: DataFrame) -> int:
        """A version without these units, which were added as they are now given."""
        return self._write(units, -1.0, self.latest() + 1)

    def _write(self, units: DataFrame, sign: float, version: int) -> int:
        rows = design_rows(units, self.formula, (), self.centre).select(F.col("cluster").alias("own"), "cluster", "x", "y")
        width = len(self.formula.names) - 1
        made = grams.cluster_blocks(rows, ["own"], width, 1, lambda b: b.column(3).to_numpy()[:, None])

        def signed(batches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = [(np.frombuffer(x.as_buffer()) * sign).tobytes() for x in batch.column(4)]
                n = (batch.column(3).to_numpy() * sign).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), pa.array(v, pa.binary())], _ROW)

        added = grams.merged_clusters(made, ["own"])
        out = added if sign > 0 else added.mapInArrow(signed, added.schema)
        out.write.mode("errorifexists").parquet(f"{self.path}/sums/version={version}")
        return version

    def clusters(self, without: Iterable | DataFrame = (), as_of: int | None = None) -> DataFrame:
        """(own, cluster, salt, count, v): the sums of all clusters but the listed ones.

        Rows without ``cluster`` hold the cross products of the cluster ``own``. Clusters that all units have left
        are gone.
        """
        rows = self.spark.read.parquet(f"{self.path}/sums")
        if as_of is not None:
            rows = rows.where(F.col("version") <= as_of)
        rows = rows.drop("version")
        if isinstance(without, DataFrame):
            gone = without.select(F.col(without.columns[0]).alias("own")).distinct()
            rows = rows.join(gone, "own", "left_anti")
        else:
            rows = rows.where(not_in_list("own", list(without)))
        return rows

    def _merged(self, without: Iterable | DataFrame, as_of: int | None) -> DataFrame:
        salt = F.when(F.col("cluster").isNull(), F.pmod(F.xxhash64("own"), F.lit(grams.SALTS)).cast("int")).otherwise(F.lit(0))
        rows = self.clusters(without, as_of).select(F.lit(0).alias("_all"), "cluster", salt.alias("salt"), "count", "v")
        merged = grams.merged_clusters(rows, ["_all"])
        return merged.where(F.col("cluster").isNull() | (F.col("count") > 0))

    def totals(self, without: Iterable | DataFrame = (), as_of: int | None = None) -> DataFrame:
        """One row: n_clusters, n, and the sum of each design column and of the outcome, on the scale of the data."""
        names = [*self.formula.names[1:], self.formula.outcome]
        off = [self.centre.get(n, 0.0) for n in names]
        width = len(names)

        def task(batches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = np.array([np.frombuffer(x.as_buffer()) for x in batch.column(1)]).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([batch.column(0), grams.lists(v)], ["count", "s"])

        rows = self._merged(without, as_of).where(F.col("cluster").isNotNull()).select("count", "v")
        flat = rows.mapInArrow(task, "count long, s array<double>")
        n = F.coalesce(F.sum("count"), F.lit(0))
        return flat.agg(
            F.count("*").alias("n_clusters"),
            n.alias("n"),
            *[(F.sum(F.col("s")[i]) + n * F.lit(float(o))).alias(f"sum_{name}") for i, (name, o) in enumerate(zip(names, off))],
        )

    def fit(
        self, without: Iterable | DataFrame = (), as_of: int | None = None, priors: Priors | None = None
    ) -> Fit:
        """The regression without the listed clusters, as of a version; no unit is read."""
        width = len(self.formula.names) - 1
        sums = grams.size_blocks(self._merged(without, as_of), ["_all"], width, 1)
        fit = fit_from_sums(sums, self.formula, ["_all"], self.centre, priors)
        return Fit(fit.formula, (), fit.table.drop("_all"), None, fit.centre)
