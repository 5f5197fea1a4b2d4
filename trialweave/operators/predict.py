"""Predictions as a function of a fit's draws and a row, worked out where they are used.

No table of predictions is written or joined. A cluster's effects under all draws are one row, joined to its units
together with their arm; a batch of rows times the draws' coefficients is one matrix product. Sums over imputed
outcomes are made from the same batches: the design is shared by all draws, so rows are never multiplied by them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions.noise import hash_normal
from trialweave.operators import grams
from trialweave.operators.joins import attach
from trialweave.operators.model import Fit, Formula, _pairs, centring, cluster_sums, draws_from_fit
from trialweave.schema import FIT_SEED
from trialweave.session import shuffle_partitions

#: Numbers in all draws together, which the driver and every task hold.
MOST_NUMBERS = 20_000_000
#: Draws whose noise of a row is one array; a cluster has a row per so many draws where variance shares are summed.
DRAWS_AT_ONCE = 100
#: Numbers in the sums that a task holds before it hands them on.
HELD_NUMBERS = 4_000_000


@dataclass(frozen=True)
class Predictor:
    """A fit's draws (numbered 1, 2, ...) and cluster means: all that a prediction needs besides its row."""

    formula: Formula
    cluster_means: DataFrame
    beta: np.ndarray
    sigma: np.ndarray
    tau: np.ndarray
    seed: int = FIT_SEED

    @classmethod
    def of_draws(cls, draws: DataFrame, formula: Formula, cluster_means: DataFrame, seed: int = FIT_SEED) -> Predictor:
        """From ``draws(draw, sigma, tau, beta)`` with draw = 1, 2, ...; their number is a parameter of the caller."""
        most = MOST_NUMBERS // (len(formula.names) + 2)
        found = sorted(draws.select("draw", "sigma", "tau", "beta").limit(most + 1).collect())
        if len(found) > most:
            raise ValueError(f"more than {most} draws; use fewer, or several predictors")
        if [r.draw for r in found] != list(range(1, len(found) + 1)):
            raise ValueError("draws are numbered 1, 2, ...")
        beta = np.array([r.beta for r in found], float).reshape(len(found), len(formula.names))
        return cls(formula, cluster_means, beta, np.array([r.sigma for r in found]), np.array([r.tau for r in found]), seed)

    @classmethod
    def of_fit(cls, fit: Fit, ndraws: int, seed: int = FIT_SEED) -> Predictor:
        """From one fit without groups, as the model of a single imputation is."""
        if fit.by:
            raise ValueError("predictions come from one fit, not from one per group")
        return cls.of_draws(draws_from_fit(fit, ndraws, seed), fit.formula, fit.cluster_means, seed)

    @property
    def ndraws(self) -> int:
        return len(self.sigma)

    def _each(self, make) -> Column:
        """An array with ``make(draw)`` for every draw."""
        return F.transform(F.sequence(F.lit(1), F.lit(self.ndraws)), make)

    def _spelt(self, make) -> Column:
        """The same for very many rows: a few draws are spelt out, which is compiled, while a sequence is interpreted."""
        if 0 < self.ndraws <= DRAWS_AT_ONCE:
            return F.array(*[make(F.lit(d)) for d in range(1, self.ndraws + 1)])
        return self._each(make)

    def unit_noise(self, unit: str, arm: Column) -> Column:
        """Standard normal number of the row for every draw."""
        return self._spelt(lambda d: self.unit_noise_at(unit, arm, d))

    def unit_noise_at(self, unit: str, arm: Column, draw: Column) -> Column:
        return hash_normal(F.col(unit), arm, draw, seed=self.seed, stream="unit")

    def design(self, **replace: Column) -> Column:
        """The design of a row without its intercept; NULL parts where a predictor is missing."""
        return grams.array_of(self.formula.columns(replace=replace)[1:])

    def effects(self, clusters: DataFrame) -> DataFrame:
        """Adds ``effects``, the cluster's effect under every draw, to a table with one row per cluster.

        Drawn from the conditional distribution given the cluster's observed mean; a cluster without observed
        outcomes gets a new effect.
        """
        cluster = self.formula.cluster
        noise = self._spelt(lambda d: hash_normal(F.col(cluster), d, seed=self.seed, stream="cluster"))
        p, beta, tau2, sigma2 = len(self.formula.names), self.beta, self.tau**2, self.sigma**2
        columns = clusters.columns
        known = clusters.join(self.cluster_means, cluster, "left").select(
            *columns,
            F.coalesce(F.col("n"), F.lit(0)).cast("double").alias("_n"),
            F.coalesce("y_mean", F.lit(0.0)).alias("_y"),
            F.coalesce("x_mean", F.array_repeat(F.lit(0.0), p)).alias("_x"),
        )
        # a few bytes a cluster become all its draws: dealt by number, as by bytes one task would have very many
        known = known.repartition(shuffle_partitions(clusters.sparkSession), F.xxhash64(cluster))
        # a lambda keeps the spelt out noise out of a whole stage's one method, for which it is too long
        known = known.withColumn("_x", F.transform("_x", lambda v: v)).withColumn("_z", noise)

        def task(batches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, y = (batch.column(len(columns) + i).to_numpy()[:, None] for i in range(2))
                x, z = grams.matrix(batch.column(len(columns) + 2), p), grams.matrix(batch.column(len(columns) + 3), len(tau2))
                spread = sigma2 + n * tau2
                out = n * tau2 / spread * (y - x @ beta.T) + np.sqrt(tau2 * sigma2 / spread) * z
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], grams.lists(out)], [*columns, "effects"])

        kinds = dict(known.dtypes)
        return known.mapInArrow(task, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "effects array<double>"]))

    def lines(self, rows: DataFrame, design: str = "_x", effects: str = "effects") -> DataFrame:
        """Replaces both columns by ``line``: the expected value of the row under every draw, effects included."""
        keep = [c for c in rows.columns if c not in (design, effects)]
        beta = self.beta

        def task(batches) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for low in range(0, whole.num_rows, grams.BLOCK_ROWS):
                    batch = whole.slice(low, grams.BLOCK_ROWS)
                    x = grams.matrix(batch.column(len(keep)), beta.shape[1] - 1)
                    line = x @ beta[:, 1:].T + beta[:, 0] + grams.matrix(batch.column(len(keep) + 1), len(beta))
                    yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], grams.lists(line)], [*keep, "line"])

        kinds = dict(rows.dtypes)
        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "line array<double>"])
        return rows.select(*keep, design, effects).mapInArrow(task, schema)

    def table(
        self, rows: DataFrame, arms: Sequence[str], unit: str = "unit_id", hot: Sequence | None = None
    ) -> DataFrame:
        """(unit, arm, old_arm, pred, imp): every row under every arm and draw, for those who need them all.

        Rows with a missing predictor have no prediction. A row without a cluster shares one new effect with all
        such rows.
        """
        cluster = self.formula.cluster
        clusters = rows.select(cluster).where(F.col(cluster).isNotNull()).distinct()
        known = attach(rows, self.effects(clusters), cluster, [unit], "left", hot, deal=True)
        tau = F.array(*[F.lit(float(t)) for t in self.tau])
        new = self._each(lambda d: tau[d - 1] * hash_normal(F.col(cluster), d, seed=self.seed, stream="cluster"))
        cells = [F.struct(F.lit(a).alias("arm"), self.design(arm=F.lit(a)).alias("_x")) for a in arms]
        spread = known.select(
            unit, F.col("arm").alias("old_arm"), F.coalesce("effects", new).alias("effects"), F.inline(F.array(*cells))
        ).where(~F.exists("_x", lambda x: x.isNull()))
        long = self.lines(spread).select(unit, "arm", "old_arm", F.posexplode("line").alias("_d", "line"))
        draw = (F.col("_d") + 1).cast("int")
        sigma = F.array(*[F.lit(float(s)) for s in self.sigma])
        noise = self.unit_noise_at(unit, F.col("arm"), draw)
        return long.select(unit, "arm", "old_arm", (F.col("line") + sigma[F.col("_d")] * noise).alias("pred"), draw.alias("imp"))


def imputed_rows(placed: DataFrame, predictor: Predictor, unit: str = "unit_id") -> DataFrame:
    """The placed units once per draw (``imp``), with the outcome predicted where the arm changed.

    ``placed`` has the unit's new ``arm``, its ``old_arm`` and ``effects``. A unit without an outcome keeps none,
    one with a missing predictor has no row.
    """
    keep = [c for c in placed.columns if c != "effects"]
    rows = placed.withColumn("_x", predictor.design()).where(~F.exists("_x", lambda x: x.isNull()))
    long = predictor.lines(rows).select(*keep, F.posexplode("line").alias("_d", "_line"))
    draw = (F.col("_d") + 1).cast("int")
    sigma = F.array(*[F.lit(float(s)) for s in predictor.sigma])
    y = predictor.formula.outcome
    pred = F.col("_line") + sigma[F.col("_d")] * predictor.unit_noise_at(unit, F.col("arm"), draw)
    chosen = F.when(F.col("old_arm") == F.col("arm"), F.col(y)).when(F.col("old_arm") != F.col("arm"), pred)
    return long.withColumn(y, F.when(F.col(y).isNotNull(), chosen)).withColumn("imp", draw).drop("_d", "_line")


def imputed_size_sums(
    placed: DataFrame,
    predictor: Predictor,
    formula: Formula,
    centre: dict[str, float],
    part: Column | None = None,
    looks: int = 1,
    unit: str = "unit_id",
) -> DataFrame:
    """``grams.size_blocks`` of every draw's imputed outcomes, per (look, imp): no row is copied per draw.

    ``placed`` as in ``imputed_rows``. ``part`` (0, 1, ...) is the first look that a cluster counts in less one; it
    counts in all later ones as well.
    """
    p, ndraws = len(formula.names), predictor.ndraws
    changed, none = F.col("old_arm") != F.col("arm"), F.array().cast("array<double>")
    y = F.col(formula.outcome).cast("double")
    rows = placed.where(F.col(formula.cluster).isNotNull() & y.isNotNull() & changed.isNotNull()).select(
        (F.lit(0) if part is None else part).cast("int").alias("part"),
        F.col(formula.cluster).alias("cluster"),
        # a lambda keeps the projection out of a whole stage's one method, for which the spelt out noise is too long
        F.transform(grams.array_of(formula.columns(centre=centre)[1:]), lambda v: v).alias("x"),
        predictor.design().alias("px"),
        (y - F.lit(float(centre.get(formula.outcome, 0.0)))).alias("y"),
        changed.alias("changed"),
        F.when(changed, F.col("effects")).otherwise(none).alias("effects"),
        F.when(changed, predictor.unit_noise(unit, F.col("arm"))).otherwise(none).alias("noise"),
    )
    rows = rows.where(~F.exists("x", lambda v: v.isNull()) & ~F.exists("px", lambda v: v.isNull()))
    beta, sigma, shift = predictor.beta, predictor.sigma, float(centre.get(formula.outcome, 0.0))

    def outcomes(batch: pa.RecordBatch) -> np.ndarray:
        px = grams.matrix(batch.column(3), beta.shape[1] - 1)
        out = np.repeat(batch.column(4).to_numpy()[:, None], ndraws, axis=1)
        moved = batch.column(5).to_numpy(zero_copy_only=False)
        line = px[moved] @ beta[:, 1:].T + beta[:, 0] + grams.matrix(batch.column(6), ndraws)
        out[moved] = line + sigma * grams.matrix(batch.column(7), ndraws) - shift
        return out

    made = grams.cluster_blocks(rows, ["part"], p - 1, ndraws, outcomes)
    every = F.explode(F.sequence(F.col("part") + 1, F.lit(looks))).alias("look")
    sums = grams.size_blocks(grams.merged_clusters(made, ["part"]), ["part"], p - 1, ndraws, [every], ["look"])
    return sums.withColumnRenamed("outcome_no", "imp")


def variance_shares(
    rows: DataFrame,
    draws: DataFrame,
    formula: Formula,
    cluster_means: DataFrame,
    by: Sequence[str] = (),
    seed: int = FIT_SEED,
    noise: bool = True,
) -> DataFrame:
    """Per group and draw the share of the predictive variance that is left without cluster effects: (by..., draw, ratio).

    In closed form: the spread of the linear part is that of the design between the coefficients, the cluster
    part follows from sums over clusters, the residual adds its variance to both. Rows meet no draw; clusters do,
    as one matrix product per batch. Draws and cluster means are those of each group if they name it, as from a
    fit per group, and else the same for all. Without ``noise`` effects are at their expected values and the
    residual is left out. Rows with a missing predictor or cluster do not count.
    """
    own = [c for c in by if c in draws.columns]
    p, cluster = len(formula.names), formula.cluster
    most = MOST_NUMBERS // (p + 2)
    found = draws.select(*own, "draw", "sigma", "tau", "beta").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} draws of all groups; use fewer draws or groups")
    groups: dict[tuple, list] = {}
    for r in sorted(found, key=lambda r: r.draw):
        groups.setdefault(tuple(r[c] for c in own), []).append(r)
    ready = {
        k: (np.array([r.beta for r in g], float), *(np.array([r[c] for r in g], float) for c in ("sigma", "tau")))
        for k, g in groups.items()
    }
    labels = {k: [int(r.draw) for r in g] for k, g in groups.items()}
    longest = max((max(v) for v in labels.values()), default=0)
    plain = rows.withColumn(formula.outcome, F.lit(0.0))
    centre = {k: v for k, v in centring(plain, formula).items() if k != formula.outcome}
    sums = cluster_sums(plain, formula, by, centre)
    keys = [*[c for c in by if c in cluster_means.columns], cluster]
    means = cluster_means.select(*keys, F.col("n").alias("_seen"), "y_mean", "x_mean")
    pairs = _pairs(p)
    most_blocks = -(-longest // DRAWS_AT_ONCE)
    first = (F.col("_block") * DRAWS_AT_ONCE + 1).cast("int")
    z = F.transform(
        F.sequence(first, first + (DRAWS_AT_ONCE - 1)), lambda d: hash_normal(F.col(cluster), d, seed=seed, stream="cluster")
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(most_blocks - 1))) if most_blocks else F.explode(F.array().cast("array<int>"))
    joined = sums.join(means, keys, "left").select("*", every.alias("_block")).select(
        *by,
        F.col("n").cast("double").alias("n"),
        F.array(*[F.col(f"s{j}") for j in range(1, p)]).cast("array<double>").alias("s"),
        F.array(*[F.col(f"q{j}_{k}") for j, k in pairs]).cast("array<double>").alias("q"),
        F.coalesce(F.col("_seen"), F.lit(0)).cast("double").alias("seen"),
        F.coalesce("y_mean", F.lit(0.0)).alias("y"),
        F.coalesce("x_mean", F.array_repeat(F.lit(0.0), p)).alias("x"),
        (z if noise and longest else F.array().cast("array<double>")).alias("z"),
        F.col("_block").cast("int").alias("block"),
    )
    b = len(by)
    at = [list(by).index(c) for c in own]
    width = 3 + (p - 1) + len(pairs) + (p - 1)

    # per group the draws (by place) of each block
    dealt = {
        k: {j: [i for i, d in enumerate(v) if (d - 1) // DRAWS_AT_ONCE == j] for j in {(d - 1) // DRAWS_AT_ONCE for d in v}}
        for k, v in labels.items()
    }

    def task(batches) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for (*g, block), v in held.items():
                mine = tuple(g[i] for i in at)
                label = [labels[mine][i] for i in dealt[mine][block]]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([g[i]] * len(label), types[i]) for i in range(b)], pa.array(label, pa.int32()), grams.lists(v)],
                    [*by, "draw", "v"],
                )
            held.clear()

        for whole in batches:
            types = [whole.schema.field(i).type for i in range(b)]
            for low in range(0, whole.num_rows, grams.BLOCK_ROWS):
                batch = whole.slice(low, grams.BLOCK_ROWS)
                n, seen, y = (batch.column(b + i).to_numpy() for i in (0, 3, 4))
                s, q, x = (grams.matrix(batch.column(b + i), k) for i, k in ((1, p - 1), (2, len(pairs)), (5, p)))
                stream = grams.matrix(batch.column(b + 6), DRAWS_AT_ONCE) if noise else None
                lead = [*batch.columns[:b], batch.column(b + 7)]
                _, one, code = np.unique(grams.codes(lead), return_index=True, return_inverse=True)
                for number, row in enumerate(one.tolist()):
                    *g, block = (c[row].as_py() for c in lead)
                    mine = tuple(g[i] for i in at)
                    places = dealt.get(mine, {}).get(block)
                    if not places:
                        continue
                    r = np.flatnonzero(code == number)
                    beta, sigma, tau = (v[places] for v in ready[mine])
                    spread = sigma**2 + seen[r, None] * tau**2
                    u = seen[r, None] * tau**2 / spread * (y[r, None] - x[r] @ beta.T)
                    if noise:
                        own_draws = np.array([labels[mine][i] for i in places]) - 1 - block * DRAWS_AT_ONCE
                        u = u + np.sqrt(tau**2 * sigma**2 / spread) * stream[r][:, own_draws]
                    out = np.empty((len(beta), width))
                    out[:, 0] = n[r].sum()
                    out[:, 1], out[:, 2] = n[r] @ u, n[r] @ (u * u)
                    out[:, 3 : 2 + p] = s[r].sum(0)
                    out[:, 2 + p : 2 + p + len(pairs)] = q[r].sum(0)
                    out[:, 2 + p + len(pairs) :] = u.T @ s[r]
                    key = (*g, block)
                    held[key] = held[key] + out if key in held else out
            if sum(v.size for v in held.values()) > HELD_NUMBERS:
                yield from flush()
        yield from flush()

    kinds = dict(joined.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "draw int, v array<double>"])
    total = joined.mapInArrow(task, schema).groupBy(*by, "draw").agg(*[F.expr(f"sum(v[{i}]) as v{i}") for i in range(width)])

    def share(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.stack([batch.column(b + 1 + i).to_numpy() for i in range(width)], 1)
            group = list(zip(*(batch.column(i).to_pylist() for i in range(b)))) if b else [()] * batch.num_rows
            ratio = []
            for g, d, row in zip(group, batch.column(b).to_pylist(), v):
                mine = tuple(g[i] for i in at)
                place = labels[mine].index(d)
                beta, sigma = ready[mine][0][place, 1:], ready[mine][1][place]
                n, nu, nu2 = row[:3]
                s, us = row[3 : 2 + p], row[2 + p + len(pairs) :]
                cross = np.zeros((p - 1, p - 1))
                for (j, k), value in zip(pairs, row[2 + p : 2 + p + len(pairs)]):
                    cross[j - 1, k - 1] = cross[k - 1, j - 1] = value
                line = beta @ (cross - np.outer(s, s) / n) @ beta
                effect = nu2 - nu * nu / n + 2 * beta @ (us - s * nu / n)
                rest = (n - 1) * sigma**2 if noise else 0.0
                whole = line + effect + rest
                ratio.append((line + rest) / whole if n > 1 and whole > 0 else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[: b + 1], pa.array(ratio, pa.float64())], [*by, "draw", "ratio"])

    return total.mapInArrow(share, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "draw int, ratio double"]))
