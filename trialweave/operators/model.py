"""Gaussian regression with cluster intercepts from distributed sums, and predictions from it.

The data enters the fit only through sums per cluster, and those only through sums per cluster
size. For a ratio ``lam`` of cluster to residual variance everything the posterior needs is again a
sum over sizes: one p x p system per (group, lam). NumPy solves those systems, a fixed number of small ones,
whatever the size of the data. Fits take their sums from blocks (``grams``); ``cluster_sums`` and ``size_sums`` are
the same sums as plain columns.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialweave.functions.noise import hash_normal
from trialweave.operators import grams
from trialweave.operators.joins import attach
from trialweave.operators.ranges import group_quantiles
from trialweave.schema import FIT_SEED, PRIOR_COEFFICIENT_SD, PRIOR_SCALE, PRIOR_SCALE_DF
from trialweave.session import cut_lineage, shuffle_partitions

COARSE_POINTS = 71
FINE_POINTS = 41
SIGMA_POINTS = 31
#: Log weight below the peak that ends the grid (exp(-16) is 1e-7) and that bounds its fine part.
KEEP_LOG, CORE_LOG = 16.0, 6.0
#: Points in the fine part that make a grid fine enough, and rounds by which refinement gets there.
RESOLVED_POINTS, MOST_ROUNDS = 9, 40
MOST_POINTS = 401
#: Draws made in one task.
DRAWS_PER_TASK = 1000


@dataclass(frozen=True)
class Formula:
    """``outcome ~ factors + numeric + interactions + (1 | cluster)``; first level = reference."""

    outcome: str
    cluster: str
    factors: Mapping[str, Sequence[str]]
    numeric: Sequence[str] = ()
    interactions: Sequence[tuple[str, str]] = ()

    def _level_terms(self, name: str) -> list[tuple[str, str]]:
        return [(f"{name}_{level}", level) for level in self.factors[name][1:]]

    @property
    def names(self) -> list[str]:
        out = ["Intercept"]
        for name in self.factors:
            out += [term for term, _ in self._level_terms(name)]
        out += list(self.numeric)
        for a, b in self.interactions:
            out += [f"{s}:{t}" for s, _ in self._level_terms(a) for t, _ in self._level_terms(b)]
        return out

    def columns(
        self, replace: Mapping[str, Column] | None = None, centre: Mapping[str, float] | None = None
    ) -> list[Column]:
        """Design columns; a missing or unknown label makes its columns NULL."""
        replace, centre = replace or {}, centre or {}

        def source(name: str) -> Column:
            return replace.get(name, F.col(name))

        def indicators(name: str) -> list[Column]:
            c = source(name)
            known = c.isin(list(self.factors[name]))
            return [F.when(known, (c == level).cast("double")) for _, level in self._level_terms(name)]

        out = [F.lit(1.0)]
        for name in self.factors:
            out += indicators(name)
        out += [source(n).cast("double") - F.lit(float(centre.get(n, 0.0))) for n in self.numeric]
        for a, b in self.interactions:
            out += [x * y for x in indicators(a) for y in indicators(b)]
        return out

    def depends_on(self, factor: str) -> list[str]:
        """Coefficient names that change with a factor."""
        own = [term for term, _ in self._level_terms(factor)]
        return [n for n in self.names if any(part in own for part in n.split(":"))]


@dataclass(frozen=True)
class Priors:
    """Normal priors of the coefficients (an infinite spread is flat), half-t priors of both scales.

    ``intercept_mean`` is on the scale of the outcome; None puts the intercept's prior at its mean.
    """

    coefficient_sd: float = PRIOR_COEFFICIENT_SD
    intercept_sd: float = PRIOR_COEFFICIENT_SD
    scale: float = PRIOR_SCALE
    scale_df: float = PRIOR_SCALE_DF
    intercept_mean: float | None = None


def default_priors(df: DataFrame, outcome: str, least: float = 2.5) -> Priors:
    """Priors that follow the data: flat coefficients, an intercept at the outcome's median, scales of its spread.

    The spread is the median absolute deviation from the median times 1.4826, and ``least`` at least.
    """
    seen = df.where(F.col(outcome).isNotNull()).select(F.col(outcome).cast("double").alias("y"))
    middle = group_quantiles(seen, [], "y", {"m": 0.5}).first()
    if middle is None:
        return Priors(coefficient_sd=math.inf)
    away = seen.select(F.abs(F.col("y") - middle.m).alias("d"))
    spread = max(least, 1.4826 * group_quantiles(away, [], "d", {"m": 0.5}).first().m)
    return Priors(math.inf, spread, spread, PRIOR_SCALE_DF, middle.m)


@dataclass(frozen=True)
class Fit:
    """Fit table plus what is needed to use it.

    ``table``: by..., cell, sigma, tau, weight, beta ARRAY, cov ARRAY (row-major), resolved, on the scale of
    the data. ``cluster_means``: by..., cluster, n, y_mean, x_mean ARRAY; None for a fit of imputed sums.
    """

    formula: Formula
    by: Sequence[str]
    table: DataFrame
    cluster_means: DataFrame | None
    centre: Mapping[str, float] = field(default_factory=dict)


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(j, k) for j in range(1, p) for k in range(j, p)]


def _exprs(texts: Sequence[str]) -> list[Column]:
    """Many like aggregates; as text they cost one call each."""
    return [F.expr(t) for t in texts]


def centring(df: DataFrame, formula: Formula) -> dict[str, float]:
    """Means of the numeric columns and the outcome, taken off before squares are summed."""
    names = [*formula.numeric, formula.outcome]
    row = df.where(F.col(formula.outcome).isNotNull()).agg(*[F.avg(n).alias(n) for n in names]).first()
    return {n: float(row[n] or 0.0) for n in names}


def cluster_sums(
    df: DataFrame, formula: Formula, by: Sequence[str] = (), centre: Mapping[str, float] | None = None
) -> DataFrame:
    """Per group and cluster: n, s<j> = sum x_j, q<j>_<k> = sum x_j x_k, r<j> = sum x_j y, t, yy.

    A missing outcome carries no information on the coefficients and variances, so rows without
    one are left out, as are rows with a missing predictor.
    """
    centre = centre or {}
    p = len(formula.names)
    y = F.col(formula.outcome).cast("double") - F.lit(float(centre.get(formula.outcome, 0.0)))
    xs = formula.columns(centre=centre)
    rows = df.select(
        *by, F.col(formula.cluster), *[x.alias(f"x{j}") for j, x in enumerate(xs) if j], y.alias("y")
    ).dropna("any", subset=[formula.cluster, "y", *[f"x{j}" for j in range(1, p)]])
    sums = [f"sum(x{j}) as s{j}" for j in range(1, p)]
    sums += [f"sum(x{j} * x{k}) as q{j}_{k}" for j, k in _pairs(p)]
    sums += [f"sum(x{j} * y) as r{j}" for j in range(1, p)]
    return rows.groupBy(*by, formula.cluster).agg(
        *_exprs(["count(*) as n", *sums, "sum(y) as t", "sum(y * y) as yy"])
    )


def cluster_means(
    clusters: DataFrame,
    formula: Formula,
    by: Sequence[str] = (),
    centre: Mapping[str, float] | None = None,
) -> DataFrame:
    """Size and means per cluster from its sums: (by..., cluster, n, y_mean, x_mean ARRAY)."""
    centre = centre or {}
    n = F.col("n")
    x_mean = [F.lit(1.0)] + [
        F.col(f"s{j}") / n + float(centre.get(name, 0.0))
        for j, name in enumerate(formula.names)
        if j
    ]
    y_mean = F.col("t") / n + float(centre.get(formula.outcome, 0.0))
    return clusters.select(
        *by, formula.cluster, n, y_mean.alias("y_mean"), F.array(*x_mean).alias("x_mean")
    )


def size_sums(clusters: DataFrame, p: int, by: Sequence[str] = ()) -> DataFrame:
    """Cluster sums added up over clusters of equal size."""
    plain = [f"s{j}" for j in range(1, p)] + [f"q{j}_{k}" for j, k in _pairs(p)]
    plain += [f"r{j}" for j in range(1, p)] + ["t", "yy"]
    sums = [f"sum({name}) as {name}" for name in plain]
    sums += [f"sum(s{j} * s{k}) as ss{j}_{k}" for j, k in _pairs(p)]
    sums += [f"sum(s{j} * t) as st{j}" for j in range(1, p)]
    return clusters.groupBy(*by, "n").agg(
        *_exprs(["count(*) as n_clusters", *sums, "sum(t * t) as tt"])
    )


def _systems(sizes: DataFrame, grid: Column, p: int, by: Sequence[str]) -> DataFrame:
    """One weighted p x p system per group and grid point, as arrays.

    ``w`` is the weight of a cluster's squared sum; ``keep`` is the share left of a column that is
    constant in the cluster.
    """
    rows = sizes.withColumn("lam", F.explode(grid)).selectExpr(
        "*", "lam / (1 + n * lam) as w", "1 / (1 + n * lam) as keep"
    )
    inner = range(1, p)
    sums = [
        "sum(n * n_clusters) as total",
        "sum(n_clusters * log1p(n * lam)) as logdet",
        "sum(yy - w * tt) as c",
        "sum(n * n_clusters * keep) as a0_0",
        "sum(t * keep) as b0",
    ]
    for j in inner:
        sums += [f"sum(s{j}) as m{j}", f"sum(s{j} * keep) as a0_{j}", f"sum(r{j} - w * st{j}) as b{j}"]
    sums += [f"sum(q{j}_{k} - w * ss{j}_{k}) as a{j}_{k}" for j, k in _pairs(p)]
    flat = rows.groupBy(*by, "lam").agg(*_exprs(sums))
    full = ", ".join(f"a{min(j, k)}_{max(j, k)}" for j in range(p) for k in range(p))
    right = ", ".join(f"b{j}" for j in range(p))
    mean = ", ".join(["1D"] + [f"m{j} / total" for j in inner])
    return flat.selectExpr(
        *by,
        "lam",
        "total",
        "logdet",
        "c",
        f"array({full}) as a",
        f"array({right}) as b",
        f"array({mean}) as mean",
    )


def _half_t_log(x: np.ndarray, priors: Priors) -> np.ndarray:
    v = priors.scale_df
    return -(v + 1.0) / 2.0 * np.log1p((x / priors.scale) ** 2 / v)


def _solve(pdf: pd.DataFrame, p: int, priors: Priors, want_beta: bool):
    """Log posterior (and coefficients) on the grid of one group; columns centred for the prior."""
    pdf = pdf.sort_values("lam")
    lam = pdf["lam"].to_numpy()
    a = np.stack(pdf["a"].to_numpy()).reshape(-1, p, p)
    b = np.stack(pdf["b"].to_numpy())
    c, logdet = pdf["c"].to_numpy(), pdf["logdet"].to_numpy()
    total = float(pdf["total"].iloc[0])
    shift = np.eye(p)
    shift[0, 1:] = -np.asarray(pdf["mean"].iloc[0])[1:]
    a = shift.T @ a @ shift
    b = b @ shift
    p0 = np.full(p, priors.coefficient_sd**-2.0)
    p0[0] = priors.intercept_sd**-2.0
    ridge = np.diag(p0 * 1e-6) if p0.all() else np.diag(1e-12 * np.diagonal(a[0]))
    rss = c - np.einsum("gi,gi->g", b, np.linalg.solve(a + ridge, b[..., None])[..., 0])
    centre = 0.5 * np.log(np.maximum(rss, 1e-300) / max(total - p, 1.0))
    step = 7.0 / math.sqrt(2.0 * max(total - p, 2.0))
    log_sigma = centre[:, None] + np.linspace(-step, step, SIGMA_POINTS)[None, :]
    sigma = np.exp(log_sigma)
    tau = sigma * np.sqrt(lam)[:, None]
    prec = a[:, None] / sigma[..., None, None] ** 2 + np.diag(p0)
    rhs = b[:, None] / sigma[..., None] ** 2
    rhs[..., 0] += p0[0] * (priors.intercept_mean or 0.0)  # from the outcome's mean on
    beta = np.linalg.solve(prec, rhs[..., None])[..., 0]
    _, logprec = np.linalg.slogdet(prec)
    fit = c[:, None] / sigma**2 - np.einsum("gsi,gsi->gs", rhs, beta)
    logp = -total * log_sigma - 0.5 * logdet[:, None] - 0.5 * fit - 0.5 * logprec
    logp += _half_t_log(sigma, priors) + _half_t_log(tau, priors) + log_sigma + np.log(tau)
    if not want_beta:
        return lam, logp, None
    cov = shift @ np.linalg.inv(prec) @ shift.T
    return lam, logp, (sigma, tau, beta @ shift.T, cov)


def refine(lam: np.ndarray, logp: np.ndarray) -> tuple[list[float], bool]:
    """Next grid of variance ratios, and whether the given one already resolves the posterior.

    It does if its ends are empty and enough points lie near the peak. The next grid is even over all that
    carries weight, one step wider on both sides, widened by its own length where an end has weight, and
    fine enough for the part near the peak.
    """
    profile = np.logaddexp.reduce(logp, axis=1)
    log, top = np.log(lam), profile.max()

    def span(keep: float) -> tuple[int, int]:
        at = np.flatnonzero(profile > top - keep)
        return int(at[0]), int(at[-1])

    first, last = span(KEEP_LOG)
    # a ratio of nothing or of everything is a limit of the scale, not an unexplored range
    open_low, open_high = first == 0 and log[0] > -60, last == len(lam) - 1 and log[-1] < 60
    wide = log[-1] - log[0]
    lo = log[max(first - 1, 0)] - wide * open_low
    hi = log[min(last + 1, len(lam) - 1)] + wide * open_high
    a, b = span(CORE_LOG)
    done = not (open_low or open_high) and b - a + 1 >= RESOLVED_POINTS
    core = log[min(b + 1, len(lam) - 1)] - log[max(a - 1, 0)]
    points = int(np.clip(np.ceil((hi - lo) / core * FINE_POINTS), FINE_POINTS, MOST_POINTS))
    return np.exp(np.linspace(lo, hi, points)).tolist(), done


def _cells(
    pdf: pd.DataFrame, by: Sequence[str], p: int, priors: Priors, offset: np.ndarray, y_mean: float
) -> pd.DataFrame:
    """Fit table of one group: grid cells with weight, coefficients and covariance."""
    lam, logp, (sigma, tau, beta, cov) = _solve(pdf, p, priors, True)
    weight = np.exp(logp - logp.max())
    weight /= weight.sum()
    keep = np.nonzero(weight > 1e-10)
    back = np.eye(p)
    back[0] -= offset  # undo the centring of the numeric columns
    mean = beta[keep] @ back.T
    mean[:, 0] += y_mean
    spread = back @ cov[keep] @ back.T
    w = weight[keep] / weight[keep].sum()
    out = pd.DataFrame(
        {
            "cell": np.arange(len(w), dtype=np.int32),
            "sigma": sigma[keep],
            "tau": tau[keep],
            "weight": w,
            "beta": list(mean),
            "cov": list(spread.reshape(len(w), -1)),
            "resolved": refine(lam, logp)[1],
        }
    )
    for k in reversed(list(by)):
        out.insert(0, k, pdf[k].iloc[0])
    return out


def _group_systems(sizes: pd.DataFrame, lam: np.ndarray, p: int) -> pd.DataFrame:
    """``_systems`` of one group from its ``grams.size_blocks``."""
    width, (up, down) = p - 1, grams.triangle(p - 1)
    half = len(up)
    total = np.stack(sizes.loc[sizes["n"] == 0, "v"].to_numpy()).sum(0)
    sized = sizes[sizes["n"] > 0]
    n, m = sized["n"].to_numpy(float), sized["n_clusters"].to_numpy(float)
    v = np.stack(sized["v"].to_numpy())
    s, ss, t, tt, st = np.split(v, np.cumsum([width, half, 1, 1]), axis=1)
    keep = 1.0 / (1.0 + np.outer(lam, n))
    w = lam[:, None] * keep
    a = np.empty((len(lam), p, p))
    b = np.empty((len(lam), p))
    a[:, 0, 0], b[:, 0] = keep @ (n * m), keep @ t[:, 0]
    a[:, 0, 1:] = a[:, 1:, 0] = keep @ s
    b[:, 1:] = total[half + 1 :] - w @ st
    cross = total[:half] - w @ ss
    a[:, up + 1, down + 1] = a[:, down + 1, up + 1] = cross
    rows = (n * m).sum()
    mean = np.concatenate([[1.0], s.sum(0) / rows])
    return pd.DataFrame(
        {
            "lam": lam,
            "total": rows,
            "logdet": np.log1p(np.outer(lam, n)) @ m,
            "c": total[half] - w @ tt[:, 0],
            "a": list(a.reshape(len(lam), -1)),
            "b": list(b),
            "mean": [mean] * len(lam),
        }
    )


def _fit_group(
    sizes: pd.DataFrame, by: Sequence[str], p: int, priors: Priors, offset: np.ndarray, y_mean: float
) -> pd.DataFrame:
    """Fit table of one group from its size sums; the grid is refined here until it resolves the posterior."""
    lam = _start_grid()
    for _ in range(MOST_ROUNDS):
        systems = _group_systems(sizes, lam, p)
        grid, done = refine(*_solve(systems, p, priors, False)[:2])
        if done:
            break
        lam = np.array(grid)
    return _cells(systems.assign(**{k: sizes[k].iloc[0] for k in by}), by, p, priors, offset, y_mean)


def _start_grid() -> np.ndarray:
    return np.exp(np.linspace(math.log(1e-8), math.log(1e6), COARSE_POINTS))


def fit_from_sums(
    sums: DataFrame,
    formula: Formula,
    by: Sequence[str],
    centre: Mapping[str, float],
    priors: Priors | None = None,
    means: DataFrame | None = None,
) -> Fit:
    """Posterior from ``grams.size_blocks`` per ``by`` group, of columns and outcomes with ``centre`` taken off.

    A group is solved in one call, whatever its number of rows and clusters: it has a row per cluster size, at most
    the square root of twice its rows. ``resolved`` tells whether the grid of variance ratios came to resolve the
    posterior; a group that does not leaves the others as they are.
    """
    priors = priors or Priors()
    p, keys = len(formula.names), list(by)
    if priors.intercept_mean is not None:
        priors = replace(priors, intercept_mean=priors.intercept_mean - centre[formula.outcome])
    schema = T.StructType(
        [
            *[sums.schema[k] for k in keys],
            T.StructField("cell", T.IntegerType()),
            T.StructField("sigma", T.DoubleType()),
            T.StructField("tau", T.DoubleType()),
            T.StructField("weight", T.DoubleType()),
            T.StructField("beta", T.ArrayType(T.DoubleType())),
            T.StructField("cov", T.ArrayType(T.DoubleType())),
            T.StructField("resolved", T.BooleanType()),
        ]
    )
    offset = np.array([centre.get(name, 0.0) for name in formula.names])
    y_mean = centre[formula.outcome]
    # a group has few rows but takes a while to solve; Spark would put all of them into one task
    dealt = sums.repartition(shuffle_partitions(sums.sparkSession), *keys)
    solved = dealt.groupBy(*keys).applyInPandas(
        lambda pdf: _fit_group(pdf, keys, p, priors, offset, y_mean), schema=schema
    )
    return Fit(formula, tuple(by), cut_lineage(solved, "fit"), means, centre)


def design_rows(
    df: DataFrame, formula: Formula, by: Sequence[str] = (), centre: Mapping[str, float] | None = None
) -> DataFrame:
    """(by..., cluster, x, y): design without intercept and outcome of complete rows, less ``centre``."""
    centre = centre or {}
    y = F.col(formula.outcome).cast("double") - F.lit(float(centre.get(formula.outcome, 0.0)))
    rows = df.select(
        *by, F.col(formula.cluster).alias("cluster"), grams.array_of(formula.columns(centre=centre)[1:]).alias("x"), y.alias("y")
    )
    return rows.where(F.col("cluster").isNotNull() & F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull()))


def fit_random_intercept(
    df: DataFrame,
    formula: Formula,
    by: Sequence[str] = (),
    priors: Priors | None = None,
) -> Fit:
    """Posterior of the random-intercept regression, separately per ``by`` group.

    The data is read once for the means and once for the sums; one row per cluster is written. Given the two
    variances the coefficients are exactly Normal; the variances are summed out over a grid that is refined and
    widened until it resolves the posterior weight, however narrow many clusters make it.
    """
    p = len(formula.names)
    keys = list(by) or ["_all"]
    if not by:
        df = df.withColumn("_all", F.lit(0))
    centre = centring(df, formula)
    rows, at = design_rows(df, formula, keys, centre), len(keys) + 2
    made = grams.cluster_blocks(rows, keys, p - 1, 1, lambda batch: batch.column(at).to_numpy()[:, None])
    clusters = cut_lineage(grams.merged_clusters(made, keys), "cluster-sums")
    sums = grams.size_blocks(clusters, keys, p - 1, 1)
    fit = fit_from_sums(sums, formula, keys, centre, priors, _block_means(clusters, formula, by, centre))
    return fit if by else replace(fit, by=(), table=fit.table.drop("_all"))


def _block_means(clusters: DataFrame, formula: Formula, by: Sequence[str], centre: Mapping[str, float]) -> DataFrame:
    """``cluster_means`` from the rows of ``grams.merged_clusters`` that are clusters."""
    p = len(formula.names)
    off = np.array([*[centre.get(name, 0.0) for name in formula.names[1:]], centre.get(formula.outcome, 0.0)])
    lead = [*by, "cluster"]

    def task(batches):
        for batch in batches:
            n = batch.column(len(lead)).to_numpy()
            mean = np.array([np.frombuffer(v.as_buffer()) for v in batch.column(len(lead) + 1)]).reshape(-1, p)
            mean = mean / n[:, None] + off
            x = np.concatenate([np.ones((len(n), 1)), mean[:, :-1]], 1)
            columns = [*batch.columns[: len(lead) + 1], pa.array(mean[:, -1]), grams.lists(x)]
            yield pa.RecordBatch.from_arrays(columns, [*lead, "n", "y_mean", "x_mean"])

    kinds = dict(clusters.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in lead) + "n long, y_mean double, x_mean array<double>"
    rows = clusters.where(F.col("cluster").isNotNull()).select(*lead, "count", "v").mapInArrow(task, schema)
    return rows.withColumnRenamed("cluster", formula.cluster)


def coefficient_summary(fit: Fit) -> DataFrame:
    """Posterior mean and standard deviation per coefficient and group, from the fit table."""
    p = len(fit.formula.names)
    names = F.array(*[F.lit(n) for n in fit.formula.names])
    long = fit.table.select(*fit.by, "weight", "cov", F.posexplode("beta").alias("j", "b"))
    w, b = F.col("weight"), F.col("b")
    return (
        long.withColumn("v", F.col("cov")[F.col("j") * (p + 1)])
        .groupBy(*fit.by, "j")
        .agg(F.sum(w * b).alias("estimate"), F.sum(w * (F.col("v") + b * b)).alias("second"))
        .select(
            *fit.by,
            F.element_at(names, F.col("j") + 1).alias("coefficient"),
            "estimate",
            F.sqrt(F.greatest(F.col("second") - F.col("estimate") ** 2, F.lit(0.0))).alias("sd"),
        )
    )


def variance_summary(fit: Fit) -> DataFrame:
    """Posterior means of the residual and cluster standard deviations per group."""
    w = F.col("weight")
    return fit.table.groupBy(*fit.by).agg(
        F.sum(w * F.col("sigma")).alias("sigma"),
        F.sum(w * F.col("tau")).alias("tau"),
        F.sum(w * F.col("tau") ** 2 / (F.col("tau") ** 2 + F.col("sigma") ** 2)).alias("icc"),
    )


def _stream(seed: int, *key) -> np.random.Generator:
    """A random stream of its own for each seed and key, whatever the types and letters of the key."""
    text = "\x1f".join([str(seed), *[f"{type(k).__name__}:{k}" for k in key]])
    return np.random.default_rng(np.frombuffer(hashlib.sha256(text.encode()).digest(), dtype=np.uint32))


def draws_from_fit(fit: Fit, ndraws: int, seed: int = FIT_SEED) -> DataFrame:
    """``ndraws`` posterior draws per group: (by..., draw, sigma, tau, beta ARRAY).

    Tasks make a fixed number of draws each, from the group's cells, with a random stream of their own.
    """
    p = len(fit.formula.names)
    keys = list(fit.by) or ["_all"]
    table = fit.table if fit.by else fit.table.withColumn("_all", F.lit(0))
    parts = -(-ndraws // DRAWS_PER_TASK)
    dealt = table.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        part = int(pdf["_part"].iloc[0])
        n = min(DRAWS_PER_TASK, ndraws - part * DRAWS_PER_TASK)
        rng = _stream(seed, *[v.item() if hasattr(v, "item") else v for v in pdf[keys].iloc[0]], part)
        w = pdf["weight"].to_numpy()
        cell = np.minimum(np.searchsorted(np.cumsum(w), rng.random(n)), len(w) - 1)
        z = rng.standard_normal((n, p))
        beta = np.empty((n, p))
        for i in np.unique(cell):
            cov = np.asarray(pdf["cov"].iloc[i]).reshape(p, p)
            value, vector = np.linalg.eigh((cov + cov.T) / 2)
            root = vector * np.sqrt(np.maximum(value, 0.0))
            at = cell == i
            beta[at] = np.asarray(pdf["beta"].iloc[i]) + z[at] @ root.T
        out = pd.DataFrame(
            {
                "draw": np.arange(1, n + 1, dtype=np.int32) + part * DRAWS_PER_TASK,
                "sigma": pdf["sigma"].to_numpy()[cell],
                "tau": pdf["tau"].to_numpy()[cell],
                "beta": list(beta),
            }
        )
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    fields = [table.schema[k] for k in keys] + [
        T.StructField("draw", T.IntegerType()),
        T.StructField("sigma", T.DoubleType()),
        T.StructField("tau", T.DoubleType()),
        T.StructField("beta", T.ArrayType(T.DoubleType())),
    ]
    out = dealt.groupBy(*keys, "_part").applyInPandas(draw, schema=T.StructType(fields))
    return out if fit.by else out.drop("_all")


def incomplete_rows(df: DataFrame, formula: Formula, by: Sequence[str] = ()) -> DataFrame:
    """Rows the fit leaves out, by reason: (by..., n_rows, n_no_outcome, n_no_cluster, n_no_predictor)."""
    gone = F.lit(False)
    for x in formula.columns()[1:]:
        gone = gone | x.isNull()
    seen = F.col(formula.outcome).isNotNull()
    placed = F.col(formula.cluster).isNotNull()
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.count_if(~seen).alias("n_no_outcome"),
        F.count_if(seen & ~placed).alias("n_no_cluster"),
        F.count_if(seen & placed & gone).alias("n_no_predictor"),
    )


def score_draws(
    rows: DataFrame,
    draws: DataFrame,
    formula: Formula,
    cluster_means: DataFrame,
    seed: int = FIT_SEED,
    noise: bool = True,
    unit: str = "unit_id",
    hot: Sequence | None = None,
    cluster_effect: bool = True,
) -> DataFrame:
    """Predictive value of every row under every draw: adds ``draw`` and ``pred``.

    ``draws(draw, sigma, tau, beta)`` is small by parameter and reaches the tasks as one array.
    The cluster effect is drawn from its conditional distribution given the cluster's observed
    mean; clusters without observed outcomes get a new effect. Without ``noise`` both the cluster
    effect and the residual are at their expected values; without ``cluster_effect`` it is left out.
    """
    cells = F.struct("draw", "sigma", "tau", "beta")
    every = draws.agg(F.collect_list(cells).alias("draws")).scalar()
    known = attach(rows, cluster_means, formula.cluster, [unit], "left", hot)
    scored = known.select("*", F.explode(every).alias("_d"))
    d = F.col("_d")
    beta = d["beta"]
    xs = formula.columns()
    line = sum((beta[j] * x for j, x in enumerate(xs)), F.lit(0.0))
    n = F.coalesce(F.col("n").cast("double"), F.lit(0.0))
    tau2, sigma2 = d["tau"] * d["tau"], d["sigma"] * d["sigma"]
    fitted = sum((beta[j] * F.col("x_mean")[j] for j in range(len(xs))), F.lit(0.0))
    shrink = n * tau2 / (sigma2 + n * tau2)
    effect = shrink * F.coalesce(F.col("y_mean") - fitted, F.lit(0.0))
    if noise:
        cluster, draw = F.col(formula.cluster), d["draw"]
        left = F.sqrt(tau2 * sigma2 / (sigma2 + n * tau2))
        effect = effect + left * hash_normal(cluster, draw, seed=seed, stream="cluster")
    if not cluster_effect:
        effect = F.lit(0.0)
    if noise:
        effect = effect + d["sigma"] * hash_normal(
            F.col(unit), F.col("arm"), draw, seed=seed, stream="unit"
        )
    return scored.withColumn("draw", d["draw"]).withColumn("pred", line + effect).drop(
        "_d", "n", "y_mean", "x_mean"
    )


def gls_coefficients(sizes: DataFrame, p: int, lam: float, by: Sequence[str] = ()) -> DataFrame:
    """Coefficients at a fixed ratio of cluster to residual variance, without priors: (by..., beta ARRAY)."""
    systems = _systems(sizes, F.array(F.lit(float(lam))), p, list(by))

    @F.pandas_udf("array<double>")
    def solve(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.solve(np.reshape(x, (p, p)), np.asarray(y)).tolist() for x, y in zip(a, b)])

    return systems.select(*by, solve("a", "b").alias("beta"))
