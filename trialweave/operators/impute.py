"""Predictor screening, column audit and predictive mean matching."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions.noise import text_hash, text_normal
from trialweave.functions.recode import level_index
from trialweave.operators.joins import attach, hot_keys
from trialweave.operators.ranges import RANGE, number_rows, plan_ranges, with_range
from trialweave.session import cut_lineage


def _correlation(x: Column, y: Column) -> Column:
    """Correlation over the rows where both are present; NULL where one of them is constant."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def select_predictors(
    df: DataFrame, target: str, candidates: Sequence[str], mincor: float = 0.1
) -> DataFrame:
    """Correlation of each numeric candidate with the target and with its missingness.

    ``keep`` marks candidates where the larger of the two absolute values reaches ``mincor``. All
    pairs are taken in one aggregate.
    """
    gone = F.col(target).isNull().cast("double")
    cells = []
    for x in candidates:
        v = F.col(x).cast("double")
        cells.append(
            F.struct(
                F.lit(x).alias("predictor"),
                _correlation(v, F.col(target)).alias("cor_value"),
                _correlation(v, gone).alias("cor_missing"),
            )
        )
    best = F.greatest(
        F.coalesce(F.abs("c.cor_value"), F.lit(0.0)), F.coalesce(F.abs("c.cor_missing"), F.lit(0.0))
    )
    return (
        df.agg(F.array(*cells).alias("cells"))
        .select(F.explode("cells").alias("c"))
        .select("c.predictor", "c.cor_value", "c.cor_missing", (best >= mincor).alias("keep"))
    )


def screened_predictors(
    df: DataFrame,
    target: str,
    factors: dict[str, Sequence[str]],
    numeric: Sequence[str] = (),
    mincor: float = 0.1,
) -> tuple[dict[str, Sequence[str]], list[str]]:
    """The factors (by level number) and numeric columns that pass ``select_predictors``."""
    coded = df.select(
        target, *[level_index(name, levels).alias(name) for name, levels in factors.items()], *numeric
    )
    table = select_predictors(coded, target, [*factors, *numeric], mincor)
    keep = {r["predictor"] for r in table.where("keep").collect()}  # one row per candidate
    return {f: v for f, v in factors.items() if f in keep}, [n for n in numeric if n in keep]


def audit_columns(df: DataFrame, columns: Sequence[str], limit: float = 0.999) -> DataFrame:
    """Constant columns and nearly collinear pairs, found in one aggregate."""
    cells = []
    for c in columns:
        v = F.col(c).cast("double")
        constant = F.coalesce(F.min(v) == F.max(v), F.lit(True))
        cells.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit("").alias("other"),
                F.when(constant, F.lit("constant")).alias("finding"),
                F.lit(None).cast("double").alias("correlation"),
            )
        )
    for a, b in combinations(columns, 2):
        r = _correlation(F.col(a).cast("double"), F.col(b).cast("double"))
        cells.append(
            F.struct(
                F.lit(a).alias("column_name"),
                F.lit(b).alias("other"),
                F.when(F.abs(r) > limit, F.lit("collinear")).alias("finding"),
                r.alias("correlation"),
            )
        )
    return (
        df.agg(F.array(*cells).alias("cells"))
        .select(F.explode("cells").alias("c"))
        .select("c.*")
        .where(F.col("finding").isNotNull())
    )


def nearest_levels(
    levels: DataFrame, targets: DataFrame, k: int, range_rows: int | None = None
) -> DataFrame:
    """The donor levels that can hold one of the ``k`` nearest donors of each distinct target prediction.

    ``levels(yhat, n)`` has one row per distinct donor prediction, ``targets(yhat)``; result
    ``(yhat, near)`` with near an array of (distance, level, n) in that order. Exact for any data: levels
    are numbered over the whole axis, a target sits after a known number of levels, and the k levels on
    either side of that place hold every possible answer. No other pair is formed.
    """
    levels = cut_lineage(levels.select("yhat", "n"), "donor-levels")
    wanted = targets.select("yhat").distinct()
    points = cut_lineage(
        levels.select("yhat", F.lit(1).alias("_level")).unionByName(
            wanted.select("yhat", F.lit(0).alias("_level"))
        ),
        "levels",
    )
    ranged = with_range(points, "yhat", plan_ranges(points, "yhat", range_rows))
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = (
        ranged.groupBy(RANGE)
        .agg(F.sum("_level").alias("_n"))
        .select(RANGE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    upto = (
        Window.partitionBy(RANGE)
        .orderBy("yhat", F.col("_level").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = cut_lineage(
        ranged.withColumn("_upto", F.sum("_level").over(upto))
        .join(offsets, RANGE)
        .select("yhat", "_level", (F.col("_offset") + F.col("_upto")).alias("place")),
        "target-places",
    )
    numbered = placed.where(F.col("_level") == 1).select("yhat", F.col("place").alias("_no"))
    around = F.explode(F.sequence(F.greatest(F.col("_no") - k, F.lit(0)), F.col("_no") + (k - 1)))
    pools = (
        levels.join(numbered, "yhat")
        .select(around.alias("place"), F.struct(F.col("yhat").alias("level"), "n").alias("near"))
        .groupBy("place")
        .agg(F.collect_list("near").alias("near"))
    )
    asked = placed.where(F.col("_level") == 0).select("yhat", "place")
    found = attach(asked, pools, "place", ["yhat"], "left")
    with_distance = F.transform(
        "near",
        lambda lv: F.struct(
            F.abs(lv["level"] - F.col("yhat")).alias("distance"), lv["level"].alias("level"), lv["n"].alias("n")
        ),
    )
    return found.select("yhat", F.array_sort(with_distance).alias("near"))


def number_donors(donors: DataFrame, seed: int | str, range_rows: int | None = None) -> DataFrame:
    """``donors(donor_id, yhat, y)`` numbered 1, 2, ... among equal predictions, in an order set by a hash.

    ``seed`` may name a column; each seed then has an order of its own.
    """
    by = [seed] if isinstance(seed, str) else []
    order = text_hash(F.col("donor_id"), seed=F.col(seed) if by else seed, stream="donor")
    mixed = donors.select(*by, "donor_id", "yhat", "y", order.alias("_mix"))
    return number_rows(mixed, [*by, "yhat"], ["_mix", "donor_id"], "no", range_rows).drop("_mix")


def _places(near: str, k: int) -> Column:
    """What each place 1..k (or up to the number of donors) of sorted ``near`` chooses: (distance, low, n, high, count).

    Worked out once per distinct prediction, as each target row only looks up its place. At most two levels lie at
    one distance, one on either side; ``n`` donors have the ``low`` one, ``count`` both.
    """
    none = F.lit(0).cast("bigint")
    total = F.aggregate(near, none, lambda s, x: s + x["n"])
    start = F.struct(none.alias("seen"), F.lit(None).cast("double").alias("d"))

    def reach(place: Column) -> Column:
        """The distance at which the counts reach the place."""
        return F.aggregate(
            near,
            start,
            lambda s, x: F.struct(
                (s["seen"] + x["n"]).alias("seen"), F.when(s["seen"] < place, x["distance"]).otherwise(s["d"]).alias("d")
            ),
        )["d"]

    def choice(at: Column) -> Column:
        low = F.try_element_at(at, F.lit(1))
        return F.struct(
            low["distance"].alias("distance"),
            low["level"].alias("low"),
            low["n"].alias("n"),
            F.try_element_at(at, F.lit(2))["level"].alias("high"),
            F.aggregate(at, none, lambda s, x: s + x["n"]).alias("count"),
        )

    reached = F.transform(F.sequence(F.lit(1), F.least(total, F.lit(k)).cast("int")), reach)
    at = F.transform(reached, lambda d: F.filter(near, lambda x: x["distance"] == d))
    return F.when(F.col(near).isNotNull(), F.transform(at, choice))


def draw_donors(
    donors: DataFrame,
    targets: DataFrame,
    k: int = 1,
    seed: int | str = 1,
    keys: Sequence[str] = ("unit_id", "imp"),
    range_rows: int | None = None,
    seeds: Sequence[int] = (),
) -> DataFrame:
    """One donor for each target row, drawn evenly from the ``k`` nearest.

    With ``seeds``, ``seed`` names a column of the targets that holds one of them; all are drawn together, each
    as it would be alone.

    ``donors(donor_id, yhat, y)``, ``targets(keys..., yhat)``; adds ``distance``, ``donor_id`` and ``y``.
    A place in 1..k chooses the distance; where more donors share that distance than places are left,
    all of them are equally likely. Donors with equal predictions are numbered in a hashed order and a
    hash of the keys picks the number, so donors join by (level, number) and no list of them is formed.
    Targets get no donor only if there is none.
    """
    levels = donors.groupBy("yhat").agg(F.count("*").alias("n"))
    by, mark = ([seed], F.col(seed)) if seeds else ([], seed)
    if seeds:
        donors = donors.withColumn(seed, F.explode(F.array(*[F.lit(s) for s in seeds])))
    numbered = cut_lineage(number_donors(donors, seed, range_rows), "donors")
    near = nearest_levels(levels, targets, k, range_rows)
    near = cut_lineage(near.select(F.col("yhat").alias("_yhat"), _places("near", k).alias("_places")), "places")
    hot = hot_keys(targets, "yhat")
    rows = attach(targets.withColumnRenamed("yhat", "_yhat"), near, "_yhat", list(keys), "left", hot)
    ids = [F.col(c) for c in keys]
    place = F.pmod(text_hash(*ids, seed=mark, stream="place"), F.array_size("_places")) + 1
    rows = rows.withColumn("_at", F.element_at("_places", place.cast("int"))).withColumn("distance", F.col("_at.distance"))
    # a number among all donors at that distance
    rows = rows.withColumn("_u", F.pmod(text_hash(*ids, seed=mark, stream="rank"), F.col("_at.count")) + 1)
    beyond = F.col("_u") > F.col("_at.n")
    rows = rows.withColumn("_level", F.when(beyond, F.col("_at.high")).otherwise(F.col("_at.low")))
    rows = rows.withColumn("_no", F.when(beyond, F.col("_u") - F.col("_at.n")).otherwise(F.col("_u")))
    picked = rows.drop("_places", "_at", "_u").join(
        numbered.select(*by, F.col("yhat").alias("_level"), F.col("no").alias("_no"), "donor_id", "y"),
        [*by, "_level", "_no"],
        "left",
    )
    return picked.drop("_level", "_no").withColumnRenamed("_yhat", "yhat")


@dataclass(frozen=True)
class LeastSquares:
    """Least squares with a small ridge: coefficients, and what a draw of them needs."""

    beta: np.ndarray
    root: np.ndarray
    rss: float
    rows: int

    def draw(self, seed: int, imp: int) -> np.ndarray:
        """Coefficients drawn from their posterior under a flat prior, a stream of md5 per seed and imputation.

        The residual variance is the residual sum of squares over a chi-square number, which comes from a normal
        one by Wilson and Hilferty's cube.
        """
        df = max(self.rows - len(self.beta), 1)
        z = text_normal(imp, "variance", seed=seed, stream="proper")
        chi = df * max(1.0 - 2.0 / (9.0 * df) + z * math.sqrt(2.0 / (9.0 * df)), 1e-3) ** 3
        normal = [text_normal(imp, j, seed=seed, stream="proper") for j in range(len(self.beta))]
        return self.beta + math.sqrt(self.rss / chi) * (self.root @ np.array(normal))


def least_squares(df: DataFrame, design: Sequence[Column], target: str, ridge: float = 1e-5) -> LeastSquares:
    """Fit of the target from one aggregate of cross products about the means.

    The first column of the design is the intercept. Two aggregates, of p means and p x p sums, reach the driver.
    """
    xs = [f"_x{i}" for i in range(1, len(design))]
    rows = df.select(*[c.cast("double").alias(x) for x, c in zip(xs, design[1:])], F.col(target).cast("double").alias("_y"))
    rows = rows.dropna("any")
    names = [*xs, "_y"]
    found = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in names]).first()
    mean = np.array([found[c] or 0.0 for c in names])
    off = [F.col(c) - F.lit(float(m)) for c, m in zip(names, mean)]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = rows.agg(*[F.sum(off[i] * off[j]).alias(f"s{i}_{j}") for i, j in pairs]).first()
    full = np.zeros((len(names), len(names)))
    for i, j in pairs:
        full[i, j] = full[j, i] = row[f"s{i}_{j}"] or 0.0
    xx, xy, n = full[:-1, :-1], full[:-1, -1], found["n"]
    spread = xx + np.diag(ridge * np.diag(xx))
    slope = np.linalg.lstsq(spread, xy, rcond=None)[0]
    rss = max(float(full[-1, -1] - 2 * slope @ xy + slope @ xx @ slope), 0.0)
    back = np.eye(len(design))  # coefficients of the centred columns to those of the given ones
    back[0, 1:] = -mean[:-1]
    root = np.zeros((len(design), len(design)))
    root[0, 0], root[1:, 1:] = max(n, 1) ** -0.5, _root(np.linalg.pinv(spread))
    beta = back @ np.concatenate([[mean[-1]], slope])
    return LeastSquares(beta, back @ root, rss, n)


def _root(matrix: np.ndarray) -> np.ndarray:
    """Cholesky factor; of a singular matrix (a constant or doubled column) the symmetric one."""
    try:
        return np.linalg.cholesky(matrix)
    except np.linalg.LinAlgError:
        value, vector = np.linalg.eigh((matrix + matrix.T) / 2)
        return vector * np.sqrt(np.maximum(value, 0.0))


def dummies(factors: dict[str, Sequence[str]], numeric: Sequence[str] = ()) -> list[Column]:
    """Intercept, 0/1 columns of all but the reference level, numeric columns."""
    cols = [F.lit(1.0)]
    for name, levels in factors.items():
        for level in levels[1:]:
            known = F.col(name).isin(list(levels))
            cols.append(F.when(known, (F.col(name) == level).cast("double")))
    return cols + [F.col(n).cast("double") for n in numeric]


def impute_pmm(
    df: DataFrame,
    target: str,
    factors: dict[str, Sequence[str]],
    numeric: Sequence[str] = (),
    donors: int = 5,
    m: int = 1,
    seed: int = 1,
    unit: str = "unit_id",
    range_rows: int | None = None,
    proper: bool = False,
    seeds: Sequence[int] = (),
) -> DataFrame:
    """Fill the missing values of one column by predictive mean matching; adds ``imp`` in 1..m.

    The linear prediction uses the point estimate of the coefficients; with ``proper`` that of a missing value
    uses coefficients drawn anew for each imputation, so that several imputations differ as they should. With
    ``seeds`` instead of one seed there is a column ``seed`` and a whole table for each, made together. A missing value takes the
    observed value of one of the ``donors`` nearest observed rows, drawn by a hash of unit, imputation
    and seed; donors at equal distance are equally likely. Rows with a missing predictor cannot be
    predicted and stay missing.
    """
    design = dummies(factors, numeric)
    fit = least_squares(df, design, target)
    scored = cut_lineage(df.withColumn("_yhat", _line(fit.beta, design)), "scored-units")
    observed = scored.where(F.col(target).isNotNull() & F.col("_yhat").isNotNull()).select(
        F.col(unit).alias("donor_id"), F.col("_yhat").alias("yhat"), F.col(target).alias("y")
    )
    if "seed" in df.columns and seeds:
        raise ValueError("the units have a column named seed already")
    imps = F.sequence(F.lit(1), F.lit(m))
    cells = F.array(*[F.lit(s) for s in seeds]) if seeds else F.array(F.lit(seed))
    copies = F.inline(F.flatten(F.transform(cells, lambda s: F.transform(imps, lambda i: F.struct(s.alias("seed"), i.alias("imp"))))))
    open_rows = scored.where(F.col(target).isNull() & F.col("_yhat").isNotNull()).select("*", copies)
    yhat = F.col("_yhat")
    if proper:
        drawn = [fit.draw(s, i) for s in (seeds or [seed]) for i in range(1, m + 1)]
        at = (F.array_position(cells, F.col("seed")).cast("int") - 1) * m + F.col("imp") - 1
        each = [F.array(*[F.lit(float(b[j])) for b in drawn])[at] for j in range(len(design))]
        yhat = sum((b * x for b, x in zip(each, design)), F.lit(0.0))
    columns = [c for c in df.columns if c != target]
    by = ["seed"] if seeds else []
    asked = cut_lineage(open_rows.select(*columns, yhat.alias("yhat"), "imp", *by), "targets")
    filled = draw_donors(observed, asked, donors, "seed" if seeds else seed, (unit, "imp"), range_rows, seeds)
    drawn = filled.select(*columns, F.col("y").alias(target), "imp", *by)
    kept = scored.where(F.col(target).isNotNull() | F.col("_yhat").isNull()).select(*columns, target, copies)
    return kept.select(*columns, target, "imp", *by).unionByName(drawn)


def _line(beta: Sequence[float], design: Sequence[Column]) -> Column:
    return sum((float(b) * x for b, x in zip(beta, design)), F.lit(0.0))
