"""Joins and id filters of the trial tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.session import shuffle_partitions

#: A key is hot above this share of all rows, or with this many rows if that is fewer; each salt takes about as many.
HOT_SHARE = 0.01
TASK_ROWS = 1_000_000
#: Smallest share that is looked for: at most 1,000 keys are kept apart.
LEAST_SHARE = 0.001
LEAST_SALTS = 64


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> dict:
    """Key values with very many rows, and the number of tasks each is to be spread over.

    A pass with a fixed-size sketch per task names every value that may be hot; a second pass counts
    just those. Neither shuffles the table by key.
    """
    keys = df.select(key).where(F.col(key).isNotNull())
    maybe = keys.stat.freqItems([key], min(share, LEAST_SHARE)).first()[0] or []
    if not maybe:
        return {}
    listed = F.when(F.col(key).isin(list(maybe)), F.col(key))
    counts = {r[0]: r[1] for r in keys.groupBy(listed).count().collect()}
    floor = min(share * sum(counts.values()), TASK_ROWS)
    hot = {k: n for k, n in counts.items() if k is not None and n > floor}
    return {k: max(LEAST_SALTS, -(-hot[k] // TASK_ROWS)) for k in sorted(hot)}


def _salts(key: str, hot: Mapping | Sequence) -> Column | None:
    """Number of salts of the row's key; 1 for keys that are not hot."""
    if not hot:
        return None
    each = hot if isinstance(hot, Mapping) else dict.fromkeys(hot, LEAST_SALTS)
    out = F.lit(1)
    for n in sorted(set(each.values())):
        out = F.when(F.col(key).isin([k for k, m in each.items() if m == n]), n).otherwise(out)
    return out


def attach(
    facts: DataFrame,
    keyed: DataFrame,
    key: str,
    spread: Sequence[str],
    how: str = "left",
    hot: Mapping | Sequence | None = None,
    deal: bool = False,
) -> DataFrame:
    """Join a table with one row per ``key`` to a table where some keys, or no key, hold very many rows.

    Rows of a hot key are spread over its salts by a hash of the ``spread`` columns, and the keyed row is
    copied once per salt; every fact row still meets exactly one copy. Rows without a key meet nothing
    and are spread over all tasks. Other keys join as usual. ``how`` is ``left``, ``inner``,
    ``left_semi`` or ``left_anti``.

    With ``deal`` the rows go to as many tasks as a shuffle has, however few bytes they are: for rows that are
    small in bytes and much work each, which would else follow their files or be coalesced, and keyed rows too
    wide to be copied to every task.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError("copies of keyed rows may only be matched, never kept on their own")
    if hot is None:
        hot = hot_keys(facts, key)
    salts = _salts(key, hot)
    if deal and salts is None:
        salts = F.lit(1)  # a salt worked out per row stays among the join's keys, a literal would take its dealt tasks away
    mixed = F.xxhash64(*spread)
    own = F.lit(0).cast("bigint") if salts is None else F.pmod(mixed, salts)
    salted = facts.withColumn("_salt", F.when(F.col(key).isNull(), mixed).otherwise(own))
    if salts is None:
        copied = keyed.withColumn("_salt", F.lit(0).cast("bigint"))
    else:
        copied = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), (salts - 1).cast("bigint"))))
    if deal:
        tasks = shuffle_partitions(facts.sparkSession)
        salted, copied = (x.repartition(tasks, key, "_salt") for x in (salted, copied))
        copied = copied.hint("merge")
    return salted.join(copied, [key, "_salt"], how).drop("_salt")


def left_join(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, hot: Mapping | Sequence | None = None
) -> DataFrame:
    """Left equi-join on differently named keys, hot keys spread; missing keys match missing keys.

    The right table has one row per key, so a missing key on both sides adds one match per left row.
    """
    if hot is None:
        hot = hot_keys(left, left_key)
    other = right.withColumnRenamed(right_key, "_right_key")
    mixed = F.xxhash64(*[F.col(c) for c in left.columns])

    def salts(key: str) -> Column:
        known = _salts(key, hot)
        return F.when(F.col(key).isNull(), LEAST_SALTS).otherwise(F.lit(1) if known is None else known)

    salted = left.withColumn("_salt", F.pmod(mixed, salts(left_key)))
    copied = other.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), (salts("_right_key") - 1).cast("bigint"))))
    same = salted[left_key].eqNullSafe(copied["_right_key"]) & (salted["_salt"] == copied["_copy"])
    return salted.join(copied, same, "left").drop("_right_key", "_salt", "_copy")


def keep_listed(
    df: DataFrame, ids: DataFrame, key: str, spread: Sequence[str], hot: Sequence | None = None
) -> DataFrame:
    """Rows whose id is in a table of ids."""
    return attach(df, ids.select(key), key, spread, "left_semi", hot)


def drop_listed(
    df: DataFrame, ids: DataFrame, key: str, spread: Sequence[str], hot: Sequence | None = None
) -> DataFrame:
    """Rows whose id is not in a table of ids; rows with a missing id stay."""
    return attach(df, ids.select(key), key, spread, "left_anti", hot)


def slot_join(
    numbered: DataFrame, schedule: DataFrame, strata: Sequence[str] = (), number: str = "rownumber"
) -> DataFrame:
    """Give the k-th cluster of each stratum the k-th slot of its schedule (left join)."""
    return numbered.join(schedule, [*strata, number], "left")


def attach_new_arm(
    units: DataFrame,
    assigned: DataFrame,
    cluster: str = "cluster_id",
    unit: str = "unit_id",
    keep_old: str | None = None,
    hot: Sequence | None = None,
) -> DataFrame:
    """Replace each unit's arm by the arm newly assigned to its cluster (column ``treatment``)."""
    base = units.withColumnRenamed("arm", keep_old) if keep_old else units.drop("arm")
    new = assigned.select(cluster, F.col("treatment").alias("arm"))
    return attach(base, new, cluster, [unit], "left", hot)


def predictions_right(units: DataFrame, preds: DataFrame) -> DataFrame:
    """Right outer join to the per-imputation predictions on (unit, arm)."""
    return units.join(preds, ["unit_id", "arm"], "right")


def predictions_matched(units: DataFrame, preds: DataFrame) -> DataFrame:
    """The matched part of ``predictions_right``: the not-NULL filter makes it an inner join."""
    return units.where(F.col("cluster_id").isNotNull()).join(preds, ["unit_id", "arm"])


def count_unassigned(units: DataFrame) -> DataFrame:
    """How many units got no arm, as their stratum is missing or has no schedule."""
    return units.agg(F.count_if(F.col("arm").isNull()).alias("n_unassigned"))
