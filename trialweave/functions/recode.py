"""Column expressions for recoding labels and filtering rows, with declared NULL behaviour."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def recode_threshold(col: Column | str, cut: float, below, above) -> Column:
    """``below`` under the cut, ``above`` from the cut on; a missing value stays missing."""
    c = _col(col)
    return F.when(c < cut, F.lit(below)).when(c >= cut, F.lit(above))


def recode_member(col: Column | str, values: Iterable, yes, no) -> Column:
    """``yes`` for listed values, ``no`` for everything else, missing values included."""
    return F.when(_col(col).isin(list(values)), F.lit(yes)).otherwise(F.lit(no))


def recode_equal(col: Column | str, value, yes, no) -> Column:
    """``yes`` on equality, ``no`` on inequality; a missing value stays missing."""
    c = _col(col)
    return F.when(c == value, F.lit(yes)).when(c != value, F.lit(no))


def with_levels(col: Column | str, levels: Sequence[str]) -> Column:
    """Restrict a label column to a closed set; labels outside the set become missing."""
    c = _col(col)
    return F.when(c.isin(list(levels)), c)


def level_index(col: Column | str, levels: Sequence[str]) -> Column:
    """1-based position in the level list (the first level is the reference level)."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), _col(col))
    return F.when(position > 0, position).cast("int")


def id_number(col: Column | str) -> Column:
    """Numeric id from text; text that is no number becomes missing."""
    return _col(col).try_cast("bigint")


def cohort_flag(col: Column | str, cut) -> Column:
    """1 up to and including the cut, 0 above it; a missing or non-numeric id stays missing."""
    c = _col(col).try_cast("bigint")
    limit = cut if isinstance(cut, Column) else F.lit(cut)
    return F.when(c <= limit, F.lit(1)).when(c > limit, F.lit(0))


def in_list(col: Column | str, values: Iterable) -> Column:
    return _col(col).isin(list(values))


def not_in_list(col: Column | str, values: Iterable) -> Column:
    """Negated membership that keeps rows whose value is missing."""
    return ~F.coalesce(_col(col).isin(list(values)), F.lit(False))


def flag(positive: Column, negative: Column) -> Column:
    """1/0 by two explicit conditions, missing when neither holds."""
    return F.when(positive, F.lit(1)).when(negative, F.lit(0))


def greater_flag(value: Column, cut: float = 0.0) -> Column:
    return flag(value > cut, value <= cut)


def at_least_flag(value: Column, cut: float) -> Column:
    return flag(value >= cut, value < cut)


def less_flag(value: Column, cut: float = 0.0) -> Column:
    return flag(value < cut, value >= cut)


def missing_to_null(col: Column | str) -> Column:
    """Numeric missing marks (NaN) as NULL."""
    c = _col(col)
    return F.when(~F.isnan(c), c)


def substitute_outcome(
    outcome: Column | str,
    old_arm: Column | str,
    arm: Column | str,
    pred: Column | str,
    keep_missing: bool = True,
) -> Column:
    """Observed outcome under the observed arm, predicted outcome under any other arm.

    With ``keep_missing`` a unit without an observed outcome stays without one under every arm.
    """
    y, old, new, p = _col(outcome), _col(old_arm), _col(arm), _col(pred)
    chosen = F.when(old == new, y).when(old != new, p.cast("double"))
    return F.when(y.isNotNull(), chosen) if keep_missing else chosen
