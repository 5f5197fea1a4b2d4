"""Tail areas Spark SQL has no function for; applied to result tables of a few rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_erfc = np.vectorize(math.erfc, otypes=[float])


def normal_cdf_array(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(-np.asarray(z, dtype=float) / math.sqrt(2.0))


def chisq_tail_value(x: float, df: float) -> float:
    """P(X > x) for whole degrees of freedom, from the finite sums of the gamma tail."""
    if x is None or df is None or math.isnan(x) or math.isnan(df) or df < 1:
        return math.nan
    half, k = x / 2.0, int(df)
    if half <= 0:
        return 1.0
    total = 0.0 if k % 2 == 0 else math.erfc(math.sqrt(half))
    shape = 0.0 if k % 2 == 0 else 0.5
    while shape < k / 2.0 - 1e-9:
        total += math.exp(shape * math.log(half) - half - math.lgamma(shape + 1.0))
        shape += 1.0
    return min(total, 1.0)


@F.pandas_udf(DoubleType())
def chisq_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chisq_tail_value(a, b) for a, b in zip(x, df)], dtype=float)


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return pd.Series(normal_cdf_array(z.to_numpy(dtype=float)))


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series(_erfc(np.abs(z.to_numpy(dtype=float)) / math.sqrt(2.0)))
