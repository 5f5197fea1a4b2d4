"""Random numbers derived from row keys.

A value depends only on its keys and the seed, so it does not change with the number of
partitions and is the same when a lost task runs again.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(*keys: Column, seed: int, stream: str = "") -> Column:
    """Uniform number in (0, 1)."""
    h = F.xxhash64(*keys, F.lit(seed), F.lit(stream))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(2**53)


def hash_normal(*keys: Column, seed: int, stream: str = "") -> Column:
    """Standard normal number by the Box-Muller transform."""
    u = hash_uniform(*keys, seed=seed, stream=stream + "/radius")
    v = hash_uniform(*keys, seed=seed, stream=stream + "/angle")
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * v)


def hash_pick(n: Column, *keys: Column, seed: int, stream: str = "") -> Column:
    """Whole number in 1..n."""
    return (F.pmod(F.xxhash64(*keys, F.lit(seed), F.lit(stream)), n) + 1).cast("int")


def text_hash(*keys: Column, seed: int | Column, stream: str) -> Column:
    """Whole number below 2**48 from md5 of the keys as text, so that another engine can repeat it."""
    seed = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws("|", *[k.cast("string") for k in keys], seed, F.lit(stream))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")


def text_normal(*keys, seed: int, stream: str) -> float:
    """Standard normal number from md5 of the keys as text, on the driver; another engine can repeat it."""

    def uniform(which: str) -> float:
        text = "|".join([*map(str, keys), str(seed), f"{stream}/{which}"])
        return (int(hashlib.md5(text.encode()).hexdigest()[:12], 16) + 0.5) / 2.0**48

    return math.sqrt(-2.0 * math.log(uniform("radius"))) * math.cos(2.0 * math.pi * uniform("angle"))
