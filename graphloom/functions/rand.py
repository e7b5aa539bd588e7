"""Seeded, counter-based randomness: a draw depends on the seed and the row's own key, never on partitions or order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in (0, 1) from a 64-bit hash of the keys."""
    h = F.xxhash64(F.lit(seed), *[F.col(k) if isinstance(k, str) else k for k in keys])
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def exponential_key(weight: Column, seed: int, *keys: Column | str) -> Column:
    """-ln(u)/weight: the k smallest keys are a draw of k without replacement, in proportion to the weights."""
    return F.when(weight > 0, -F.log(uniform(seed, *keys)) / weight)


def poisson(rate: Column, seed: int, *keys: Column | str, top: int = 64) -> Column:
    """A Poisson draw by inversion of its distribution function; ``top`` bounds the search where the tail is below 1e-15."""
    u = uniform(seed, *keys)
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(top)),
        F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.when(u > F.exp(-rate), 1).otherwise(0).alias("k")),
        lambda s, i: F.struct((s["p"] * rate / i).alias("p"), (s["c"] + s["p"] * rate / i).alias("c"), F.when(u > s["c"] + s["p"] * rate / i, i + 1).otherwise(s["k"]).alias("k")),
    )
    return step["k"]
