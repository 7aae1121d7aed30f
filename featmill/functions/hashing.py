"""Seeded, portable pseudo-random values: the same in every engine and on every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_order(seed: int, *parts: Column) -> Column:
    """Sort key of a seeded permutation."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def seeded_uniform(seed: int, *parts: Column) -> Column:
    """Uniform value in (0, 1) with 32 random bits."""
    word = F.conv(F.substring(seeded_order(seed, *parts), 1, 8), 16, 10).cast("double")
    return (word + 0.5) / float(1 << 32)
