"""Joins of separately stored columns, of plans with manifests, and of result panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmill.functions.naming import sample_key
from featmill.functions.tensors import gather, grid, sized
from featmill.operators.ordinals import number_rows


def merge_columns(columns: Sequence[DataFrame], keys: Sequence[str] = ("dataset", "key")) -> DataFrame:
    """Put the columns of a sample side by side; samples lacking one of them are dropped.

    Alignment comes from the key, never from the order of rows. Tables bucketed by the key join without
    a shuffle.
    """
    return reduce(lambda left, right: left.join(right, list(keys)), columns)


def merge_positional(a: DataFrame, b: DataFrame, order_a: Sequence[str], order_b: Sequence[str]) -> DataFrame:
    """The n-th row of ``a`` with the n-th of ``b``; stops with the shorter one."""
    left = number_rows(a, order=order_a, ordinal="ordinal")
    right = number_rows(b, order=order_b, ordinal="ordinal")
    return left.join(right, "ordinal")


def merge_first_wins(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Merge sources on the key; where a column occurs more than once, the earliest source having it wins."""
    keys = list(keys)
    renamed, owners = [], {}
    for i, source in enumerate(sources):
        names = {c: f"_{i}_{c}" for c in source.columns if c not in keys}
        renamed.append(source.withColumnsRenamed(names))
        for column, name in names.items():
            owners.setdefault(column, []).append(F.col(name))
    joined = reduce(lambda left, right: left.join(right, keys), renamed)
    return joined.select(*keys, *[F.coalesce(*parts).alias(c) for c, parts in owners.items()])


def key_alignment(images: DataFrame, features: DataFrame) -> DataFrame:
    """Compare the keys of two member listings ``(shard, member)`` position by position.

    ``(shard, pos, image_key, feature_key, aligned)``, one row per position of either side.
    """

    def keyed(members: DataFrame, name: str) -> DataFrame:
        placed = number_rows(members.select("shard", "member"), ["shard"], ["member"], ordinal="pos")
        return placed.select("shard", "pos", sample_key(F.col("member")).alias(name))

    both = keyed(images, "image_key").join(keyed(features, "feature_key"), ["shard", "pos"], "full_outer")
    return both.withColumn("aligned", F.col("image_key").eqNullSafe(F.col("feature_key")))


def resume_pending(planned: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned work that is not done yet; ``done`` holds complete results only."""
    return planned.join(done.select(*keys).distinct(), list(keys), "left_anti")


def compare_panel(
    images: DataFrame, panels: Mapping[str, DataFrame], key: str, h: int, w: int, channels: int = 3
) -> DataFrame:
    """One wide image per sample: the input and every panel side by side, row by row of pixels.

    ``images`` and each panel hold ``(key, px)`` with ``[h, w, channels]`` values. A panel that a sample
    lacks is shown black; one of another size ends the job.
    """
    size = h * w * channels
    black = F.array_repeat(F.lit(0.0), size)
    joined = images.select(key, F.col("px").alias("_px_0"))
    for i, panel in enumerate(panels.values(), start=1):
        joined = joined.join(panel.select(key, F.col("px").alias(f"_px_{i}")), key, "left")
    parts: list[Column] = [sized(f"_px_{i}", size, lambda t: t) for i in range(len(panels) + 1)]
    parts[1:] = [F.coalesce(part, black) for part in parts[1:]]
    blocks = [k * size + grid(h, w, channels) for k in range(len(parts))]
    return joined.select(key, gather(F.concat(*parts), np.concatenate(blocks, axis=1), len(parts) * size).alias("px"))
