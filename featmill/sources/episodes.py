"""Nested episodes: steps with one observation per camera view."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmill.operators.ordinals import number_rows


def nest_episodes(
    steps: DataFrame, episode: str, order: Sequence[str], observation: str = "observation", length: int = 1000,
    segment_bytes: int = 64 << 20,
) -> DataFrame:
    """``(episode, segment, steps)`` from one row per step with an ``observation`` map by camera view.

    ``episode`` and ``order`` identify a step. An episode is held as segments of consecutive steps: at most ``length``, and no
    more than ``segment_bytes`` beyond its last one, so a row stays small however long the episode and however large a
    step is. Steps are numbered and their bytes added up by key; the observations join afterwards and are written nowhere.
    """
    keys = [episode, *order]
    # A step costs its bytes, and at least its share of a segment of the most steps.
    unit = max(1, segment_bytes // length)
    size = F.aggregate(F.map_values(observation), F.lit(0).cast("bigint"), lambda a, v: a + F.coalesce(F.octet_length(v), F.lit(0)))
    narrow = steps.select(*keys, F.greatest(F.coalesce(size, F.lit(0)), F.lit(unit)).alias("_cost"))
    placed = number_rows(narrow, [episode], order, ordinal="_frame", running={"_end": "_cost"})
    segment = F.expr(f"(_end - _cost) div {unit * length}")
    placed = placed.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_frame", segment.alias("segment"))
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    step = F.struct(F.col("_frame").alias("frame"), F.col(observation).alias("observation"))
    # Maps have no order of their own; the frame decides.
    by_frame = lambda a, b: (a["frame"] - b["frame"]).cast("int")
    return (
        steps.select(*keys, observation)
        .join(placed, match)
        .groupBy(episode, "segment")
        .agg(F.array_sort(F.collect_list(step), by_frame).alias("steps"))
    )


def episode_frames(episodes: DataFrame, episode: str) -> DataFrame:
    """One row per frame and view: ``(episode, frame_idx, view, image)``."""
    steps = episodes.select(episode, F.explode("steps").alias("step"))
    return steps.select(
        episode, F.col("step.frame").alias("frame_idx"), F.explode("step.observation").alias("view", "image")
    )
