"""Channel statistics of feature tensors in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmill.functions.tensors import double_array, feature_denormalize, feature_normalize, unroll
from featmill.session import materialize


def channel_values(
    df: DataFrame, tensor: str, c: int, n_tokens: int, keep: Sequence[str] = (), tokens_first: bool = False
) -> DataFrame:
    """Long form ``(keep..., channel, value)`` of ``[c, n_tokens]`` tensors, or ``[n_tokens, c]`` ones.

    Meant to feed an aggregation: the exploded rows live inside one generated loop and are reduced on the
    map side, so they never reach a shuffle.
    """
    long = unroll(df, keep, tensor, "_pos", "_value")
    channel = F.col("_pos") % c if tokens_first else F.expr(f"_pos div {int(n_tokens)}")
    return long.select(*keep, channel.cast("int").alias("channel"), F.col("_value").cast("double").alias("value"))


def channel_stats(
    df: DataFrame, tensor: str, c: int, n_tokens: int, by: Sequence[str] = (), tokens_first: bool = False
) -> DataFrame:
    """``(by..., channel, n, mean, std)``; ``std`` is the sample standard deviation."""
    return (
        channel_values(df, tensor, c, n_tokens, by, tokens_first)
        .groupBy(*by, "channel")
        .agg(
            F.count("value").alias("n"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
        )
    )


def partial_moments(df: DataFrame, tensor: str, c: int, n_tokens: int, by: Sequence[str]) -> DataFrame:
    """Mergeable ``(by..., channel, n, mean, m2)``, for instance one set per shard."""
    return (
        channel_values(df, tensor, c, n_tokens, by)
        .groupBy(*by, "channel")
        .agg(
            F.count("value").alias("n"),
            F.avg("value").alias("mean"),
            (F.var_pop("value") * F.count("value")).alias("m2"),
        )
    )


def merge_moments(partials: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Merge partial moments into ``(by..., channel, n, mean, std)``; one value has no spread (null).

    Spread is measured around the merged mean, not from raw squares, so a large mean costs no digits.
    """
    keys = [*by, "channel"]
    total = partials.groupBy(*keys).agg(
        F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean")
    )
    shifted = partials.join(total, keys).withColumn(
        "_m2", F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), 2)
    )
    return shifted.groupBy(*keys).agg(
        F.first("_n").alias("n"),
        F.first("_mean").alias("mean"),
        F.sqrt(F.sum("_m2") / F.when(F.first("_n") > 1, F.first("_n") - 1)).alias("std"),
    )


def stats_arrays(stats: DataFrame) -> DataFrame:
    """One row per model with ``mean`` and ``std`` as arrays in channel order (a few thousand values)."""
    packed = stats.groupBy("model").agg(
        F.array_sort(F.collect_list(F.struct("channel", "mean", "std"))).alias("_s")
    )
    return packed.select("model", F.col("_s.mean").alias("mean"), F.col("_s.std").alias("std"))


def _with_stats(df: DataFrame, stats: DataFrame, value: Column) -> DataFrame:
    arrays = stats_arrays(stats).withColumnsRenamed({"mean": "_mean", "std": "_std"})
    # Written first, the statistics' true size decides how Spark joins them: sent to all, or as a sorted join whose
    # large keys adaptive execution splits.
    return df.join(materialize(arrays, "statistics"), "model", "left").withColumn("embedding", value).drop("_mean", "_std")


def normalize_features(df: DataFrame, stats: DataFrame, c: int, n_tokens: int) -> DataFrame:
    """Normalise ``embedding`` (tokens) by the statistics of its ``model``; without any it stays as it is."""
    return _with_stats(df, stats, feature_normalize("embedding", "_mean", "_std", c, n_tokens))


def normalize_model(df: DataFrame, stats: DataFrame, model: str, c: int, n_tokens: int) -> DataFrame:
    """Normalise ``embedding`` (tokens) where all rows are one model's; without statistics it stays as it is.

    The model's ``c`` means and spreads become literals of the plan, so there is nothing to join.
    """
    rows = stats.where(F.col("model") == model).select("channel", "mean", "std").limit(c + 1).collect()
    if not rows:
        return df
    rows.sort(key=lambda r: r["channel"])
    if [r["channel"] for r in rows] != list(range(c)):
        raise ValueError(f"statistics of {model} do not cover {c} channels")
    mean, std = (double_array([r[name] for r in rows]) for name in ("mean", "std"))
    return df.withColumn("embedding", feature_normalize("embedding", mean, std, c, n_tokens))


def denormalize_features(df: DataFrame, stats: DataFrame, c: int, n_tokens: int) -> DataFrame:
    """Inverse of :func:`normalize_features`."""
    return _with_stats(df, stats, feature_denormalize("embedding", "_mean", "_std", c, n_tokens))
