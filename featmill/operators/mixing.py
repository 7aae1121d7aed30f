"""Shuffling, sampling and weighted mixing of datasets.

Every random choice is a seeded hash of the row's own identity, so a rerun, a retried task or another
partitioning gives the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featmill.functions.hashing import seeded_order, seeded_uniform
from featmill.operators.ordinals import number_rows
from featmill.session import materialize


def pick_shards(shards: DataFrame, shard: str, seed: int, n: int = 5) -> DataFrame:
    """``n`` random rows of a table of shards; a top-n per task, then over all."""
    return shards.orderBy(seeded_order(seed, F.col(shard)), shard).limit(n)


def sample_per_shard(df: DataFrame, shard: str, key: str, seed: int, n: int = 8) -> DataFrame:
    """``n`` random samples of each shard; every task keeps its own best ``n`` per shard before the shuffle."""
    rank = Window.partitionBy(shard).orderBy(seeded_order(seed, F.col(shard), F.col(key)), key)
    return df.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= n).drop("_rank")


def spot_check_sample(
    df: DataFrame, shard: str, key: str, seed: int, shards: int = 5, per_shard: int = 8
) -> DataFrame:
    """``per_shard`` random samples of each of ``shards`` random shards."""
    chosen = pick_shards(df.select(shard).distinct(), shard, seed, shards)
    return sample_per_shard(df.join(F.broadcast(chosen), shard, "left_semi"), shard, key, seed, per_shard)


def shard_shuffle(shards: DataFrame, shard: str, seed: int, epoch: int = 0) -> DataFrame:
    """Seeded permutation of the shards, another one every epoch; adds ``position``."""
    hashed = shards.withColumn("_h", seeded_order(seed, F.lit(epoch), F.col(shard)))
    return number_rows(hashed, order=["_h", shard], ordinal="position").drop("_h")


def buffer_shuffle(
    df: DataFrame, order: Sequence[str], key: str, seed: int, buffer: int = 1000, rank: int = 0, epoch: int = 0
) -> DataFrame:
    """Shuffle within consecutive buffers of the stream; adds ``position``. A buffer holds ``buffer`` rows."""
    placed = number_rows(df, order=order, ordinal="_ord").withColumn("_buffer", F.expr(f"_ord div {int(buffer)}"))
    hashed = seeded_order(seed, F.lit(rank), F.lit(epoch), F.col(key))
    within = Window.partitionBy("_buffer").orderBy(hashed, key)
    position = F.col("_buffer") * buffer + F.row_number().over(within) - 1
    return placed.withColumn("position", position).drop("_ord", "_buffer")


# Parts of a position, or of the mean gap of the heaviest dataset, that hashed delays and gaps are counted in.
_PARTS, _TICKS = 1 << 20, 1 << 24


def sliding_shuffle(
    df: DataFrame, order: Sequence[str], key: str, seed: int, buffer: int = 1000, rank: int = 0, epoch: int = 0
) -> DataFrame:
    """Shuffle as a buffer of ``buffer`` rows does that a stream runs through; adds ``position``.

    A row that enters a full buffer waits there until it is drawn, which happens to it with a chance of one in ``buffer`` at every
    step: a delay of ``buffer`` rows on average, without an end. Here each row gets its delay from its own key, exponentially
    distributed with that mean, and rows are ordered by position plus delay, all at once. Both are whole numbers of
    parts of a position, so the result is the same under any partitioning. Rows leave the neighbourhood they came from,
    which those of :func:`buffer_shuffle` never do.
    """
    delay = -F.log(seeded_uniform(seed, F.lit(rank), F.lit(epoch), F.col(key))) * float(buffer * _PARTS)
    placed = number_rows(df, order=order, ordinal="_ord")
    due = placed.withColumn("_due", F.col("_ord") * _PARTS + F.floor(delay)).drop("_ord")
    return number_rows(due, order=["_due", key], ordinal="position").drop("_due")


def _ticks(u: Column) -> Column:
    """A gap of a stream of rate ``_w`` as a whole number; the heaviest stream has rate 1."""
    return F.floor(-F.log(u) / F.col("_w") * float(_TICKS)).cast("decimal(24,0)")


def _race(
    df: DataFrame, weights: DataFrame, dataset: str, order: Sequence[str], key: str, seed: int
) -> DataFrame:
    """Arrival times: dataset i is a Poisson stream of rate ``weight_i``.

    The next arrival over all streams belongs to a live stream with probability proportional to its weight,
    and a stream that has ended simply stops, which leaves the others with renormalised weights. The gap
    before a sample comes from the sample's own key, so it needs no position and one pass gives all. Times are
    whole numbers, whose sums do not depend on how rows are dealt out. Adds ``_j`` (rank in the dataset), ``_n`` (its
    size), ``_w`` (its rate) and ``_t`` (arrival time).
    """
    rates = materialize(weights.where(F.col("weight") > 0).select(F.col(dataset), F.col("weight").cast("double").alias("_w")), "rates")
    # The largest weight, unlike their sum, is the same whatever the order of the rows.
    rates = rates.withColumn("_w", F.col("_w") / rates.agg(F.max("_w").alias("_top")).scalar())
    stepped = df.join(rates, dataset).withColumn("_gap", _ticks(seeded_uniform(seed, F.col(dataset), F.col(key))))
    return number_rows(stepped, [dataset], order, ordinal="_j", size="_n", running={"_t": "_gap"}).drop("_gap")


def _ranked(raced: DataFrame, dataset: str) -> DataFrame:
    out = number_rows(raced, order=["_t", dataset, "_j"], ordinal="mix_rank")
    return out.drop("_j", "_n", "_w", "_t")


def mix_all_exhausted(
    df: DataFrame, weights: DataFrame, dataset: str, order: Sequence[str], key: str, seed: int = 0
) -> DataFrame:
    """Weighted random interleave that runs until every dataset is used up; adds ``mix_rank``.

    ``weights`` is ``(dataset, weight)``; ``key`` identifies a sample within its dataset. Each sample occurs
    once, in the ``order`` of its own dataset.
    """
    return _ranked(_race(df, weights, dataset, order, key, seed), dataset)


def mix_first_exhausted(
    df: DataFrame, weights: DataFrame, dataset: str, order: Sequence[str], key: str, seed: int = 0
) -> DataFrame:
    """The same interleave up to the first draw from a dataset that has nothing left."""
    raced = _race(df, weights, dataset, order, key, seed)
    # The draw that finds nothing is one more arrival after the dataset's last sample.
    extra = _ticks(seeded_uniform(seed, F.col(dataset), F.lit("end")))
    ends = raced.where(F.col("_j") == F.col("_n") - 1).select((F.col("_t") + extra).alias("_end"))
    stop = ends.agg(F.min("_end").alias("_stop"))
    kept = raced.where(F.col("_t") < stop.scalar())
    return _ranked(kept, dataset)


def epoch_steps(expected_length: Column, batch_size: int, world: int) -> Column:
    """Optimiser steps of one epoch."""
    return F.ceil(expected_length / float(batch_size) / float(world))


def epoch_limit(
    mixed: DataFrame, expected_length: DataFrame, batch_size: int, world: int = 1
) -> DataFrame:
    """The samples one epoch consumes. ``expected_length`` is one row ``(expected)``."""
    bound = expected_length.select(
        (epoch_steps(F.col("expected"), batch_size, world) * (batch_size * world)).alias("_bound")
    )
    return mixed.where(F.col("mix_rank") < bound.scalar())


def random_targets(batches: DataFrame, batch: str, models: Sequence[str], seed: int, k: int = 2) -> DataFrame:
    """``k`` random target models per batch. Row-local: the models are ranked in an array, not by a shuffle."""
    hashed = [F.struct(seeded_order(seed, F.col(batch), F.lit(m)).alias("h"), F.lit(m).alias("m")) for m in models]
    chosen = F.slice(F.array_sort(F.array(*hashed)), 1, k)
    return batches.withColumn("model", F.explode(chosen["m"]))
