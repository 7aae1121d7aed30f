"""Positions: ordinals, frame numbers, running sums, and what follows from them.

Everything here rests on :func:`number_rows`. A plain ``row_number()`` over one group puts that group
into one task, and an ungrouped one puts the whole table there. Instead the rows are range-partitioned
on (group, order), which spreads a group over as many partitions as it needs, written once, and numbered
by partition; only one row per (partition, group) takes part in the prefix sums.

Callers should pass narrow rows (keys and order columns) and join wide payloads on the key afterwards.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featmill.session import materialize

_ID, _PART, _POS, _SALT = "_row_id", "_part", "_pos", "_salt"
_FIRST, _ROWS, _BEFORE, _TOTAL = "_first", "_rows", "_before", "_total"
# monotonically_increasing_id(): partition number above bit 33, row number below.
_POS_BITS = 33

# Shard split ratios, in the order in which the splits take their shards (fixed values).
SPLIT_RATIOS = (("train", 0.8), ("val", 0.05), ("test", 0.15))


def _joined(rows: DataFrame, runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach per-run columns; a run is one group's rows within one range partition."""
    right = runs.select(
        F.col(_PART).alias("_r_part"),
        *[F.col(c).alias(f"_r_{c}") for c in by],
        *[c for c in runs.columns if c != _PART and c not in by],
    )
    match = rows[_PART] == right["_r_part"]
    for c in by:
        match = match & rows[c].eqNullSafe(right[f"_r_{c}"])
    # Without groups there is one run per range partition, so the side is bounded by their number.
    side = right if by else F.broadcast(right)
    return rows.join(side, match).drop("_r_part", *[f"_r_{c}" for c in by])


def number_rows(
    df: DataFrame,
    by: Sequence[str] = (),
    order: Sequence[str] = (),
    *,
    ordinal: str | None = None,
    size: str | None = None,
    group_index: str | None = None,
    global_ordinal: str | None = None,
    running: Mapping[str, str] | None = None,
    ties: bool = False,
) -> DataFrame:
    """Add 0-based positions to ``df``; every output column is optional.

    ``by`` and ``order`` name columns that together should identify a row. Where they do not, set ``ties``:
    rows equal in them take their positions in any order, and are told apart by a salt so that even a great
    many copies spread over partitions. The salt numbers locally sorted rows, so a repeated task gives the
    same ones.

    ordinal: position within the group. size: rows in the group. group_index: position of the group among
    the groups. global_ordinal: position among all rows, groups in order. running: ``{new: value column}``,
    running sum within the group up to and including the row.
    """
    by, order = list(by), list(order)
    running = dict(running or {})
    keys, rows = [*by, *order], df
    if ties:
        rows = df.sortWithinPartitions(*df.columns).withColumn(_SALT, F.monotonically_increasing_id())
        keys.append(_SALT)
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(_SALT) if keys else rows
    staged = materialize(ranged.withColumn(_ID, F.monotonically_increasing_id()), "ordered")
    staged = (
        staged.withColumn(_PART, F.shiftright(_ID, _POS_BITS))
        .withColumn(_POS, F.col(_ID).bitwiseAND(F.lit((1 << _POS_BITS) - 1)))
        .drop(_ID)
    )

    # One row per (partition, group): a group covers at most as many rows here as there are partitions.
    runs = staged.groupBy(_PART, *by).agg(
        F.min(_POS).alias(_FIRST),
        F.count("*").alias(_ROWS),
        *[F.sum(v).alias(f"_sum_{k}") for k, v in running.items()],
    )
    in_group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = in_group.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn(_BEFORE, F.coalesce(F.sum(_ROWS).over(earlier), F.lit(0)))
    if size:
        runs = runs.withColumn(_TOTAL, F.sum(_ROWS).over(in_group))
    for name in running:
        runs = runs.withColumn(f"_prior_{name}", F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)))

    if group_index or global_ordinal:
        # Offsets of whole partitions: one row per range partition, so one task may order them.
        starts = (F.col(_BEFORE) == 0).cast("long")
        ranked = Window.partitionBy(_PART).orderBy(_FIRST)
        runs = runs.withColumn("_group_here", F.sum(starts).over(ranked))
        parts = runs.groupBy(F.col(_PART).alias("_p")).agg(
            F.sum(_ROWS).alias("_p_rows"), F.sum(starts).alias("_p_starts")
        )
        before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select(
            "_p",
            F.coalesce(F.sum("_p_rows").over(before), F.lit(0)).alias("_rows_before"),
            F.coalesce(F.sum("_p_starts").over(before), F.lit(0)).alias("_groups_before"),
        )
        runs = runs.join(F.broadcast(parts), F.col(_PART) == F.col("_p")).drop("_p")

    local = Window.partitionBy(_PART, *by).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    for name, value in running.items():
        staged = staged.withColumn(f"_local_{name}", F.sum(value).over(local))

    out = _joined(staged, runs, by)
    wanted: list[Column] = [F.col(c) for c in df.columns]
    if ordinal:
        wanted.append((F.col(_BEFORE) + F.col(_POS) - F.col(_FIRST)).alias(ordinal))
    if size:
        wanted.append(F.col(_TOTAL).alias(size))
    if group_index:
        wanted.append((F.col("_groups_before") + F.col("_group_here") - 1).alias(group_index))
    if global_ordinal:
        wanted.append((F.col("_rows_before") + F.col(_POS)).alias(global_ordinal))
    for name in running:
        wanted.append((F.col(f"_prior_{name}") + F.col(f"_local_{name}")).alias(name))
    return out.select(*wanted)


def shard_assign(
    df: DataFrame, order: Sequence[str], samples_per_shard: int = 1000, ties: bool = False
) -> DataFrame:
    """Contiguous shards of ``samples_per_shard`` rows in ``order``; the last one may be short."""
    out = number_rows(df, order=order, ordinal="ordinal", ties=ties)
    return out.withColumn("shard_idx", F.expr(f"ordinal div {int(samples_per_shard)}"))


def frame_number(df: DataFrame, episode: str, order: Sequence[str]) -> DataFrame:
    """``episode_idx`` in the dataset and ``frame_idx`` in the episode."""
    return number_rows(df, [episode], order, ordinal="frame_idx", group_index="episode_idx")


def cum_length(df: DataFrame, episode: str) -> DataFrame:
    """One row per episode: its length and the total length of the episodes sorted before it."""
    lengths = df.groupBy(episode).agg(F.count("*").alias("length"))
    total = number_rows(lengths, order=[episode], running={"cum_to": "length"})
    return total.select(episode, "length", (F.col("cum_to").cast("long") - F.col("length")).alias("cum_len"))


def subsample_global(df: DataFrame, video: str, order: Sequence[str], rate: int) -> DataFrame:
    """Every ``rate``-th frame of the videos laid end to end, so the phase carries from one to the next."""
    out = number_rows(df, [video], order, ordinal="frame_idx", global_ordinal="ordinal")
    return out.where(F.col("ordinal") % rate == 0)


def subsample_listed(frames: DataFrame, video: str, ordinal: str, rate: int) -> DataFrame:
    """:func:`subsample_global` where each frame knows its position in its video already.

    Only the videos' lengths are added up, one row each; frames stay where they are. ``frames`` is read twice, once for the
    lengths.
    """
    lengths = frames.groupBy(video).agg(F.count("*").alias("_frames"))
    ends = number_rows(lengths, order=[video], running={"_end": "_frames"})
    begins = ends.select(F.col(video).alias("_video"), (F.col("_end") - F.col("_frames")).alias("_begin"))
    placed = frames.join(begins, F.col(video) == F.col("_video")).drop("_video")
    placed = placed.withColumn("_at", F.col("_begin") + F.col(ordinal)).where(F.col("_at") % rate == 0)
    return placed.withColumnRenamed(ordinal, "frame_idx").drop("_begin", "_at")


def subsample_per_video(df: DataFrame, video: str, order: Sequence[str], rate: int) -> DataFrame:
    """Frames 0, rate, 2*rate, ... of each video."""
    out = number_rows(df, [video], order, ordinal="frame_idx")
    return out.where(F.col("frame_idx") % rate == 0)


def split_assign(shards: DataFrame, dataset: str, shard: str, ratios=SPLIT_RATIOS) -> DataFrame:
    """Give each shard a split by its rank among the dataset's sorted shards.

    Each split takes ``ceil(n * ratio)`` shards in turn until none are left, so a small dataset may
    have no validation or test shards at all. Adds ``shard_rank``, ``n_shards`` and ``split``.
    """
    out = number_rows(shards, [dataset], [shard], ordinal="shard_rank", size="n_shards")
    split: Column | None = None
    upper = F.lit(0).cast("long")
    for name, ratio in ratios:
        upper = upper + F.ceil(F.col("n_shards") * F.lit(float(ratio)))
        inside = F.col("shard_rank") < upper
        split = F.when(inside, name) if split is None else split.when(inside, name)
    return out.withColumn("split", split)


def split_totals(
    shards: DataFrame, dataset: str, shard: str, n_samples: str, samples_per_shard: int = 1000
) -> DataFrame:
    """Samples per split, one row per dataset: full shards count as full, the last by its true count."""
    split = split_assign(shards, dataset, shard)
    counted = F.when(F.col("shard_rank") == F.col("n_shards") - 1, F.col(n_samples)).otherwise(samples_per_shard)
    return split.groupBy(dataset).agg(
        *[
            F.sum(F.when(F.col("split") == name, counted).otherwise(0)).alias(name)
            for name, _ in SPLIT_RATIOS
        ]
    )


def shard_pad(shards: DataFrame, dataset: str, shard: str, parts: int) -> DataFrame:
    """Repeat each dataset's shard list, in order, until its length divides by ``parts``."""
    out = number_rows(shards, [dataset], [shard], ordinal="shard_rank", size="n_shards")
    target = F.ceil(F.col("n_shards") / F.lit(float(parts))) * parts
    copies = F.floor((target - 1 - F.col("shard_rank")) / F.col("n_shards")) + 1
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    return out.withColumn("slot", F.col("copy") * F.col("n_shards") + F.col("shard_rank"))


def shard_repeat(shards: DataFrame, dataset: str, shard: str, world: int, per_rank: int = 8) -> DataFrame:
    """Repeat short shard lists whole until they hold at least ``world * per_rank`` shards."""
    out = number_rows(shards, [dataset], [shard], ordinal="shard_rank", size="n_shards")
    least = world * per_rank
    copies = F.when(
        F.col("n_shards") < least, F.ceil(F.lit(float(least)) / F.col("n_shards"))
    ).otherwise(F.lit(1).cast("long"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    return out.withColumn("slot", F.col("copy") * F.col("n_shards") + F.col("shard_rank"))


def shard_to_worker(shards: DataFrame, dataset: str, shard: str, world: int, workers: int) -> DataFrame:
    """Deal each dataset's sorted shards to nodes in turn, then each node's shards to its workers in turn."""
    out = number_rows(shards, [dataset], [shard], ordinal="shard_rank")
    return out.withColumn("node", F.col("shard_rank") % world).withColumn(
        "worker", F.expr(f"(shard_rank div {int(world)}) % {int(workers)}")
    )


def batch_assign(df: DataFrame, order: Sequence[str], batch_size: int) -> DataFrame:
    """Consecutive batches in ``order``; the last short one is kept."""
    out = number_rows(df, order=order, ordinal="ordinal")
    return out.withColumn("batch_idx", F.expr(f"ordinal div {int(batch_size)}")).withColumn(
        "batch_pos", F.col("ordinal") % batch_size
    )


def segment_stream(df: DataFrame, order: Sequence[str], length: int = 1000) -> DataFrame:
    """Cut an ordered stream into pseudo-episodes of ``length`` samples plus a remainder."""
    out = number_rows(df, order=order, ordinal="ordinal", size="_n")
    out = out.withColumn("segment_idx", F.expr(f"ordinal div {int(length)}"))
    out = out.withColumn("frame_idx", F.col("ordinal") % length)
    return out.withColumn(
        "segment_len", F.least(F.lit(length).cast("long"), F.col("_n") - F.col("segment_idx") * length)
    ).drop("_n")
