"""Plan tables: registry, mixes, weights, work lists.

These are small tables about datasets, never about samples; joins against them go through
:func:`featmill.session.materialize` or Spark's own size check.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featmill.functions.naming import OWN_VIEW, is_packed_model, model_name_legit, shard_name, view_select
from featmill.plans.registry import MODEL_SIZES, registry_rows, resolve_mix

_REGISTRY_SCHEMA = pa.schema(
    [
        ("dataset", pa.string()),
        ("kind", pa.string()),
        ("versions", pa.list_(pa.string())),
        ("episodes", pa.int64()),
        ("steps", pa.int64()),
        ("views", pa.list_(pa.string())),
    ]
)


def _literal(spark: SparkSession, rows: Sequence[tuple], schema: pa.Schema) -> DataFrame:
    """A table known at plan time, with its true size for join planning."""
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return spark.createDataFrame(
        pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    )


def last_wins(registries: Sequence[DataFrame], key: str = "dataset") -> DataFrame:
    """Union of registries; of entries with the same name the one of the latest registry stays."""
    union = None
    for i, registry in enumerate(registries):
        tagged = registry.withColumn("_rank", F.lit(i))
        union = tagged if union is None else union.unionByName(tagged)
    columns = [c for c in union.columns if c not in (key, "_rank")]
    latest = union.groupBy(key).agg(F.max_by(F.struct(*columns), "_rank").alias("_e"))
    return latest.select(key, *[F.col(f"_e.{c}").alias(c) for c in columns])


def dataset_registry(spark: SparkSession, *later: DataFrame) -> DataFrame:
    """All known datasets: ``(dataset, kind, versions, episodes, steps, views)``.

    ``later`` registries of the same shape add entries or replace those of the same name.
    """
    known = _literal(spark, registry_rows(), _REGISTRY_SCHEMA)
    return last_wins([known, *later]) if later else known


def model_table(spark: SparkSession) -> DataFrame:
    """``(pos, model, c, w, h)`` of the known models."""
    rows = [(i, name, *size) for i, (name, size) in enumerate(MODEL_SIZES.items())]
    schema = pa.schema(
        [("pos", pa.int32()), ("model", pa.string()), ("c", pa.int32()), ("w", pa.int32()), ("h", pa.int32())]
    )
    return _literal(spark, rows, schema)


def mix_entries(spark: SparkSession, mix: str | Mapping[str, float] | Sequence[str]) -> DataFrame:
    """``(pos, dataset, weight)`` of a mix as written, duplicates included."""
    rows = [(i, name, weight) for i, (name, weight) in enumerate(resolve_mix(mix))]
    schema = pa.schema([("pos", pa.int32()), ("dataset", pa.string()), ("weight", pa.float64())])
    return _literal(spark, rows, schema)


def mix_concat(entries: DataFrame) -> DataFrame:
    """One entry per dataset: its first position and its last weight."""
    return entries.groupBy("dataset").agg(
        F.min("pos").alias("pos"), F.max_by("weight", "pos").alias("weight")
    )


def mix_unknown(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """Mix entries the registry does not know."""
    return entries.join(registry.select("dataset"), "dataset", "left_anti")


def nonempty_split(splits: DataFrame, split: str) -> DataFrame:
    """``(dataset, n)`` of the datasets that have samples in a split."""
    return splits.where((F.col("split") == split) & (F.col("n") > 0)).select("dataset", "n")


def mix_plan(
    mix: DataFrame, registry: DataFrame, splits: DataFrame, split: str, views: str | list | None = None
) -> DataFrame:
    """``(dataset, view, pos, weight, n)``: mix, camera views and split lengths of the datasets to read.

    Datasets empty in the split drop out; validation counts every dataset with weight 1. Every view of a
    dataset is an entry of its own. A dataset the registry does not know is an error, found right away.
    """
    unknown = [row["dataset"] for row in mix_unknown(mix, registry).collect()]
    if unknown:
        raise ValueError(f"unknown datasets in the mix: {sorted(unknown)}")
    selected = F.when(F.size("views") == 0, F.array(F.lit(OWN_VIEW))).otherwise(view_select(F.col("views"), views))
    weight = F.lit(1.0) if split in ("val", "eval") else F.col("weight")
    # The evaluation split is stored as validation.
    stored = "val" if split == "eval" else split
    return (
        mix.join(registry.select("dataset", "views"), "dataset")
        .join(nonempty_split(splits, stored), "dataset")
        .select("dataset", F.explode(selected).alias("view"), "pos", weight.alias("weight"), "n")
    )


def expected_length(n: Column, ratio: float = 1.0) -> Column:
    """Samples a dataset counts for: ``ceil(n * ratio)``. The ratio scales lengths, it does not drop rows."""
    return F.ceil(n * F.lit(float(ratio)))


def mix_weights(plan: DataFrame, ratio: float = 1.0) -> DataFrame:
    """Add ``weight`` normalised by length, ``w * len / sum(w * len)``, and the sum as ``expected``.

    Fails when all lengths are 0.
    """
    share = F.col("weight") * expected_length(F.col("n"), ratio)
    summed = plan.withColumn("_total", plan.agg(F.sum(share)).scalar())
    total = F.col("_total")
    checked = F.when(total == 0, F.raise_error(F.lit("sum of dataset lengths is 0")).cast("double")).otherwise(total)
    return summed.withColumn("expected", checked).withColumn("weight", share / F.col("expected")).drop("_total")


def target_models(spark: SparkSession) -> DataFrame:
    """Models whose features are read: all but the unsupported one."""
    return model_table(spark).where(is_packed_model(F.col("model")))


def extraction_worklist(
    registry: DataFrame, models: DataFrame, shards: DataFrame, split: str = "train"
) -> DataFrame:
    """Every (dataset, view, model, shard) to extract.

    ``shards`` is ``(dataset, n_shards)``. Views and shards are exploded per dataset, and the handful of
    models is an array on each row, so no table is multiplied by another through a join.
    """
    names = models.agg(F.collect_list("model").alias("models"))
    views = F.when(F.size("views") == 0, F.array(F.lit(OWN_VIEW))).otherwise(F.col("views"))
    indexes = F.sequence(F.lit(0).cast("long"), F.col("n_shards") - 1)
    return (
        shards.where(F.col("n_shards") > 0)
        .join(registry.select("dataset", "kind", "views"), "dataset")
        .select("dataset", "kind", F.explode(views).alias("view"), "n_shards")
        .withColumn("model", F.explode(names.scalar()))
        .withColumn("shard_idx", F.explode(indexes))
        .select(
            "dataset",
            "view",
            model_name_legit(F.col("model")).alias("column"),
            "shard_idx",
            shard_name(
                F.col("dataset"), F.col("view"), F.lit(split), F.col("shard_idx"), F.col("kind") == "robot"
            ).alias("shard"),
        )
    )
