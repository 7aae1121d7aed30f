"""Distillation losses between predicted and stored features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmill.functions.tensors import L2_FLOOR, unroll

LOSSES = ("mse", "cos", "l1")
# Shares of the cosine and the smooth-L1 loss in the combined main loss (fixed values).
COS_SHARE, L1_SHARE = 0.9, 0.1


def pred_target_join(pred: DataFrame, target: DataFrame, keys: Sequence[str] = ("key", "model")) -> DataFrame:
    """Pair ``pred`` and ``target`` tensors of the same sample and model."""
    return pred.select(*keys, F.col("embedding").alias("pred")).join(
        target.select(*keys, F.col("embedding").alias("target")), list(keys)
    )


def smooth_l1(diff: Column) -> Column:
    """Quadratic below 1, linear above."""
    size = F.abs(diff)
    return F.when(size < 1, diff * diff * 0.5).otherwise(size - 0.5)


def sample_losses(pairs: DataFrame, keys: Sequence[str] = ("key", "model")) -> DataFrame:
    """Per sample: element count, squared and smooth-L1 sums, and ``1 - cosine`` of the flat tensors.

    The tensors are exploded and reduced in one generated loop; what is shuffled is one row per sample. A pair of
    which one is null, or of another size than the other, ends the job.
    """
    same = F.coalesce(F.size("pred") == F.size("target"), F.lit(False)) & F.col("pred").isNotNull()
    wrong = F.raise_error(F.concat(F.lit("prediction and target differ in size: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])))
    pairs = pairs.withColumn("pred", F.when(same, F.col("pred")).otherwise(wrong))
    long = unroll(pairs, [*keys, "target"], "pred", "_i", "_p")
    p = F.col("_p").cast("double")
    t = F.expr("target[_i]").cast("double")
    long = long.select(*keys, p.alias("p"), t.alias("t"))
    diff = F.col("p") - F.col("t")
    sums = long.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(diff * diff).alias("se"),
        F.sum(smooth_l1(diff)).alias("l1"),
        F.sum(F.col("p") * F.col("t")).alias("_pt"),
        F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("_np"),
        F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("_nt"),
    )
    floor = F.lit(L2_FLOOR)
    cosine = F.col("_pt") / (F.greatest("_np", floor) * F.greatest("_nt", floor))
    return sums.withColumn("cos", 1 - cosine).drop("_pt", "_np", "_nt")


def model_losses(samples: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """``(by..., mse, cos, l1)`` from per-sample sums: element means, and the sample mean of the cosine loss."""
    return samples.groupBy(*by).agg(
        (F.sum("se") / F.sum("n")).alias("mse"),
        F.avg("cos").alias("cos"),
        (F.sum("l1") / F.sum("n")).alias("l1"),
    )


def distill_losses(per_model: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Combined ``(mse, cos, l1)`` over all models, one row.

    ``mse`` and ``l1`` use the given weight per model, else equal shares; ``cos`` always uses equal shares. Where
    weights are given, a model without one ends the job.
    """
    if weights:
        pairs = [F.lit(x) for item in weights.items() for x in (item[0], float(item[1]))]
        unknown = F.raise_error(F.concat(F.lit("no weight for model "), F.coalesce("model", F.lit("null"))))
        weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("model")), unknown.cast("double"))
        mse, l1 = F.sum(F.col("mse") * weight), F.sum(F.col("l1") * weight)
    else:
        mse, l1 = F.avg("mse"), F.avg("l1")
    return per_model.agg(mse.alias("mse"), F.avg("cos").alias("cos"), l1.alias("l1"))


def main_loss(mode: str | None, mse: Column, cos: Column, l1: Column) -> Column:
    """The loss a run optimises: ``mse`` (or None), or ``cos_l1``."""
    if mode is None or mode == "mse":
        return mse
    if mode == "cos_l1":
        return COS_SHARE * cos + L1_SHARE * l1
    raise ValueError(f"unknown main loss {mode!r}")
