"""Average meters: sums and counts of reported values, merged or running."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmill.operators.ordinals import number_rows

METER = ("mode", "model", "loss")


def _average() -> Column:
    return F.col("sum") / F.when(F.col("count") != 0, F.col("count"))


def meter_name(mode: Column, loss: Column, model: Column | None = None) -> Column:
    """``{mode}[_{model}]_{loss}_loss``"""
    parts = [mode, loss] if model is None else [mode, model, loss]
    return F.concat(F.concat_ws("_", *parts), F.lit("_loss"))


def meter_avg(updates: DataFrame, by: Sequence[str] = METER) -> DataFrame:
    """``(by..., sum, count, avg)`` of updates ``(val, n)``, where ``val`` is a mean over ``n`` samples.

    Here and below, the average over no samples is null.
    """
    sums = updates.groupBy(*by).agg(F.sum(F.col("val") * F.col("n")).alias("sum"), F.sum("n").alias("count"))
    return sums.withColumn("avg", _average())


def meter_summary(meters: DataFrame, kind: str) -> DataFrame:
    """The one figure a meter reports: ``average``, ``sum`` or ``count``, as ``value``; ``none`` reports nothing."""
    columns = {"average": "avg", "sum": "sum", "count": "count"}
    if kind == "none":
        return meters.withColumn("value", F.lit(None).cast("double"))
    if kind not in columns:
        raise ValueError(f"invalid summary kind {kind!r}")
    return meters.withColumn("value", F.col(columns[kind]).cast("double"))


def meter_merge(meters: DataFrame, by: Sequence[str] = METER) -> DataFrame:
    """Merge workers' meters: sum of sums over sum of counts."""
    sums = meters.groupBy(*by).agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"))
    return sums.withColumn("avg", _average())


def meter_running(updates: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The running average after every update. One busy meter spreads over many tasks."""
    weighted = updates.withColumn("_weighted", F.col("val") * F.col("n"))
    out = number_rows(weighted, by, order, running={"sum": "_weighted", "count": "n"})
    return out.drop("_weighted").withColumn("avg", _average())
