"""Checks of shards, keys and stored features."""

from __future__ import annotations

import tarfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featmill.functions.naming import member_column, sample_key
from featmill.sources.tarshards import _filesystem, count_members, shard_of, spread_files


def list_shard_files(spark: SparkSession, path: str, pattern: str = "*.tar") -> DataFrame:
    """``(shard, path, length, modified)`` of the shard files below ``path``; their content is not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select(shard_of(spark, path).alias("shard"), "path", "length", F.unix_micros("modificationTime").alias("modified"))
    )


def shard_integrity(files: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """``(shard, ok, n, error)``: walk every archive to its end.

    A broken archive is a row with ``ok`` false, never a failed job. Shards of ``planned`` that have no file,
    or an empty one (which the listing leaves out), are reported as missing. Only headers are read; one task
    walks a file, and the files are dealt out evenly.
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for shard, path in zip(batch["shard"], batch["path"], strict=True):
                members, error = 0, None
                try:
                    handles, local = _filesystem(path)
                    with handles.open_input_file(local) as handle:
                        members = count_members(handle)
                except (tarfile.TarError, OSError) as problem:
                    error = f"{type(problem).__name__}: {problem}"
                rows.append((shard, error is None, members, error))
            yield pd.DataFrame(rows, columns=["shard", "ok", "n", "error"])

    checked = spread_files(files, "shard", "path").mapInPandas(check, "shard string, ok boolean, n bigint, error string")
    if planned is None:
        return checked
    return planned.select("shard").join(checked, "shard", "left").select(
        "shard",
        F.coalesce("ok", F.lit(False)).alias("ok"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.when(F.col("ok").isNull(), "missing").otherwise(F.col("error")).alias("error"),
    )


def shard_key_counts(members: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per shard, how many members carry each of ``names``: ``(shard, column, n)``."""
    counts = members.groupBy("shard").agg(
        *[F.sum(F.contains(F.col("member"), F.lit(name)).cast("long")).alias(name) for name in names]
    )
    return counts.unpivot("shard", list(names), "column", "n")


def count_steps(members: DataFrame) -> DataFrame:
    """Distinct samples per shard, ``(shard, n)``. Deduplicated by (shard, key) before counting."""
    keys = members.select("shard", sample_key(F.col("member")).alias("key")).distinct()
    return keys.groupBy("shard").agg(F.count("*").alias("n"))


def column_coverage(members: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Members of each column per shard and whether all columns have as many."""
    wide = (
        members.withColumn("_column", member_column(F.col("member")))
        .groupBy("shard")
        .pivot("_column", list(columns))
        .count()
        .na.fill(0)
    )
    first = F.col(f"`{columns[0]}`")
    complete = F.lit(True)
    for name in columns[1:]:
        complete = complete & (F.col(f"`{name}`") == first)
    return wide.withColumn("complete", complete)


def nth_member(members: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Members at the given 0-based positions of each shard's name order, as ``pos``.

    Listings know the positions (``ordinal``): nothing is shuffled or written.
    """
    return members.where(F.col("ordinal").isin([int(p) for p in positions])).withColumnRenamed("ordinal", "pos")


def feature_diff(stored: DataFrame, again: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``(by..., total, largest, missing, missized, equal)`` of stored and recomputed ``embedding`` tensors.

    ``total`` and ``largest`` are sum and maximum of the differences of whole tensors; ``missing`` counts samples that
    one side lacks or has as null, ``missized`` those whose sizes differ. All must be 0 for ``equal``. ``again`` needs
    the columns of ``by`` for samples that are not stored to be counted in their group; those it lacks are null there.
    """
    columns = list(dict.fromkeys([*by, *keys]))
    only = [c for c in columns if c not in keys and c in again.columns]
    left = stored.select(*columns, F.col("embedding").alias("_a"))
    right = again.select(*keys, *[F.col(c).alias(f"_again_{c}") for c in only], F.col("embedding").alias("_b"))
    pairs = left.join(right, list(keys), "full_outer")
    pairs = pairs.withColumns({c: F.coalesce(c, f"_again_{c}") for c in only})
    lacking = F.col("_a").isNull() | F.col("_b").isNull()
    other = ~lacking & (F.size("_a") != F.size("_b"))
    # A sample that cannot be compared has one row without a difference.
    compared = F.when(~lacking & ~other, F.col("_a"))
    pairs = pairs.select(*by, lacking.alias("_lacking"), other.alias("_other"), "_b", compared.alias("_a"))
    long = pairs.select(*by, "_lacking", "_other", "_b", F.posexplode_outer("_a").alias("_i", "_x"))
    gap = F.abs(F.col("_x").cast("double") - F.expr("_b[_i]").cast("double"))
    return (
        long.select(*by, "_lacking", "_other", gap.alias("_gap"))
        .groupBy(*by)
        .agg(
            F.coalesce(F.sum("_gap"), F.lit(0.0)).alias("total"),
            F.coalesce(F.max("_gap"), F.lit(0.0)).alias("largest"),
            F.count(F.when(F.col("_lacking"), 1)).alias("missing"),
            F.count(F.when(F.col("_other"), 1)).alias("missized"),
        )
        .withColumn("equal", (F.col("largest") == 0) & (F.col("missing") == 0) & (F.col("missized") == 0))
    )


def failing_models(diff: DataFrame) -> DataFrame:
    """Models with at least one shard that differs."""
    return diff.groupBy("model").agg(F.bool_and("equal").alias("passed")).where(~F.col("passed")).select("model")
