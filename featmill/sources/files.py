"""Image folders, split catalogs and the feature-statistics store."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featmill.functions.naming import model_name_legit, path_key
from featmill.session import qualified
from featmill.sources.tarshards import _filesystem
from featmill.sources.tensor_bytes import decode_vector

SPLITS = ("train", "val", "test")


def read_image_folder(spark: SparkSession, path: str, pattern: str = "*.JPEG", content: bool = True) -> DataFrame:
    """``key``, ``path`` and, if asked for, ``content`` of every matching file below ``path``.

    Without content only the listing is read. Samples are numbered in the order of ``path``.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    return files.select(path_key(F.col("path")).alias("key"), "path", *(["content"] if content else []))


def read_splits(spark: SparkSession, root: str) -> DataFrame:
    """``(dataset, split, n)`` from the ``splits.json`` of every dataset folder below ``root``."""
    counts = spark.read.schema("train bigint, val bigint, test bigint").option("multiLine", "true")
    wide = counts.json(f"{root}/*/splits.json").select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("dataset"), *SPLITS
    )
    return splits_long(wide)


def splits_long(wide: DataFrame) -> DataFrame:
    """``(dataset, train, val, test)`` to ``(dataset, split, n)``."""
    return wide.unpivot("dataset", list(SPLITS), "split", "n")


def write_splits(wide: DataFrame, root: str) -> None:
    """Write one ``splits.json`` per dataset folder from ``(dataset, train, val, test)`` rows."""

    root = qualified(wide.sparkSession, root)

    def write(rows):
        for row in rows:
            files, base = _filesystem(root)
            folder = f"{base.rstrip('/')}/{row['dataset']}"
            files.create_dir(folder, recursive=True)
            with files.open_output_stream(f"{folder}/splits.json") as out:
                out.write(json.dumps({s: row[s] for s in SPLITS}, indent=4).encode())

    wide.select("dataset", *SPLITS).foreachPartition(write)


def write_stats(stats: DataFrame, path: str) -> None:
    """Store ``(model, channel, n, mean, std)``; statistics of other models already stored stay."""
    (
        stats.select(model_name_legit(F.col("model")).alias("model"), "channel", "n", "mean", "std")
        .repartition("model")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model")
        .parquet(path)
    )


def read_stats(spark: SparkSession, path: str, models: list[str] | None = None) -> DataFrame:
    """Stored statistics, optionally of some models only; other models' files are not opened."""
    schema = "channel int, n bigint, mean double, std double, model string"
    stats = spark.read.schema(schema).parquet(path).select("model", "channel", "n", "mean", "std")
    if models is not None:
        stats = stats.where(F.col("model").isin([m.replace("/", "_").lower() for m in models]))
    return stats


def read_npy_stats(spark: SparkSession, root: str) -> DataFrame:
    """``(model, channel, mean, std)`` from ``*_mean_{model}.npy`` and ``*_var_{model}.npy`` files.

    The files called "var" hold standard deviations. A model lacking one of the two is left out.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.npy")
        .load(root)
        .select(
            F.regexp_extract("path", r"_(mean|var)_([^/]+)\.npy$", 1).alias("kind"),
            F.lower(F.regexp_extract("path", r"_(mean|var)_([^/]+)\.npy$", 2)).alias("model"),
            decode_vector("content").alias("values"),
        )
    )
    long = files.select("model", "kind", F.posexplode("values").alias("channel", "value"))
    return (
        long.groupBy("model", "channel")
        .pivot("kind", ["mean", "var"])
        .agg(F.first("value"))
        .withColumnRenamed("var", "std")
        .where("mean is not null and std is not null")
    )
