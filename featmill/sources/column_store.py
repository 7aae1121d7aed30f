"""Column-separated datasets as Parquet: one table per column, each with its own rows per sample.

Layout: ``<root>/<column>/dataset=.../split=.../*.parquet``, rows clustered by ``shard_idx``. A reader
opens the columns, datasets and splits it needs; a shard range is pruned by the row-group statistics.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Columns every column table has besides its payload.
SAMPLE = ("dataset", "split", "shard_idx", "key")


def write_column(df: DataFrame, root: str, column: str) -> None:
    """Add the shards of samples ``(dataset, split, shard_idx, key, ...)`` that a column does not have yet.

    Shards are written whole, so a repeated call leaves the column as it is. Rows are range-partitioned by shard, so a
    large dataset spreads over as many files as it needs.
    """
    spark, shard = df.sparkSession, ["dataset", "split", "shard_idx"]
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{column}")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        df = df.join(done_shards(read_column(spark, root, column)).select(*shard), shard, "left_anti").select(*df.columns)
    (
        df.repartitionByRange("dataset", "split", "shard_idx")
        .sortWithinPartitions("dataset", "split", "shard_idx", "key")
        .write.mode("append")
        .partitionBy("dataset", "split")
        .parquet(f"{root}/{column}")
    )


def read_column(
    spark: SparkSession,
    root: str,
    column: str,
    dataset: str | None = None,
    split: str | None = None,
    shards: tuple[int, int] | None = None,
) -> DataFrame:
    """Samples of a column, optionally of one dataset, one split, or shards ``first <= i < end``."""
    path = f"{root}/{column}"
    df = spark.read.parquet(path)
    kinds = dict(df.dtypes)
    if (kinds["dataset"], kinds["split"]) != ("string", "string"):
        # Folder names that look like numbers are names all the same.
        fields = [StructField(f.name, StringType()) if f.name in ("dataset", "split") else f for f in df.schema]
        df = spark.read.schema(StructType(fields)).parquet(path)
    if dataset is not None:
        df = df.where(F.col("dataset") == dataset)
    if split is not None:
        df = df.where(F.col("split") == split)
    if shards is not None:
        df = df.where((F.col("shard_idx") >= shards[0]) & (F.col("shard_idx") < shards[1]))
    return df


def done_shards(column: DataFrame) -> DataFrame:
    """Shards a column holds, with their sample counts; touches no payload."""
    return column.groupBy("dataset", "split", "shard_idx").agg(F.count("*").alias("n"))


def write_bucketed(df: DataFrame, table: str, path: str, keys: list[str], buckets: int) -> None:
    """Store a column as a table bucketed and sorted by its sample key.

    Columns bucketed alike join on the key without moving a row, which matters when each holds terabytes.
    """
    (
        df.repartition(buckets, *keys)
        .write.mode("overwrite")
        .option("path", path)
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .saveAsTable(table)
    )


# What the columns of a bucketed store are dealt out by, all of them alike.
BUCKET_KEYS = ("dataset", "key")


def write_buckets(df: DataFrame, root: str, column: str, buckets: int) -> None:
    """Store a column of samples in ``buckets`` buckets by (dataset, key), below ``<root>/<column>.b<buckets>``.

    Columns of one number of buckets join without moving a payload; :func:`read_buckets` knows the number from the name.
    """
    path = f"{root}/{column}.b{buckets}"
    write_bucketed(df, _table_name(path), path, list(BUCKET_KEYS), buckets)


def _table_name(path: str) -> str:
    return f"featmill_{hashlib.md5(path.encode()).hexdigest()}"


def read_buckets(spark: SparkSession, root: str, column: str) -> DataFrame | None:
    """A column stored by :func:`write_buckets`, by this session or another; None where there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{column}.b*"))
    names = sorted(status.getPath().getName() for status in found or [])
    names = [n for n in names if n.removeprefix(f"{column}.b").isdigit()]
    if not names:
        return None
    if len(names) > 1:
        raise ValueError(f"{column} is stored in several numbers of buckets: {names}")
    path, buckets = f"{root}/{names[0]}", int(names[0].removeprefix(f"{column}.b"))
    table = _table_name(path)
    if not spark.catalog.tableExists(table):
        # The files carry their bucket in their names; the session only has to be told that they do.
        schema = spark.read.parquet(path).schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        keys = ", ".join(BUCKET_KEYS)
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS"
            f" LOCATION '{path}'"
        )
    return spark.table(table)


def open_column(spark: SparkSession, root: str, column: str, split: str | None = None) -> DataFrame:
    """A column, bucketed where it is stored so, of one split if it is named."""
    found = read_buckets(spark, root, column)
    if found is None:
        return read_column(spark, root, column, split=split)
    return found if split is None else found.where(F.col("split") == split)
