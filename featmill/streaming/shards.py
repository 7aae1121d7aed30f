"""Arriving shards as streams: reading, incremental statistics, live meters, incremental extraction."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from featmill.operators.meters import METER, meter_avg
from featmill.operators.stats import channel_stats
from featmill.session import qualified
from featmill.sources.tarshards import register

def stream_shards(
    spark: SparkSession, path: str, schema: StructType, max_files: int | None = None
) -> DataFrame:
    """Parquet shards below ``path`` as a stream; each file is read once, in arrival order."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_archives(
    spark: SparkSession, path: str, log: str, pattern: str = "*.tar", max_shards: int | None = None, members: str = "*"
) -> DataFrame:
    """Tar shards arriving below ``path`` as a stream of members ``(shard, member, offset, size, ordinal, data)``.

    ``log`` is a folder of the query's own, beside its checkpoint; it remembers which shards have been offered
    (:mod:`featmill.sources.tarstream`). Shards appear under their name when complete, so none is picked up half written.
    ``max_shards`` bounds one trigger; the functions below run as many triggers as it takes.
    """
    register(spark)
    return (
        spark.readStream.format("tarshards")
        .option("log", qualified(spark, log))
        .option("pattern", pattern)
        .option("members", members)
        .option("maxShards", max_shards or 0)
        .option("parallelism", spark.sparkContext.defaultParallelism)
        .load(qualified(spark, path))
    )


def _run_through(stream: DataFrame, writer: DataStreamWriter) -> StreamingQuery:
    """Run ``writer``, made of ``stream``, until all that has arrived is through, and stop it.

    Spark's ``availableNow`` goes on to the end for its own sources only; of a source written in Python it takes one trigger's
    share and stops. So where archives are read, triggers follow each other until one finds nothing new.
    """
    leaves = stream._jdf.queryExecution().analyzed().collectLeaves()
    relations = (leaves.apply(k) for k in range(leaves.size()))
    if not any(r.nodeName() == "StreamingRelationV2" and r.sourceName() == "tarshards" for r in relations):
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    query = writer.trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


def drain_archives(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all that has arrived of ``(shard, member, data)`` as tar shards below ``path`` and stop.

    A trigger's shards carry its number, ``<shard>-<trigger>.tar``, and appear when the trigger is committed; one that is repeated
    leaves no second copy. Members come in the order in which they arrive.
    """
    spark = stream.sparkSession
    register(spark)
    none = F.lit(None).cast("bigint")
    rows = stream.select("shard", "member", none.alias("offset"), none.alias("size"), none.alias("ordinal"), "data")
    writer = (
        rows.repartition("shard")
        .writeStream.format("tarshards")
        .option("path", qualified(spark, path))
        .option("checkpointLocation", checkpoint)
    )
    return _run_through(stream, writer)


def stream_channel_stats(shards: DataFrame, tensor: str, c: int, n_tokens: int, by: Sequence[str] = ()) -> DataFrame:
    """Channel statistics kept up to date; state is one row per channel."""
    return channel_stats(shards, tensor, c, n_tokens, by)


def stream_meters(updates: DataFrame, by: Sequence[str] = METER) -> DataFrame:
    """Live meters; state is one row per meter."""
    return meter_avg(updates, by)


def drain(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all that has arrived to a Parquet folder and stop."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return _run_through(stream, writer)


# Versions of a table that are kept.
KEPT = 2


def drain_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the complete result of a streaming aggregation as a Parquet table, replaced at every trigger.

    Each trigger writes its own folder ``v=<batch>``; :func:`latest` reads the newest. A repeated trigger
    overwrites its own folder only. The newest two versions are kept.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={batch_id}")
        # A reader may still be at the version before; older ones go.
        hadoop = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/v={batch_id - KEPT}")
        hadoop.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)

    writer = stream.writeStream.outputMode("complete").foreachBatch(publish).option("checkpointLocation", checkpoint)
    return _run_through(stream, writer)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table kept by :func:`drain_table`."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("v")).scalar()
    return versions.where(F.col("v") == newest).drop("v")


def stream_extract(
    shards: DataFrame,
    extract: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    partition: str = "shard_idx",
) -> StreamingQuery:
    """Extract features of what has arrived since the last run, partitioned by shard below ``path``.

    The checkpoint remembers which files are done. Each trigger owns the folder ``batch_id=<n>``, so one that
    is repeated after a crash replaces its own output and nothing else, and a shard that arrives over several
    triggers keeps all its rows.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        extract(batch).write.mode("overwrite").partitionBy(partition).parquet(f"{path}/batch_id={batch_id}")

    return _run_through(shards, shards.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint))
