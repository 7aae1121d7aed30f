"""Registration of queries and the fixtures they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featmill.functions.tensors import unroll
from featmill.operators.ordinals import number_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Embeddings stand for features of 4 channels on a 4 by 4 grid.
C, H, W = 4, 4, 4
TOKENS, SIZE = H * W, C * H * W
# Models an embedding's label is mapped to, in the order of the model table.
MODEL_SQL = """(VALUES (0,'facebook/dinov2-large'),(1,'facebook/sam-vit-huge'),
(2,'google/vit-huge-patch14-224-in21k'),(3,'llava-hf/llava-1.5-7b-hf'),(4,'openai/clip-vit-large-patch14'),
(5,'LiheYoung/depth-anything-large-hf')) m(pos, model)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and the SQL that computes the same on the same tables."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(value: Column | str) -> Column:
    """Six decimals, without negative zero."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double"), 6) + F.lit(0.0)


def big(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("bigint")


def long_form(df: DataFrame, keys: list[str], tensor: Column, exact: bool = True) -> DataFrame:
    """``(keys..., pos, value)``, one row per element."""
    rows = unroll(df, keys, tensor)
    value = F.col("value").cast("double") if exact else r6("value")
    return rows.select(*keys, big("pos").alias("pos"), value.alias("value"))


def doc_samples(spark: SparkSession, sf: str, per_shard: int = 5) -> DataFrame:
    """Documents as samples of the dataset ``source``: ``(dataset, key, member, doc_id, shard_idx, shard)``."""
    docs = table(spark, sf, "documents").select(F.col("source").alias("dataset"), "doc_id", "lang")
    placed = number_rows(docs, ["dataset"], ["doc_id"], ordinal="_o")
    return (
        placed.withColumn("shard_idx", F.expr(f"_o div {per_shard}"))
        .withColumn("key", F.lpad(F.col("doc_id").cast("string"), 8, "0"))
        .withColumn("member", F.concat_ws(".", "key", "lang", F.lit("text")))
        .withColumn("shard", F.format_string("%s-%06d.tar", "dataset", "shard_idx"))
        .drop("_o")
    )


def doc_shards(spark: SparkSession, sf: str, per_shard: int = 5) -> DataFrame:
    """One row per document shard with its sample count."""
    return doc_samples(spark, sf, per_shard).groupBy("dataset", "shard", "shard_idx").agg(
        F.count("*").alias("n_samples")
    )


DOC_SAMPLES_SQL = """samples AS (
  SELECT source AS dataset, doc_id, lang, lpad(doc_id::VARCHAR, 8, '0') AS key,
         lpad(doc_id::VARCHAR, 8, '0') || '.' || lang || '.text' AS member,
         ((row_number() OVER (PARTITION BY source ORDER BY doc_id)) - 1) // 5 AS shard_idx
  FROM documents),
shards AS (
  SELECT dataset, shard_idx, printf('%s-%06d.tar', dataset, shard_idx) AS shard, count(*) AS n_samples
  FROM samples GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY shard) - 1 AS shard_rank,
         count(*) OVER (PARTITION BY dataset) AS n_shards FROM shards),
split_shards AS (
  SELECT *, CASE WHEN shard_rank < ceil(n_shards * 0.8::DOUBLE) THEN 'train'
    WHEN shard_rank < ceil(n_shards * 0.8::DOUBLE) + ceil(n_shards * 0.05::DOUBLE) THEN 'val'
    WHEN shard_rank < ceil(n_shards * 0.8::DOUBLE) + ceil(n_shards * 0.05::DOUBLE)
                      + ceil(n_shards * 0.15::DOUBLE) THEN 'test' END AS split
  FROM ranked),
split_sizes AS (
  SELECT dataset, split, CASE WHEN shard_rank = n_shards - 1 THEN n_samples ELSE 5 END AS n FROM split_shards)"""
