"""Shapes of physical plans that decide whether an operator scales."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from featmill.functions import tensors as t
from featmill.operators import ordinals, stats
from featmill.operators import quality as q
from featmill.session import scratch_root
from featmill.sources import tarshards as ts


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_statistics_read_one_column_and_reduce_before_the_shuffle(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    plan = executed(stats.channel_stats(df, "embedding", 4, 16))
    assert "ReadSchema: struct<embedding:array<float>>" in plan
    assert plan.index("Exchange hashpartitioning(channel") < plan.index("partial_stddev_samp")


def test_a_computed_tensor_is_computed_once(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    tokens = df.withColumn("embedding", t.chw_to_tokens("embedding", 4, 4, 4))
    plan = executed(stats.channel_stats(tokens, "embedding", 4, 16, tokens_first=True))
    assert plan.count("[0,16,32,48,") == 1


def test_split_filters_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id") >= 50).select("doc_id")
    plan = executed(df)
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,50)]" in plan
    assert "ReadSchema: struct<doc_id:bigint>" in plan


def test_work_on_files_is_dealt_out_explicitly(spark, tmp_path):
    """Rows that name files are tiny; adaptive execution would put them all in one task."""
    files = spark.createDataFrame([("s", "file:/x")], "shard string, path string")
    members = spark.createDataFrame([], "shard string, member string, offset bigint, size bigint")
    for df in (
        q.shard_integrity(files),
        ts.list_members(files),
        ts.fetch_members(members, str(tmp_path)),
        ts.fetch_members(ts.arrange(members), str(tmp_path), arranged=True),
    ):
        plan = executed(df)
        assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("Exchange") == 1


def test_arranged_rows_are_not_joined_again(spark):
    rows = spark.createDataFrame([("s", "m", bytearray(b"x"))], "shard string, member string, data binary")
    with pytest.raises(ValueError):
        ts.write_shards(rows, "/nowhere", existing=rows.withColumn("ok", F.lit(True)), arranged=True)


class Session:
    """Stands for a session whose settings a test chooses."""

    def __init__(self, master, setting=None):
        self.master, self.setting, self.folder = master, setting, None
        self.conf = self.sparkContext = self

    def getConf(self):
        return self

    def get(self, name, default=None):
        return self.setting if name == "spark.checkpoint.dir" else default

    def setCheckpointDir(self, folder):
        self.folder = folder

    def getCheckpointDir(self):
        return self.folder


def test_scratch_follows_the_cluster_setting(spark):
    assert scratch_root(Session("yarn", "hdfs://name/shared/")) == "hdfs://name/shared"
    with pytest.raises(RuntimeError):
        scratch_root(Session("yarn"))
    local = Session("local[2]")
    assert scratch_root(local) == scratch_root(local) == local.folder


def test_intermediate_tables_are_written_below_it(spark):
    out = ordinals.number_rows(spark.range(10), order=["id"], ordinal="i")
    assert all(scratch_root(spark).removeprefix("file:") in f for f in out.inputFiles()) and out.count() == 10


def test_scratch_belongs_to_the_application(spark):
    from featmill.session import scratch_path

    one, two = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert one != two and all(f"featmill-{spark.sparkContext.applicationId}/x-" in p for p in (one, two))
