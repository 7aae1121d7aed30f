"""Positions against brute force, also where one group holds most rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from featmill.operators import ordinals as o


def frames(spark, sizes):
    rows = [(video, f"{i:04d}", float(i % 7)) for video, n in sizes.items() for i in range(n)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "video string, name string, value double").repartition(5)


SIZES = {"a": 1, "b": 2000, "c": 40, "d": 500, "e": 0, "f": 1000}


def test_number_rows_with_a_hot_group(spark):
    df = frames(spark, SIZES)
    out = o.number_rows(
        df, ["video"], ["name"], ordinal="i", size="n", group_index="g", global_ordinal="all", running={"run": "value"}
    ).collect()
    assert len(out) == sum(SIZES.values())
    starts, at = {}, 0
    for g, (video, n) in enumerate((v, n) for v, n in sorted(SIZES.items()) if n):
        starts[video] = (g, at, n)
        at += n
    for row in out:
        g, start, n = starts[row["video"]]
        i = int(row["name"])
        assert (row["i"], row["n"], row["g"], row["all"]) == (i, n, g, start + i)
        assert row["run"] == pytest.approx(sum(j % 7 for j in range(i + 1)))


def test_a_hot_group_spreads_over_partitions(spark):
    """Two thirds of the rows are one group, yet no range partition holds more than a share of them."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"),
        "id",
    )
    placed = df.repartitionByRange("g", "id").withColumn("p", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        largest = placed.groupBy("p").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert largest < 30_000 / 3


def test_copies_spread_and_are_counted_once(spark):
    """Every row alike in group and order, four fifths of them complete copies."""
    df = spark.range(20_000).select(F.lit("g").alias("g"), F.lit(1).alias("k"), F.greatest("id", F.lit(16_000)).alias("v"))
    df = df.withColumn("one", F.lit(1)).repartition(6)
    # Adaptive execution would merge partitions as small as these.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = o.number_rows(df, ["g"], ["k"], ordinal="i", running={"run": "one"}, ties=True)
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(r["i"] for r in rows) == list(range(20_000))
    assert all(r["run"] == r["i"] + 1 for r in rows)
    assert sum(r["v"] == 16_000 for r in rows) == 16_001
    # One file per range partition; none holds the bulk of the rows.
    sizes = [spark.read.parquet(f).count() for f in out.inputFiles()]
    assert sum(sizes) == 20_000 and max(sizes) < 20_000 / 3


def test_no_groups_and_null_groups(spark):
    df = spark.createDataFrame([(None, 2), ("x", 1), (None, 1), ("x", 3)], "g string, k int")
    got = {(r["g"], r["k"]): r["i"] for r in o.number_rows(df, ["g"], ["k"], ordinal="i").collect()}
    assert got == {(None, 1): 0, (None, 2): 1, ("x", 1): 0, ("x", 3): 1}
    got = sorted(r["i"] for r in o.number_rows(df, order=["k", "g"], ordinal="i").collect())
    assert got == [0, 1, 2, 3]
    empty = o.number_rows(df.where("k > 9"), ["g"], ["k"], ordinal="i", global_ordinal="a", size="n")
    assert empty.collect() == []


def test_subsampling(spark):
    df = frames(spark, {"v1": 5, "v2": 4})
    kept = o.subsample_global(df, "video", ["name"], 3).orderBy("ordinal").collect()
    assert [(r["video"], r["frame_idx"], r["ordinal"]) for r in kept] == [("v1", 0, 0), ("v1", 3, 3), ("v2", 1, 6)]
    kept = o.subsample_per_video(df, "video", ["name"], 3).collect()
    assert sorted((r["video"], r["frame_idx"]) for r in kept) == [("v1", 0), ("v1", 3), ("v2", 0), ("v2", 3)]


def shards(spark, n, samples=1000, last=None):
    rows = [("d", f"s-{i:06d}.tar", last if last is not None and i == n - 1 else samples) for i in range(n)]
    return spark.createDataFrame(rows, "dataset string, shard string, n bigint")


@pytest.mark.parametrize(
    ("n", "counts"),
    [(1, (1, 0, 0)), (3, (3, 0, 0)), (5, (4, 1, 0)), (10, (8, 1, 1)), (20, (16, 1, 3)), (100, (80, 5, 15))],
)
def test_split_assign(spark, n, counts):
    split = o.split_assign(shards(spark, n), "dataset", "shard").orderBy("shard").collect()
    assert [r["split"] for r in split] == ["train"] * counts[0] + ["val"] * counts[1] + ["test"] * counts[2]


def test_split_totals_counts_the_last_shard_exactly(spark):
    row = o.split_totals(shards(spark, 10, last=250), "dataset", "shard", "n").first()
    assert (row["train"], row["val"], row["test"]) == (8000, 1000, 250)


@pytest.mark.parametrize(("n", "parts", "total"), [(8, 4, 8), (2, 8, 8), (10, 8, 16), (1, 3, 3)])
def test_shard_pad(spark, n, parts, total):
    out = o.shard_pad(shards(spark, n), "dataset", "shard", parts).orderBy("slot").collect()
    assert [r["slot"] for r in out] == list(range(total))
    assert [r["shard"] for r in out] == [f"s-{i % n:06d}.tar" for i in range(total)]


@pytest.mark.parametrize(("n", "world", "copies"), [(8, 1, 1), (3, 1, 3), (5, 2, 4), (40, 4, 1)])
def test_shard_repeat(spark, n, world, copies):
    out = o.shard_repeat(shards(spark, n), "dataset", "shard", world).collect()
    assert len(out) == n * copies


def test_segments_and_batches_keep_the_rest(spark):
    df = spark.range(2300)
    sizes = {r["segment_idx"]: (r["segment_len"], r["n"]) for r in o.segment_stream(df, ["id"]).groupBy(
        "segment_idx", "segment_len").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: (1000, 1000), 1: (1000, 1000), 2: (300, 300)}
    batches = o.batch_assign(df, ["id"], 256).groupBy("batch_idx").count().collect()
    assert sorted(r["count"] for r in batches) == [2300 - 8 * 256] + [256] * 8


def test_cum_length(spark):
    out = o.cum_length(frames(spark, {"v1": 5, "v2": 4, "v3": 1}), "video").orderBy("video").collect()
    assert [(r["length"], r["cum_len"]) for r in out] == [(5, 0), (4, 5), (1, 9)]
