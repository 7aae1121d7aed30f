"""Streams give what batch gives, once, also over several arrivals and restarts."""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from check import connect, rows_of
from pyspark.sql import functions as F

from featmill import workload
from featmill.operators.stats import channel_stats
from featmill.sources.tarshards import read_shards, register, write_shards
from featmill.sources.tarstream import ArrivalLog, TarShardStreamWriter
from featmill.streaming import shards as st


@pytest.fixture
def features(spark):
    return spark.range(300).select(
        "id", F.expr("id div 100").alias("shard_idx"), F.array(*[(F.col("id") * k).cast("float") for k in range(4)]).alias("x")
    )


def test_each_shard_is_read_once_over_restarts(spark, features, tmp_path):
    arrived, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for k in range(3):
        features.where(F.col("shard_idx") == k).write.mode("append").parquet(arrived)
        st.drain(st.stream_shards(spark, arrived, features.schema), out, progress)
        assert spark.read.parquet(out).count() == 100 * (k + 1)
    st.drain(st.stream_shards(spark, arrived, features.schema), out, progress)
    assert spark.read.parquet(out).exceptAll(features).count() == 0


def test_statistics_follow_arrivals(spark, features, tmp_path):
    arrived, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for k in range(3):
        features.where(F.col("shard_idx") == k).write.mode("append").parquet(arrived)
        stream = st.stream_channel_stats(st.stream_shards(spark, arrived, features.schema), "x", 2, 2)
        st.drain_table(stream, out, progress)
        want = channel_stats(features.where(F.col("shard_idx") <= k), "x", 2, 2).orderBy("channel").collect()
        got = st.latest(spark, out).orderBy("channel").collect()
        for a, b in zip(got, want, strict=True):
            assert (a["channel"], a["n"]) == (b["channel"], b["n"])
            assert (a["mean"], a["std"]) == pytest.approx((b["mean"], b["std"]))


def test_extraction_survives_a_crash(spark, features, tmp_path):
    arrived, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    features.write.partitionBy("shard_idx").parquet(arrived)
    schema = "id bigint, x array<float>, shard_idx bigint"
    stream = st.stream_shards(spark, arrived, schema, max_files=1)
    calls = []

    def extract(batch):
        calls.append(1)
        found = batch.select("id", "shard_idx", (F.col("x")[1] * 2).alias("y"))
        if len(calls) == 2:
            return found.withColumn("y", F.raise_error(F.lit("lost")).cast("float"))
        return found

    with pytest.raises(Exception, match="lost"):
        st.stream_extract(stream, extract, out, progress)
    st.stream_extract(stream, extract, out, progress)
    st.stream_extract(stream, extract, out, progress)
    rows = spark.read.parquet(out).collect()
    assert sorted(r["id"] for r in rows) == list(range(300))
    assert all(r["y"] == 2 * r["id"] for r in rows)


def documents(spark, first, last):
    rows = [(f"s{i % 4}-{i // 8}.tar", f"m{i:04d}.txt", f"{i}".encode() * 40) for i in range(first, last)]
    return spark.createDataFrame(rows, "shard string, member string, data binary")


def test_arriving_archives_are_read_once_after_a_broken_trigger(spark, tmp_path):
    arrived, out, progress, log = (str(tmp_path / n) for n in ("in", "out", "progress", "log"))
    write_shards(documents(spark, 0, 16), arrived)
    stream = st.stream_archives(spark, arrived, log, max_shards=3)
    broken = stream.withColumn("member", F.when(F.col("member") == "m0005.txt", F.raise_error(F.lit("lost"))).otherwise(F.col("member")))
    with pytest.raises(Exception, match="lost"):
        st.drain(broken.select("shard", "member", "data"), out, progress)
    # More arrive, one of them under a name and with a time before those that have been read.
    write_shards(documents(spark, 16, 40), arrived)
    os.utime(f"{arrived}/s0-2.tar", (1, 1))
    for _ in range(8):
        st.drain(st.stream_archives(spark, arrived, log, max_shards=3).select("shard", "member", "data"), out, progress)
    got = spark.read.parquet(out).collect()
    want = documents(spark, 0, 40).collect()
    assert sorted((r.shard, r.member, bytes(r.data)) for r in got) == sorted((r.shard, r.member, bytes(r.data)) for r in want)


def extracted(stream, out, progress):
    st.stream_extract(stream.select("shard", "member"), lambda batch: batch, out, progress, partition="shard")


RUNS = {
    "drain": (lambda stream, out, progress: st.drain(stream.select("member"), out, progress), lambda spark, out: spark.read.parquet(out)),
    "drain_archives": (st.drain_archives, read_shards),
    "drain_table": (lambda stream, out, progress: st.drain_table(stream.groupBy("member").count(), out, progress), st.latest),
    "stream_extract": (extracted, lambda spark, out: spark.read.parquet(out)),
}


@pytest.mark.parametrize("name", RUNS)
def test_one_run_takes_all_archives_that_have_arrived(spark, tmp_path, name):
    arrived, out, progress, log = (str(tmp_path / n) for n in ("in", "out", "progress", "log"))
    run, read = RUNS[name]
    for first, last, triggers in ((0, 24, 4), (24, 40, 7)):
        write_shards(documents(spark, first, last), arrived)
        run(st.stream_archives(spark, arrived, log, max_shards=3), out, progress)
        assert sorted(r.member for r in read(spark, out).select("member").collect()) == [f"m{i:04d}.txt" for i in range(last)]
        # A trigger still takes no more than its share.
        offered = ArrivalLog(log)
        assert offered.last() == triggers and all(len(offered.entry(k)) <= 3 for k in range(1, triggers + 1))


def test_the_query_reads_more_archives_than_a_trigger_takes(spark, tmp_path):
    # 501 shards arrive in the first go, 502 in the second.
    docs = spark.range(5015).selectExpr("id AS doc_id", "'text ' || id AS text", "'en' AS lang", "if(id < 2505, 'src0', 'src3') AS source")
    labels = spark.range(0, 5015, 7).selectExpr("id AS doc_id", "id % 2 AS quality", "id % 3 AS toxic")
    for name, rows in (("documents", docs), ("labels", labels)):
        pq.write_table(rows.toArrow(), tmp_path / f"{name}.parquet")
    df = workload.QUERIES["stream_archives"](spark, str(tmp_path))
    want = connect(str(tmp_path)).execute(workload.SQL["stream_archives"])
    names = [d[0] for d in want.description]
    assert df.select("shard").distinct().count() == 501 + 502
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, want.fetchall())


def test_a_log_is_needed(spark, tmp_path):
    register(spark)
    with pytest.raises(Exception, match="option log"):
        spark.readStream.format("tarshards").load(str(tmp_path)).writeStream.format("noop").trigger(availableNow=True).option(
            "checkpointLocation", str(tmp_path / "c")
        ).start().awaitTermination()


def test_a_repeated_trigger_leaves_no_second_copy(spark, tmp_path):
    writer = TarShardStreamWriter({"path": str(tmp_path)})
    batch = pa.RecordBatch.from_pydict({"shard": ["a.tar", "a.tar", "b.tar"], "member": ["1", "2", "1"], "data": [b"x", b"y", b"z"]})
    first = writer.write(iter([batch]))
    assert not [n for n in os.listdir(tmp_path) if n.endswith(".tar")]
    writer.commit([first, None], 4)
    # The driver was lost before it noted the commit: the trigger runs again.
    writer.commit([writer.write(iter([batch]))], 4)
    assert sorted(os.listdir(tmp_path)) == ["a-000004.tar", "b-000004.tar"]
    assert read_shards(spark, str(tmp_path)).count() == 3
    # A task that failed leaves nothing; one shard from two tasks is refused.
    writer.abort([writer.write(iter([batch]))], 5)
    with pytest.raises(ValueError, match="several tasks"):
        writer.commit([writer.write(iter([batch])), writer.write(iter([batch]))], 6)
    assert sorted(os.listdir(tmp_path)) == ["a-000004.tar", "b-000004.tar"]


def test_stream_to_shards(spark, tmp_path):
    arrived, out, progress, log = (str(tmp_path / n) for n in ("in", "out", "progress", "log"))
    for first, last in ((0, 10), (10, 20), (20, 20)):
        if last > first:
            write_shards(documents(spark, first * 8, last * 8), arrived)
        st.drain_archives(st.stream_archives(spark, arrived, log, members="m0*"), out, progress)
    got = read_shards(spark, out).select("member", "data").collect()
    assert sorted((r.member, bytes(r.data)) for r in got) == [(f"m{i:04d}.txt", f"{i}".encode() * 40) for i in range(160)]


def test_old_versions_of_a_table_go(spark, features, tmp_path):
    arrived, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for k in range(4):
        features.where(F.col("shard_idx") == k % 3).write.mode("append").parquet(arrived)
        st.drain_table(st.stream_channel_stats(st.stream_shards(spark, arrived, features.schema), "x", 2, 2), out, progress)
    assert len([n for n in os.listdir(out) if n.startswith("v=")]) == st.KEPT
    assert st.latest(spark, out).agg(F.sum("n")).first()[0] == 2 * 2 * 400
