from __future__ import annotations

import json
import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from featmill.operators import quality as q
from featmill.sources import files as fs
from featmill.sources import tarshards as ts
from featmill.sources import tensor_bytes as tb
from featmill.sources.column_store import read_column, write_bucketed, write_column
from featmill.sources.episodes import episode_frames, nest_episodes


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1000).select(
        F.format_string("s-%03d-train.tar", F.expr("id div 300")).alias("shard"),
        F.format_string("%06d.text", "id").alias("member"),
        F.encode(F.repeat(F.col("id").cast("string"), 50), "UTF-8").alias("data"),
    )


@pytest.fixture(scope="module")
def path(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shards"))
    ts.write_shards(rows, path)
    return path


def test_archives_are_plain_tar(path):
    assert sorted(os.listdir(path)) == [f"s-{i:03d}-train.tar" for i in range(4)]
    with tarfile.open(f"{path}/s-003-train.tar") as tar:
        names = tar.getnames()
        assert names == sorted(names) and len(names) == 100
        assert tar.extractfile("000900.text").read() == b"900" * 50


@pytest.mark.parametrize("split_bytes", [700, 5000, 1 << 30])
def test_every_member_is_read_once_however_shards_are_split(spark, path, rows, split_bytes):
    """Also ranges that start inside payloads or hold no header at all."""
    got = spark.read.format("tarshards").option("splitBytes", split_bytes).option("parallelism", 10**6).load(path)
    same = got.select("shard", "member", "data")
    assert same.count() == 1000
    assert same.exceptAll(rows).count() == 0


def test_pack_ranges_cuts_large_and_packs_small():
    mb = 1 << 20
    packed = ts.pack_ranges([("big", 1000 * mb)] + [(f"s{i}", 10) for i in range(1000)], 64 * mb, 8)
    big = [r for p in packed for r in p.ranges if r[0] == "big"]
    assert len(big) == 16 and big[0][1] == 0 and all(a[2] == b[1] for a, b in zip(big, big[1:]))
    assert len(packed) < 40
    assert [r[0] for p in packed for r in p.ranges if r[0] != "big"] == [f"s{i}" for i in range(1000)]


def test_pattern_and_listing(spark, path):
    assert ts.read_shards(spark, path, "*-val.tar").count() == 0
    listed = ts.read_shards(spark, path, "s-001-*.tar", payload=False)
    assert listed.count() == 300 and listed.where("data is not null").count() == 0


def test_fetch_reads_the_members_asked_for(spark, path, rows):
    listed = ts.read_shards(spark, path, payload=False).where(F.col("member").endswith("7.text"))
    got = ts.fetch_members(listed, path).select("shard", "member", "data")
    assert got.count() == 100 and got.exceptAll(rows).count() == 0


def test_shards_in_subfolders(spark, rows, tmp_path):
    path = str(tmp_path)
    nested = rows.withColumn("shard", F.concat(F.lit("view/"), F.col("shard")))
    ts.write_shards(nested, path)
    files = q.list_shard_files(spark, path)
    assert files.count() == 4 and files.where("shard like 'view/s-%'").count() == 4
    got = ts.fetch_members(ts.list_members(files), path).select("shard", "member", "data")
    assert got.count() == 1000 and got.exceptAll(nested).count() == 0
    assert ts.read_shards(spark, path).select("shard", "member", "data").exceptAll(nested).count() == 0


def test_complete_shards_are_left_alone(spark, rows, tmp_path):
    path = str(tmp_path)
    ts.write_shards(rows.where("shard < 's-002'"), path)
    with open(f"{path}/s-001-train.tar", "r+b") as out:
        out.truncate(5000)
    before = os.stat(f"{path}/s-000-train.tar").st_mtime_ns
    report = q.shard_integrity(q.list_shard_files(spark, path)).orderBy("shard").collect()
    assert [r["ok"] for r in report] == [True, False]
    ts.write_shards(rows, path, existing=q.shard_integrity(q.list_shard_files(spark, path)))
    assert os.stat(f"{path}/s-000-train.tar").st_mtime_ns == before
    assert ts.read_shards(spark, path).select("shard", "member", "data").exceptAll(rows).count() == 0
    assert not [f for f in os.listdir(path) if f.endswith(".part")]


def test_integrity_reports_every_kind_of_damage(spark, rows, tmp_path):
    path = str(tmp_path)
    ts.write_shards(rows, path)
    whole = open(f"{path}/s-000-train.tar", "rb").read()
    damaged = {"header": whole[:300], "payload": whole[:700], "member": whole[: 512 * 40 + 100], "junk": b"x" * 2000}
    for name, data in damaged.items():
        with open(f"{path}/{name}.tar", "wb") as out:
            out.write(data)
    report = {r["shard"]: r for r in q.shard_integrity(q.list_shard_files(spark, path)).collect()}
    assert {k for k, r in report.items() if not r["ok"]} == {f"{name}.tar" for name in damaged}
    assert all(r["error"] for r in report.values() if not r["ok"])
    assert report["s-000-train.tar"]["n"] == 300


def test_safetensors_round_trip():
    x = np.random.default_rng(0).normal(size=(2, 3, 3)).astype(np.float32)
    back = tb.load_tensors(tb.save_tensors({"embedding": x, "cls_token": x[0, 0]}))
    assert (back["embedding"] == x).all() and (back["cls_token"] == x[0, 0]).all()
    rounded = tb.load_tensors(tb.save_tensors({"embedding": x}, bf16=True))["embedding"]
    assert rounded.shape == x.shape and np.abs(rounded - x).max() < np.abs(x).max() / 128


def test_safetensors_by_hand():
    """The documented layout: length, JSON header, raw little-endian values."""
    header = json.dumps({"__metadata__": {"a": "b"}, "embedding": {"dtype": "BF16", "shape": [1, 1, 2], "data_offsets": [0, 4]}})
    blob = len(header).to_bytes(8, "little") + header.encode() + b"\x80\x3f\x00\xc0"
    assert tb.load_tensors(blob)["embedding"].tolist() == [[[1.0, -2.0]]]


def test_decode_checks_the_shape(spark):
    blob = tb.save_tensors({"embedding": np.zeros((1, 2, 2), np.float32)})
    df = spark.createDataFrame([(bytearray(blob),), (None,)], "data binary")
    assert [r["e"] for r in df.select(tb.decode_features(F.col("data"), 1, 2, 2)["embedding"].alias("e")).collect()] == [
        [0.0] * 4,
        None,
    ]
    with pytest.raises(Exception, match="stored tensor"):
        df.select(tb.decode_features(F.col("data"), 2, 2, 1)).collect()


def test_image_folder(spark, tmp_path):
    for name in ("train/n01/n01_2.JPEG", "train/n01/n01_1.JPEG", "train/n02/n02_9.x.JPEG", "train/n02/readme.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    files = fs.read_image_folder(spark, str(tmp_path / "train")).orderBy("path").collect()
    assert [r["key"] for r in files] == ["n01_1", "n01_2", "n02_9"]
    assert bytes(files[0]["content"]) == b"train/n01/n01_1.JPEG"


def test_splits_json(spark, tmp_path):
    wide = spark.createDataFrame([("a", 8, 1, 0), ("b", 5, 0, 2)], "dataset string, train bigint, val bigint, test bigint")
    fs.write_splits(wide, str(tmp_path))
    assert json.load(open(tmp_path / "a" / "splits.json")) == {"train": 8, "val": 1, "test": 0}
    got = {(r["dataset"], r["split"]): r["n"] for r in fs.read_splits(spark, str(tmp_path)).collect()}
    assert got[("b", "test")] == 2 and len(got) == 6


def test_npy_stats(spark, tmp_path):
    np.save(tmp_path / "imagenet_mean_a_b.npy", np.array([1.0, 2.0], dtype=np.float32))
    np.save(tmp_path / "imagenet_var_a_b.npy", np.array([3.0, 4.0], dtype=np.float32))
    np.save(tmp_path / "imagenet_mean_lonely.npy", np.array([1.0]))
    rows = fs.read_npy_stats(spark, str(tmp_path)).orderBy("channel").collect()
    assert [(r["model"], r["channel"], r["mean"], r["std"]) for r in rows] == [("a_b", 0, 1.0, 3.0), ("a_b", 1, 2.0, 4.0)]


def test_episodes(spark):
    steps = spark.createDataFrame(
        [("e", i, {"front": bytearray([i % 250]), "wrist": bytearray([1])}) for i in range(25)],
        "ep string, frame int, observation map<string, binary>",
    )
    nested = nest_episodes(steps, "ep", ["frame"], length=10)
    assert sorted(len(r["steps"]) for r in nested.collect()) == [5, 10, 10]
    assert [s["frame"] for r in nested.orderBy("segment").collect() for s in r["steps"]] == list(range(25))
    frames = episode_frames(nested, "ep")
    assert frames.count() == 50
    assert bytes(frames.where("frame_idx = 7 and view = 'front'").first()["image"]) == b"\x07"


@pytest.fixture(scope="module")
def samples(spark):
    return spark.range(1000).select(
        F.when(F.col("id") < 800, "big").otherwise("small").alias("dataset"),
        F.when(F.col("id") % 10 < 8, "train").otherwise("val").alias("split"),
        F.expr("id div 50").alias("shard_idx"),
        F.col("id").cast("string").alias("key"),
        (F.col("id") * 2).alias("value"),
    )


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_column_store_prunes(spark, samples, tmp_path):
    write_column(samples, str(tmp_path), "images")
    df = read_column(spark, str(tmp_path), "images", "big", "train", (3, 5)).select("key", "value")
    assert df.count() == 80
    plan = plan_of(df)
    assert "PartitionFilters: [isnotnull(dataset" in plan and "GreaterThanOrEqual(shard_idx,3)" in plan
    assert "ReadSchema: struct<shard_idx:bigint,key:string,value:bigint>" in plan


def test_numbers_as_dataset_names(spark, samples, tmp_path):
    write_column(samples.withColumn("dataset", F.lit("007")), str(tmp_path), "images")
    assert read_column(spark, str(tmp_path), "images", "007", "val").first()["dataset"] == "007"


def test_bucketed_columns_join_without_a_shuffle(spark, samples, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("left_column", "right_column"):
            write_bucketed(samples, name, str(tmp_path / name), ["dataset", "key"], 4)
        left, right = (spark.table(n) for n in ("left_column", "right_column"))
        joined = left.join(right.withColumnRenamed("value", "other").select("dataset", "key", "other"), ["dataset", "key"])
        assert joined.count() == 1000
        assert "Exchange" not in joined._jdf.queryExecution().sparkPlan().toString()
        assert "Exchange hashpartitioning(dataset" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
        spark.sql("DROP TABLE IF EXISTS left_column")
        spark.sql("DROP TABLE IF EXISTS right_column")


def test_writing_a_shard_again_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("d", "train", s, f"{s}-{k}", k) for s in range(3) for k in range(4)], "dataset string, split string, shard_idx int, key string, v int")
    write_column(rows.where("shard_idx < 2"), str(tmp_path), "c")
    write_column(rows, str(tmp_path), "c")
    assert read_column(spark, str(tmp_path), "c").count() == 12


def test_runs_are_bounded_by_bytes():
    from featmill.sources.tarshards import bounded_runs

    assert list(bounded_runs([3, 3, 3, 20, 1, 1], 6)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(bounded_runs([], 6)) == []


def test_segments_are_bounded_by_bytes(spark):
    """Steps of a megabyte and of a kilobyte; only keys reach the scratch table."""
    steps = spark.range(60).select(
        F.expr("id div 30").alias("ep"), (F.col("id") % 30).alias("frame"),
        F.create_map(F.lit("front"), F.expr("encode(repeat('x', if(id % 7 = 0, 1000000, 1000)), 'UTF-8')")).alias("observation"),
    )
    nested = nest_episodes(steps, "ep", ["frame"], length=8, segment_bytes=2_000_000)
    rows = nested.select("ep", "segment", F.size("steps").alias("n"), F.col("steps.frame").alias("frames"),
                         F.aggregate("steps", F.lit(0), lambda a, s: a + F.octet_length(s["observation"]["front"])).alias("bytes")).collect()
    assert sum(r["n"] for r in rows) == 60
    assert all(r["n"] <= 8 and r["bytes"] <= 3_000_000 and r["frames"] == list(range(r["frames"][0], r["frames"][0] + r["n"])) for r in rows)
    assert max(r["bytes"] for r in rows) >= 1_000_000 and len(rows) < 20
    frames = episode_frames(nested, "ep")
    assert frames.count() == 60 and frames.where("frame_idx = 14").count() == 2


def test_archives_have_the_bytes_that_tarfile_gives(tmp_path):
    import io
    import tarfile

    from pyarrow.fs import LocalFileSystem

    from featmill.sources.tarshards import Archive, member_header

    sizes = [0, 1, 511, 512, 513, 5000, 70_000, 300_000]
    names = ["a.jpg", "x" * 100, "x" * 101, "dir/ü.text", "d" * 120 + "/" + "y" * 140, "n" * 99 + "é", "frame_000001.jpg", "", "b\0c"]
    for name in names:
        for size in [*sizes, 8**11 - 1, 8**11]:
            info = tarfile.TarInfo(name)
            info.size = size
            assert member_header(name, size) == info.tobuf()
    for n in (0, 1, 7, 9, len(names)):
        plain, archive = io.BytesIO(), Archive(LocalFileSystem(), str(tmp_path / f"{n}.tar"))
        with tarfile.open(fileobj=plain, mode="w|") as tar:
            for name, size in zip(names[:n], [*sizes, 3]):
                info = tarfile.TarInfo(name)
                info.size = size
                tar.addfile(info, io.BytesIO(b"z" * size))
                archive.add(name, b"z" * size)
        archive.close()
        assert (tmp_path / f"{n}.tar").read_bytes() == plain.getvalue() and archive.members == min(n, len(names))


def test_headers_of_chosen_members_are_walked_once(spark, tmp_path):
    from featmill.sources import tarshards as ts

    rows = spark.createDataFrame([("a.tar", f"m{k}", bytes([k])) for k in range(9)], "shard string, member string, data binary")
    ts.write_shards(rows, str(tmp_path))
    walks = spark.sparkContext.accumulator(0)

    def walked(batches):
        for batch in batches:
            walks.add(batch.num_rows)
            yield batch

    listed = ts.read_shards(spark, str(tmp_path), payload=False).drop("data")
    found = ts.fetch_members(listed.mapInArrow(walked, listed.schema), str(tmp_path))
    assert sorted((r["member"], r["data"][0]) for r in found.collect()) == [(f"m{k}", k) for k in range(9)]
    assert walks.value == 9


def test_checks_of_many_shards_take_few_tasks(spark, tmp_path):
    from featmill.operators import quality as q
    from featmill.sources import tarshards as ts

    rows = spark.range(600).selectExpr("format_string('s%04d.tar', id) AS shard", "'m' AS member", "CAST('x' AS binary) AS data")
    ts.write_shards(rows, str(tmp_path))
    files = q.list_shard_files(spark, str(tmp_path))
    cores = spark.sparkContext.defaultParallelism
    spread = ts.spread_files(files, "shard", "path")
    assert spread.rdd.getNumPartitions() == cores
    # What is shuffled are the names written by a few tasks.
    assert len(spread.inputFiles()) <= 4 * cores and not any(f.endswith(".tar") for f in spread.inputFiles())
    report = q.shard_integrity(files)
    assert report.where("ok AND n = 1").count() == 600
