"""Whole jobs on a small dataset folder."""

from __future__ import annotations

import io
import json
import os
import sys
import tarfile

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from featmill.plans import jobs
from featmill.sources import tarshards as ts
from featmill.sources.column_store import _table_name, open_column, write_bucketed, write_buckets, write_column
from featmill.sources.tensor_bytes import load_tensors

# Workers cannot import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIDE = 4


def image(i: int) -> bytes:
    out = io.BytesIO()
    np.save(out, np.random.default_rng(i).integers(0, 256, (SIDE, SIDE, 3), dtype=np.uint8))
    return out.getvalue()


def make_model():
    """Patch means of each channel: [b, 4, 4, 3] to [b, 3, 2, 2]."""

    def run(px):
        blocks = px.reshape(len(px), 2, 2, 2, 2, 3).mean(axis=(2, 4))
        return np.moveaxis(blocks, 3, 1)

    return run


MODEL = jobs.Extractor("Test/Patch-Mean", make_model, (SIDE, SIDE, 3), (3, 2, 2))


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """95 files in two class folders, organised into shards of 10 and split."""
    raw, root = tmp_path_factory.mktemp("raw"), str(tmp_path_factory.mktemp("root"))
    for i in range(95):
        folder = raw / f"n{i % 2:02d}"
        folder.mkdir(exist_ok=True)
        (folder / f"n{i % 2:02d}_{i:04d}.JPEG").write_bytes(image(i))
    jobs.organize_images(spark, str(raw), root, "pets", "all", samples_per_shard=10)
    # Splitting starts from shards that carry no split yet.
    images = f"{root}/pets/images"
    for name in os.listdir(images):
        os.rename(f"{images}/{name}", f"{images}/{name.replace('-all.tar', '.tar')}")
    jobs.split_dataset(spark, root, "pets", samples_per_shard=10)
    return root


def test_shards_follow_path_order(root):
    names = sorted(os.listdir(f"{root}/pets/images"))
    assert len(names) == 10 and names[0] == "pets_all-000000-train.tar" and names[-1].endswith("-test.tar")
    members = []
    for name in names:
        with tarfile.open(f"{root}/pets/images/{name}") as tar:
            members += tar.getnames()
    assert members == sorted(f"n{i % 2:02d}_{i:04d}.image" for i in range(95))


def test_split_counts(root):
    assert json.load(open(f"{root}/pets/splits.json")) == {"train": 80, "val": 10, "test": 5}


def test_splitting_again_changes_nothing(spark, root):
    before = sorted(os.listdir(f"{root}/pets/images"))
    jobs.split_dataset(spark, root, "pets", samples_per_shard=10)
    assert sorted(os.listdir(f"{root}/pets/images")) == before


def test_a_split_that_broke_off_is_finished_the_same(spark, root):
    """Without the catalog, and with two shards not yet renamed."""
    images = f"{root}/pets/images"
    before = sorted(os.listdir(images))
    os.rename(f"{root}/pets/splits.json", f"{root}/pets/splits.old")
    for name in (before[0], before[-1]):
        os.rename(f"{images}/{name}", f"{images}/" + name.replace("-train", "").replace("-test", ""))
    jobs.split_dataset(spark, root, "pets", samples_per_shard=10)
    assert sorted(os.listdir(images)) == before
    assert json.load(open(f"{root}/pets/splits.json")) == {"train": 80, "val": 10, "test": 5}


def features(root, split="train"):
    folder, out = f"{root}/pets/{MODEL.column}", {}
    for name in sorted(os.listdir(folder)):
        if name.endswith(f"-{split}.tar"):
            with tarfile.open(f"{folder}/{name}") as tar:
                for member in tar.getmembers():
                    out[member.name.split(".")[0]] = load_tensors(tar.extractfile(member).read())["embedding"]
    return out


def test_extract_resume_statistics_and_check(spark, root, tmp_path):
    # Part of the samples first, rounded out to whole shards.
    jobs.extract_dataset(spark, root, "pets", MODEL, num=25, samples_per_shard=10)
    assert len(features(root)) == 30
    folder = f"{root}/pets/{MODEL.column}"
    done = {name: os.stat(f"{folder}/{name}").st_mtime_ns for name in os.listdir(folder)}
    damaged = sorted(done)[1]
    with open(f"{folder}/{damaged}", "r+b") as out:
        out.truncate(3000)
    jobs.extract_dataset(spark, root, "pets", MODEL, samples_per_shard=10)
    for name, stamp in done.items():
        assert (os.stat(f"{folder}/{name}").st_mtime_ns == stamp) == (name != damaged)
    found = features(root)
    assert len(found) == 80
    for key, embedding in found.items():
        px = np.load(io.BytesIO(image(int(key[4:])))).astype(np.float64)
        np.testing.assert_allclose(embedding, make_model()(px[None])[0], rtol=1 / 128)

    stats = jobs.feature_statistics(spark, root, "pets", {MODEL.model: (3, 2, 2)}, str(tmp_path / "stats"))
    values = np.stack(list(found.values())).astype(np.float64)
    for row in stats.collect():
        channel = values[:, row["channel"]]
        assert row["n"] == channel.size
        assert row["mean"] == pytest.approx(channel.mean()) and row["std"] == pytest.approx(channel.std(ddof=1))
    again = jobs.feature_statistics(spark, root, "pets", {MODEL.model: (3, 2, 2)}, str(tmp_path / "stats"))
    assert again.count() == 3

    report = jobs.check_dataset(spark, root, "pets", [MODEL], split="train", seed=2, shards=4, per_shard=3)
    rows = report.collect()
    assert len(rows) == 4 and all(r["passed"] for r in rows)


def test_check_finds_a_wrong_value_and_a_wrong_key(spark, root, tmp_path_factory):
    copy = str(tmp_path_factory.mktemp("copy"))
    jobs.extract_dataset(spark, root, "pets", MODEL, split="val", samples_per_shard=10)
    for column in ("images", MODEL.column):
        rows = ts.read_shards(spark, f"{root}/pets/{column}", "*-val.tar").select("shard", "member", "data")
        if column != "images":
            blob = rows.orderBy("member").first()["data"]
            first = F.col("member") == rows.agg(F.min("member")).first()[0]
            rows = rows.withColumn("data", F.when(~first, F.lit(blob)).otherwise(F.col("data")))
        ts.write_shards(rows, f"{copy}/pets/{column}")
    bad = jobs.check_dataset(spark, copy, "pets", [MODEL], split="val", per_shard=10).first()
    assert not bad["equal"] and bad["keys_ok"] and not bad["passed"] and bad["largest"] > 0
    # The same features, each under a name that sorts alike but is not its image's.
    misnamed = ts.read_shards(spark, f"{root}/pets/{MODEL.column}", "*-val.tar").select(
        "shard", F.replace("member", F.lit("."), F.lit("x.")).alias("member"), "data"
    )
    other = str(tmp_path_factory.mktemp("other"))
    ts.write_shards(misnamed, f"{other}/pets/{MODEL.column}")
    images = ts.read_shards(spark, f"{root}/pets/images", "*-val.tar").select("shard", "member", "data")
    ts.write_shards(images, f"{other}/pets/images")
    bad = jobs.check_dataset(spark, other, "pets", [MODEL], split="val", per_shard=10).first()
    assert bad["equal"] and not bad["keys_ok"] and not bad["passed"]


def test_subsample_videos(spark, tmp_path):
    rows = spark.createDataFrame(
        [(v, i) for v, n in (("p01.tar", 50), ("p02.tar", 45), ("p03.tar", 5)) for i in range(n)], "shard string, i int"
    )
    frames = rows.select(
        "shard", F.format_string("frame_%05d.jpg", "i").alias("member"),
        F.encode(F.concat_ws(":", "shard", "i"), "UTF-8").alias("data"),
    )
    notes = rows.where("i = 0").select("shard", F.lit("a.txt").alias("member"), F.encode("shard", "UTF-8").alias("data"))
    archives, root = str(tmp_path / "in"), str(tmp_path / "out")
    ts.write_shards(frames.unionByName(notes), archives)
    jobs.subsample_videos(spark, archives, root, "kitchen", rate=7, samples_per_shard=6)
    got = ts.read_shards(spark, f"{root}/kitchen_1in7/images").orderBy("shard", "member").collect()
    every = [(f"p0{v}", i) for v, n in ((1, 50), (2, 45), (3, 5)) for i in range(n)]
    want = every[::7]
    assert [r["member"] for r in got] == [f"{v}_{i:06d}.image" for v, i in want]
    assert [r["data"].decode() for r in got] == [f"{v}.tar:{i}" for v, i in want]
    assert [r["shard"] for r in got] == [f"kitchen_1in7-{k // 6:06d}.tar" for k in range(len(want))]
    with pytest.raises(NotImplementedError):
        jobs.subsample_videos(spark, archives, root, "unknown")


def test_frame_batches(spark, tmp_path):
    df = spark.range(300).select(
        F.when(F.col("id") < 200, "a").otherwise("b").alias("dataset"),
        F.lit("train").alias("split"),
        F.expr("id div 40").alias("shard_idx"),
        F.format_string("k%04d", "id").alias("key"),
        F.col("id").alias("image"),
        F.array(F.col("id").cast("float"), F.col("id").cast("float") + 1).alias("embedding"),
    )
    root = str(tmp_path)
    write_column(df.drop("embedding"), root, "images")
    write_column(df.drop("image"), root, "m_x")
    stats = spark.createDataFrame(
        [("m_x", 0, 10.0, 2.0), ("m_x", 1, 0.0, 0.5)], "model string, channel int, mean double, std double"
    )
    batches = jobs.frame_batches(
        spark, root, {"a": 1.0, "b": 2.0}, {"M/x": (2, 1, 1)}, batch_size=16, stats=stats, shuffle_buffer=64
    )
    rows = batches.collect()
    assert len(rows) == 300 and {r["key"] for r in rows} == {f"k{i:04d}" for i in range(300)}
    assert sorted((r["batch_idx"], r["batch_pos"]) for r in rows) == [(i // 16, i % 16) for i in range(300)]
    epoch = jobs.frame_batches(spark, root, {"a": 1.0, "b": 2.0}, {}, ratio=0.1, batch_size=8, world=2).collect()
    # 20 + 2 * 10 samples, in steps of 16.
    assert len(epoch) == 48 and max(r["batch_idx"] for r in epoch) == 5
    for r in rows:
        assert r["key"] == f"k{r['image']:04d}"
        assert r["m_x"] == pytest.approx([(r["image"] - 10.0) / 2.0, (r["image"] + 1) / 0.5])


def test_bucketed_payloads_do_not_move(spark, tmp_path):
    samples = spark.range(500).select(
        F.lit("a").alias("dataset"),
        F.expr("id div 40").alias("shard_idx"),
        F.format_string("k%04d", "id").alias("key"),
        F.col("id").alias("image"),
        F.array(F.col("id").cast("float")).alias("embedding"),
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("bucketed_images", "bucketed_features"):
            write_bucketed(samples, name, str(tmp_path / name), ["dataset", "key"], 8)
        images, features = spark.table("bucketed_images"), spark.table("bucketed_features")
        weights = spark.sql("SELECT 'a' AS dataset, 1.0D AS weight")
        batches = jobs.batch_columns(images.drop("embedding"), {"m": features}, weights, batch_size=32)
        plan = batches._jdf.queryExecution().executedPlan().toString()
        # Each scan of a payload is read in buckets and goes into its join without an exchange.
        for line in plan.splitlines():
            if "Exchange" in line:
                below = plan[plan.index(line) :].splitlines()[1:4]
                assert not any("image#" in b or "embedding#" in b for b in below), line
        assert plan.count("Bucketed: true") == 2
        rows = batches.collect()
        assert len(rows) == 500 and all(r["m"] == [float(r["image"])] for r in rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
        spark.sql("DROP TABLE IF EXISTS bucketed_images")
        spark.sql("DROP TABLE IF EXISTS bucketed_features")


def test_batches_of_bucketed_columns_move_only_keys(spark, tmp_path):
    """The job itself, on a store that another session has written."""
    samples = spark.range(500).select(
        F.when(F.col("id") < 300, "a").otherwise("b").alias("dataset"),
        F.when(F.col("id") % 50 == 0, "val").otherwise("train").alias("split"),
        F.expr("id div 40").alias("shard_idx"),
        F.format_string("k%04d", "id").alias("key"),
        F.col("id").alias("image"),
        F.array(F.col("id").cast("float")).alias("embedding"),
    )
    root = str(tmp_path)
    write_buckets(samples.drop("embedding"), root, "images", 8)
    write_buckets(samples.drop("image"), root, "m_x", 8)
    for column in ("images", "m_x"):
        # What a session knows of a table ends with it; the files stay.
        spark.sql(f"DROP TABLE {_table_name(f'{root}/{column}.b8')}")
    stats = spark.createDataFrame([("m_x", 0, 10.0, 2.0)], "model string, channel int, mean double, std double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batches = jobs.frame_batches(spark, root, {"a": 1.0, "b": 2.0}, {"M/x": (1, 1, 1)}, batch_size=16, stats=stats, shuffle_buffer=64)
        plan = batches._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Bucketed: true") == 2
        for line in plan.splitlines():
            if "Exchange" in line:
                below = plan[plan.index(line) :].splitlines()[1:4]
                assert not any("image#" in b or "embedding#" in b for b in below), line
        rows = batches.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
    assert sorted(r["image"] for r in rows) == [i for i in range(500) if i % 50]
    assert all(r["m_x"] == [(r["image"] - 10.0) / 2.0] for r in rows)
    assert open_column(spark, root, "images", "val").count() == 10
    write_buckets(samples.drop("image"), root, "m_x", 4)
    with pytest.raises(ValueError, match="several numbers of buckets"):
        open_column(spark, root, "m_x")


def test_stored_tensors_are_summed_where_they_are_decoded(spark, sf):
    from featmill.sources.tensor_bytes import decode_features, encode_features
    from featmill.workload.jobs import _SUMS, extract_dataset, tensor_sums

    # Values whose sum depends on the order, negative zeros, NaN, and no class token.
    tensors = [[1e8, 1.0, -1e8, 0.1] * 64, [-0.0] * 256, [float("nan")] + [1.0] * 255]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(tensors)], "k int, e array<float>")
    stored = rows.select("k", encode_features(F.col("e"), 1, 16, 16).alias("data"))
    got = {r["k"]: r["s"] for r in stored.select("k", tensor_sums(decode_features(F.col("data"), 1, 16, 16)).alias("s")).collect()}
    by_hand = F.expr("aggregate(transform(cast(e AS array<double>), (x, i) -> x * ((i + 1) % 97)), 0D, (a, x) -> a + x)")
    want = rows.select("k", F.expr("aggregate(cast(e AS array<double>), 0D, (a, x) -> a + x)").alias("total"), by_hand.alias("placed"), F.col("e")[255].alias("last"))
    for r in want.collect():
        found = got[r["k"]]
        assert found["embedding_size"] == 256 and found["cls_size"] is None and found["embedding_last"] == r["last"]
        for c in ("total", "placed"):
            assert r["k"] == 2 or str(found[f"embedding_{c}"]) == str(r[c])
    plan = extract_dataset(spark, sf)
    assert plan.columns == ["set", "shard", "key", "tensor", *_SUMS]
    assert "aggregate(" not in plan._jdf.queryExecution().optimizedPlan().toString()
