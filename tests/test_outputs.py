"""What model families return and store: tensors of one model call, several shard sets of one pass."""

from __future__ import annotations

import io
import os
import sys
import tarfile

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from featmill.operators import extract as ex
from featmill.plans import jobs
from featmill.plans.registry import MODEL_SIZES
from featmill.sources import tarshards as ts
from featmill.sources.tensor_bytes import decode_features, encode_features, encode_image, load_tensors

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIDE, N = 4, 23


def pixels(i):
    return np.random.default_rng(i).integers(0, 256, (SIDE, SIDE, 3), dtype=np.uint8)


def tensors(px):
    px = px.astype(np.float32)
    return {
        "embedding": np.moveaxis(px.reshape(len(px), 2, 2, 2, 2, 3).mean(axis=(2, 4)), 3, 1),
        "cls_token": px.mean(axis=(1, 2)),
        "pooled_cls_token": px.max(axis=(1, 2))[:, None, :],
    }


def model_of(names, calls=None):
    def make():
        def run(px):
            if calls is not None:
                calls.add(1)
            found = tensors(px)
            return {n: found[n] for n in names}

        return run

    return make


@pytest.fixture
def root(spark, tmp_path):
    os.makedirs(tmp_path / "pets" / "images")
    for shard in range(3):
        with tarfile.open(tmp_path / "pets" / "images" / f"pets-{shard:06d}-train.tar", "w") as tar:
            for i in range(shard * 10, min(N, shard * 10 + 10)):
                out = io.BytesIO()
                np.save(out, pixels(i))
                info = tarfile.TarInfo(f"p{i:03d}.image")
                info.size = out.tell()
                tar.addfile(info, io.BytesIO(out.getvalue()))
    return str(tmp_path)


def stored(root, column):
    found = {}
    for name in sorted(os.listdir(f"{root}/pets/{column}")):
        with tarfile.open(f"{root}/pets/{column}/{name}") as tar:
            for m in tar.getmembers():
                assert m.name.endswith(f".{column}.safetensors")
                found[m.name.split(".")[0]] = (name, load_tensors(tar.extractfile(m).read()))
    return found


@pytest.mark.parametrize("model", list(MODEL_SIZES))
def test_a_family_stores_its_tensors_and_copies(spark, root, model):
    names = ex.outputs_of(model.replace("/", "_").lower())
    extractor = jobs.Extractor(model, model_of(names), (SIDE, SIDE, 3), (3, 2, 2))
    jobs.extract_dataset(spark, root, "pets", extractor, samples_per_shard=10, bf16=False)
    want = tensors(np.stack([pixels(i) for i in range(N)]))
    for k, (column, (c, h, w)) in enumerate(extractor.sets.items()):
        found = stored(root, column)
        assert sorted(found) == [f"p{i:03d}" for i in range(N)]
        for i in range(N):
            shard, own = found[f"p{i:03d}"]
            assert shard == f"pets-{i // 10:06d}-train.tar"
            assert set(own) == (set(names) if k == 0 else {"embedding"})
            grid = np.arange(h) * 2 // h
            np.testing.assert_array_equal(own["embedding"], want["embedding"][i][:, grid][:, :, np.arange(w) * 2 // w])
            for name in set(own) - {"embedding"}:
                np.testing.assert_array_equal(own[name].ravel(), want[name][i].ravel())
    report = jobs.check_dataset(spark, root, "pets", [extractor], split="train", shards=3, per_shard=4).collect()
    # Stored as float32, compared as bfloat16: what is resized is resized alike, so only rounding can differ.
    assert len(report) == 3 * len(extractor.sets) and all(r["keys_ok"] and r["missing"] == 0 and r["missized"] == 0 for r in report)
    assert {r["model"] for r in report} == {model + c.removeprefix(extractor.column) for c in extractor.sets}


def test_one_call_of_the_model_fills_all_sets(spark, root):
    calls = spark.sparkContext.accumulator(0)
    sam = jobs.Extractor("facebook/sam-vit-huge", model_of(["embedding"], calls), (SIDE, SIDE, 3), (3, 2, 2), batch_size=100)
    jobs.extract_dataset(spark, root, "pets", sam, samples_per_shard=10)
    # predict_batch_udf never joins Arrow batches, of which each task has one here.
    assert calls.value <= 3
    assert jobs.check_dataset(spark, root, "pets", [sam], split="train", shards=3).where("not passed").count() == 0
    # A copy that lacks a shard is filled again, the others stay.
    folder = f"{root}/pets/facebook_sam-vit-huge_32"
    names = sorted(os.listdir(folder))
    before = {n: os.stat(f"{folder}/{n}").st_mtime_ns for n in names}
    with open(f"{folder}/{names[1]}", "r+b") as out:
        out.truncate(1000)
    jobs.extract_dataset(spark, root, "pets", sam, samples_per_shard=10)
    after = {n: os.stat(f"{folder}/{n}").st_mtime_ns for n in names}
    assert [before[n] == after[n] for n in names] == [True, False, True] and sorted(os.listdir(folder)) == names
    assert len(stored(root, "facebook_sam-vit-huge_32")) == N


@pytest.mark.parametrize("names", [["embedding"], ["embedding", "cls_token"], ["embedding", "cls_token", "pooled_cls_token", "more"]])
def test_a_model_has_to_return_its_familys_tensors(spark, root, names):
    def make():
        def run(px):
            found = tensors(px) | {"more": px}
            return {n: found[n] for n in names}

        return run

    extractor = jobs.Extractor("facebook/dinov2-large", make, (SIDE, SIDE, 3), (3, 2, 2))
    with pytest.raises(Exception, match="has to return"):
        jobs.extract_dataset(spark, root, "pets", extractor, samples_per_shard=10)


def test_tokens_in_and_out(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], [5.0], [6.0, 7.0]), (2, [0.0] * 4, None, None)], "id int, e array<float>, c array<float>, p array<float>")
    data = encode_features(F.col("e"), 1, 2, 2, cls=F.col("c"), pooled=F.col("p"))
    rows = df.select("id", decode_features(data, 1, 2, 2).alias("f")).orderBy("id").collect()
    assert rows[0].f.asDict() == {"embedding": [1.0, 2.0, 3.0, 4.0], "cls": [5.0], "pooled_cls": [6.0, 7.0]}
    assert rows[1].f.asDict() == {"embedding": [0.0] * 4, "cls": None, "pooled_cls": None}


def test_shards_of_one_name_fill_side_by_side(spark, tmp_path):
    rows = [(f"{folder}/x-{s}.tar", f"{i:03d}.{folder}", str(i).encode()) for s in range(3) for i in range(5) for folder in "ab"]
    df = spark.createDataFrame(rows, "shard string, member string, data binary").coalesce(1)
    ts.write_shards(df, str(tmp_path), arranged=True)
    got = ts.read_shards(spark, str(tmp_path)).select("shard", "member", "data").collect()
    assert sorted((r.shard, r.member, bytes(r.data)) for r in got) == sorted(rows)
    assert ts.write_shards(df.where("false"), str(tmp_path), arranged=True) is None


def test_image_round_trip(spark):
    df = spark.createDataFrame([(list(range(48)),)], "px array<int>").select(encode_image(F.col("px"), 4, 4, 3).alias("d"))
    assert np.load(io.BytesIO(df.first()["d"])).shape == (4, 4, 3)
