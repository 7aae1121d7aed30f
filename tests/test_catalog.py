"""Names, registry and mixes: the hand-worked cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from featmill.functions import naming as n
from featmill.plans import catalog as c
from featmill.plans.registry import NAMED_MIXES, registry_rows, resolve_mix


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def views(*names):
    return F.array(*[F.lit(x) for x in names])


@pytest.mark.parametrize(
    ("names", "mode", "chosen"),
    [
        (("image", "hand_image", "image2"), None, ["image"]),
        (("image", "hand_image", "image2"), [], ["image", "hand_image", "image2"]),
        (("image", "hand_image", "image2"), "static", ["image", "image2"]),
        (("image", "hand_image", "image2"), "wrist", ["hand_image"]),
        (("image", "hand_image", "image2"), "other", ["image"]),
        (("rgb_static", "rgb_gripper"), "wrist", ["rgb_static"]),
        (("hand_image",), "static", ["hand_image"]),
    ],
)
def test_view_select(spark, names, mode, chosen):
    assert value(spark, n.view_select(views(*names), mode)) == chosen


def test_keys_and_names(spark):
    lit = F.lit
    assert value(spark, n.robot_frame_key(lit("viola"), lit("agentview_rgb"), lit(3), lit(12))) == (
        "viola_agentview_rgb_seq000003_000012"
    )
    assert value(spark, n.robot_frame_key(lit("viola"), lit(n.OWN_VIEW), lit(3), lit(12))) == "viola_seq000003_000012"
    name = n.shard_name(lit("imagenet"), lit(n.OWN_VIEW), lit("val"), lit(7), lit(False))
    assert value(spark, name) == "imagenet_val-000007-val.tar"
    assert value(spark, n.sample_key(lit("n01_2.a.b"))) == "n01_2"
    assert value(spark, n.member_column(lit("n01_2.a.b"))) == "a.b"
    assert value(spark, n.split_shard_name(lit("x-000001.tar"), lit("train"))) == "x-000001-train.tar"
    assert value(spark, n.target_names(lit("google/vit-huge"))) == ["google/vit-huge", "google/vit-huge_cls"]
    assert value(spark, n.target_names(lit("facebook/sam-vit-huge"))) == ["facebook/sam-vit-huge"]


@pytest.mark.parametrize(("start", "num", "expected"), [(0, -1, (0, 3)), (1500, -1, (1, 3)), (0, 2000, (0, 2)), (999, 2, (0, 2))])
def test_shard_range(spark, start, num, expected):
    first, end = n.shard_range(start, num, F.lit(2300))
    assert (value(spark, first), value(spark, end)) == expected


def test_registry_totals():
    robot = [r for r in registry_rows() if r[1] == "robot"]
    assert (len(robot), sum(r[3] for r in robot), sum(r[4] for r in robot), sum(len(r[5]) for r in robot)) == (
        69,
        5_885_382,
        105_305_295,
        103,
    )
    assert sum(r[4] for r in registry_rows() if r[1] != "robot") == 1_281_167 + 2_800_871 + 333_117 + 312_772


def test_last_registry_wins(spark):
    later = c.dataset_registry(spark).where("dataset = 'imagenet'").withColumn("steps", F.lit(5).cast("bigint"))
    both = c.dataset_registry(spark, later)
    assert both.count() == 73
    assert both.where("dataset = 'imagenet'").first()["steps"] == 5


def test_mix_sizes():
    assert {k: len(v) for k, v in NAMED_MIXES.items()} == {
        "bridge": 1,
        "rtx": 11,
        "rtx_franka": 29,
        "oxe_magic_soup": 25,
        "oxe_full": 52,
    }


def test_repeated_mix_entries(spark):
    mix = {r["dataset"]: r for r in c.mix_concat(c.mix_entries(spark, "rtx_franka")).collect()}
    assert len(mix) == 25
    assert all(mix[d]["weight"] == 1.0 for d in ("taco_play", "berkeley_cable_routing", "viola", "toto"))
    assert mix["taco_play"]["pos"] == 3


def test_mix_forms():
    assert resolve_mix(["a", "b"]) == [("a", 1.0), ("b", 1.0)]
    assert resolve_mix({"a": 2}) == [("a", 2.0)]
    for wrong in ("nope", 3, None):
        with pytest.raises(ValueError):
            resolve_mix(wrong)


def test_unknown_entries(spark):
    registry = c.dataset_registry(spark)
    for mix in ("bridge", "rtx", "rtx_franka", "oxe_full"):
        unknown = c.mix_unknown(c.mix_entries(spark, mix), registry).collect()
        assert [r["dataset"] for r in unknown] == ["bridge_dataset"]
    assert c.mix_unknown(c.mix_entries(spark, "oxe_magic_soup"), registry).count() == 0


def plan(spark, *rows):
    return spark.createDataFrame(rows, "dataset string, weight double, n bigint")


def test_mix_weights(spark):
    rows = c.mix_weights(plan(spark, ("a", 2.0, 100), ("b", 1.0, 300))).orderBy("dataset").collect()
    assert [r["weight"] for r in rows] == [0.4, 0.6] and rows[0]["expected"] == 500
    rows = c.mix_weights(plan(spark, ("a", 1.0, 15), ("b", 1.0, 1)), ratio=0.1).orderBy("dataset").collect()
    assert [r["weight"] for r in rows] == [2 / 3, 1 / 3] and rows[0]["expected"] == 3
    with pytest.raises(Exception, match="sum of dataset lengths is 0"):
        c.mix_weights(plan(spark, ("a", 2.0, 0), ("b", 1.0, 0))).collect()


def test_mix_plan_drops_empty_splits_and_levels_validation(spark):
    splits = spark.createDataFrame(
        [("viola", "train", 10), ("viola", "val", 2), ("toto", "train", 5), ("toto", "val", 0)],
        "dataset string, split string, n bigint",
    )
    mix = c.mix_entries(spark, {"viola": 3.0, "toto": 2.0})
    registry = c.dataset_registry(spark)
    train = c.mix_plan(mix, registry, splits, "train", []).orderBy("pos", "view").collect()
    assert [(r["dataset"], r["view"], r["weight"], r["n"]) for r in train] == [
        ("viola", "agentview_rgb", 3.0, 10),
        ("viola", "eye_in_hand_rgb", 3.0, 10),
        ("toto", "image", 2.0, 5),
    ]
    for split in ("val", "eval"):
        val = c.mix_plan(mix, registry, splits, split).collect()
        assert [(r["dataset"], r["weight"], r["n"]) for r in val] == [("viola", 1.0, 2)]


def test_mix_plan_refuses_unknown_datasets(spark):
    splits = spark.createDataFrame([("toto", "train", 10)], "dataset string, split string, n bigint")
    with pytest.raises(ValueError, match="bridge_dataset"):
        c.mix_plan(c.mix_entries(spark, "rtx"), c.dataset_registry(spark), splits, "train")


def test_worklist(spark):
    shards = spark.createDataFrame([("viola", 2), ("imagenet", 1), ("toto", 0)], "dataset string, n_shards bigint")
    work = c.extraction_worklist(c.dataset_registry(spark), c.target_models(spark), shards).collect()
    # Two views of two shards, one of one shard, five models each.
    assert len(work) == (2 * 2 + 1) * 5
    names = {r["shard"] for r in work}
    assert "viola_eye_in_hand_rgb_train-000001.tar" in names and "imagenet_train-000000-train.tar" in names
