"""Statistics, losses, meters and panels against numpy and hand-worked cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from featmill.operators import columns as j
from featmill.operators import losses, meters, panels, quality, stats


def tensors(spark, x, extra=()):
    rows = [(i, *[e[i] for e in extra], row.ravel().tolist()) for i, row in enumerate(x)]
    names = "key bigint" + "".join(f", e{k} string" for k in range(len(extra))) + ", x array<double>"
    return spark.createDataFrame(rows, names)


def test_channel_stats_and_merging(spark):
    x = np.random.default_rng(0).normal(1000, 0.01, size=(200, 3, 5))
    df = tensors(spark, x).withColumn("shard", F.expr("key div 30"))
    direct = {r["channel"]: r for r in stats.channel_stats(df, "x", 3, 5).collect()}
    merged = {r["channel"]: r for r in stats.merge_moments(stats.partial_moments(df, "x", 3, 5, ["shard"])).collect()}
    for c in range(3):
        for row in (direct[c], merged[c]):
            assert row["n"] == 1000
            assert row["mean"] == pytest.approx(x[:, c].mean(), rel=1e-12)
            assert row["std"] == pytest.approx(x[:, c].std(ddof=1), rel=1e-6)


def test_normalised_features_have_no_mean_and_unit_spread(spark):
    x = np.random.default_rng(1).normal(3, 2, size=(50, 4, 2))
    df = tensors(spark, x).select(F.lit("m").alias("model"), F.col("x").alias("embedding"))
    known = stats.channel_stats(df, "embedding", 2, 4, ["model"], tokens_first=True)
    normal = stats.normalize_features(df, known, 2, 4)
    for row in stats.channel_stats(normal, "embedding", 2, 4, tokens_first=True).collect():
        assert row["mean"] == pytest.approx(0, abs=1e-9) and row["std"] == pytest.approx(1)
    back = stats.denormalize_features(normal, known, 2, 4)
    np.testing.assert_allclose(
        sorted(sum((r["embedding"] for r in back.collect()), [])), np.sort(x.ravel()), rtol=1e-9
    )


def test_statistics_of_one_model(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 6.0],)], "embedding array<double>")
    known = spark.createDataFrame(
        [("m", 1, 2.0, 0.1), ("m", 0, 1.0, 2.0)], "model string, channel int, mean double, std double"
    )
    row = stats.normalize_model(df, known, "m", 2, 2).first()
    assert row["embedding"] == [0.0, 0.0, 1.0, 4.0 / 0.1]
    assert stats.normalize_model(df, known, "other", 2, 2).first()["embedding"] == [1.0, 2.0, 3.0, 6.0]
    with pytest.raises(ValueError):
        stats.normalize_model(df, known, "m", 3, 2)


def test_losses(spark):
    rng = np.random.default_rng(2)
    p, t = rng.normal(size=(2, 40, 6)) * 2
    models = [["a", "b"][i % 2] for i in range(40)]
    pred = tensors(spark, p, [models]).toDF("key", "model", "embedding")
    target = tensors(spark, t, [models]).toDF("key", "model", "embedding")
    per_model = losses.model_losses(losses.sample_losses(losses.pred_target_join(pred, target)))
    got = {r["model"]: r for r in per_model.collect()}
    want = {}
    for m in "ab":
        sel = [i for i in range(40) if models[i] == m]
        d = p[sel] - t[sel]
        cos = (p[sel] * t[sel]).sum(1) / np.linalg.norm(p[sel], axis=1) / np.linalg.norm(t[sel], axis=1)
        small = np.abs(d) < 1
        want[m] = ((d**2).mean(), (1 - cos).mean(), np.where(small, 0.5 * d**2, np.abs(d) - 0.5).mean())
        assert [got[m][k] for k in losses.LOSSES] == pytest.approx(want[m])
    both = losses.distill_losses(per_model).first()
    assert [both[k] for k in losses.LOSSES] == pytest.approx(np.mean([want["a"], want["b"]], axis=0))
    weighted = losses.distill_losses(per_model, {"a": 0.9, "b": 0.1}).first()
    assert weighted["mse"] == pytest.approx(0.9 * want["a"][0] + 0.1 * want["b"][0])
    assert weighted["cos"] == pytest.approx(both["cos"])


def test_loss_cases(spark):
    row = spark.range(1).select(
        losses.smooth_l1(F.lit(0.5)).alias("a"),
        losses.smooth_l1(F.lit(-2.0)).alias("b"),
        losses.main_loss("cos_l1", F.lit(9.0), F.lit(0.2), F.lit(0.5)).alias("c"),
        losses.main_loss(None, F.lit(9.0), F.lit(0.2), F.lit(0.5)).alias("d"),
    ).first()
    assert (row["a"], row["b"], row["d"]) == (0.125, 1.5, 9.0) and row["c"] == pytest.approx(0.23)
    with pytest.raises(ValueError):
        losses.main_loss("mae", F.lit(1.0), F.lit(1.0), F.lit(1.0))


def test_identical_and_zero_tensors(spark):
    df = spark.createDataFrame([(1, "m", [1.0, 2.0]), (2, "m", [0.0, 0.0])], "key int, model string, embedding array<double>")
    rows = {r["key"]: r for r in losses.sample_losses(losses.pred_target_join(df, df)).collect()}
    assert rows[1]["cos"] == pytest.approx(0) and rows[2]["cos"] == 1.0


def test_meters(spark):
    df = spark.createDataFrame([("m", 1, 1.0, 2), ("m", 2, 4.0, 1), ("o", 1, 5.0, 3)], "name string, step int, val double, n bigint")
    rows = {r["name"]: r for r in meters.meter_avg(df, ["name"]).collect()}
    assert (rows["m"]["sum"], rows["m"]["count"], rows["m"]["avg"]) == (6.0, 3, 2.0)
    running = meters.meter_running(df, ["name"], ["step"]).orderBy("name", "step").collect()
    assert [r["avg"] for r in running] == [1.0, 2.0, 5.0]
    workers = meters.meter_avg(df, ["name", "step"])
    merged = {r["name"]: r["avg"] for r in meters.meter_merge(workers, ["name"]).collect()}
    assert merged == {"m": 2.0, "o": 5.0}
    assert meters.meter_summary(meters.meter_avg(df, ["name"]), "none").first()["value"] is None
    with pytest.raises(ValueError):
        meters.meter_summary(df, "median")


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 4, 5)) @ np.diag([5, 4, 3, 0.2, 0.1]) + 7
    df = tensors(spark, x)
    rows = panels.token_rows(df, ["key"], "x", 5, 4)
    fit = panels.fit_pca(rows)
    flat = x.reshape(-1, 5)
    _, _, vt = np.linalg.svd(flat - flat.mean(0), full_matrices=False)
    for component, expected in zip(np.array(fit.components), vt[:3], strict=True):
        assert abs(component @ expected) == pytest.approx(1)
        assert component[np.abs(component).argmax()] > 0
    projected = panels.project(rows, fit).agg(*[F.avg(f"pc{i}").alias(str(i)) for i in (1, 2, 3)]).first()
    assert list(projected) == pytest.approx([0, 0, 0], abs=1e-9)
    rgb, same = panels.pca_rgb(df, ["key"], "x", 5, 4, threshold=0.0, fit=fit)
    assert same is fit
    out = rgb.collect()
    front = [r for r in out if r["pc1"] >= 0]
    assert all(r["r"] == r["g"] == r["b"] == 0 for r in out if r["pc1"] < 0) and len(front) < len(out)
    for c in "rgb":
        assert min(r[c] for r in front) == 0 and max(r[c] for r in front) == 1


def test_minmax_of_a_constant_is_black(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0)], "k int, v double")
    assert [r["v"] for r in panels.minmax_scale(df, ["v"]).collect()] == [0.0, 0.0]


def test_mask_overlay_sums_colours(spark):
    df = spark.createDataFrame([(1, 0, [1, 1, 0]), (1, 1, [0, 1, 0])], "image int, mask int, cells array<int>")
    rows = {r["pixel"]: r for r in panels.mask_overlay(df, "image", "mask", "cells").collect()}
    assert set(rows) == {0, 1}
    assert [rows[1][c] for c in "rgb"] == pytest.approx([60 / 255, 288 / 255, 2.0])


def test_merge_first_wins_and_clash(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, "f")], "key int, image string, feat string")
    b = spark.createDataFrame([(1, "y", "g"), (2, "z", "h"), (3, "q", "i")], "key int, image string, feat string")
    rows = j.merge_first_wins([a, b], ["key"]).orderBy("key").collect()
    assert [tuple(r) for r in rows] == [(1, "x", "g"), (2, "z", "f")]


def test_key_alignment_reports_each_side(spark):
    image = spark.createDataFrame([("s", "a.image"), ("s", "b.image"), ("s", "c.image")], "shard string, member string")
    feature = spark.createDataFrame([("s", "a.m.st"), ("s", "c.m.st")], "shard string, member string")
    rows = j.key_alignment(image, feature).orderBy("pos").collect()
    assert [(r["image_key"], r["feature_key"], r["aligned"]) for r in rows] == [
        ("a", "a", True),
        ("b", "c", False),
        ("c", None, False),
    ]


def test_panels_without_a_result_are_black(spark):
    images = spark.createDataFrame([(1, [1.0] * 4), (2, [2.0] * 4)], "k int, px array<double>")
    mask = spark.createDataFrame([(1, [5.0, 6.0, 7.0, 8.0])], "k int, px array<double>")
    rows = j.compare_panel(images, {"mask": mask}, "k", 2, 2, channels=1).orderBy("k").collect()
    assert rows[0]["px"] == [1, 1, 5, 6, 1, 1, 7, 8]
    assert rows[1]["px"] == [2, 2, 0, 0, 2, 2, 0, 0]


def test_unequal_null_and_unweighted_predictions_fail(spark):
    def scored(pred, target, weights=None):
        rows = spark.createDataFrame([("k", "m", pred, target)], "key string, model string, pred array<float>, target array<float>")
        return losses.distill_losses(losses.model_losses(losses.sample_losses(rows)), weights).first()

    assert scored([1.0, 2.0], [1.0, 4.0], {"m": 1.0})["mse"] == 2.0
    for pred, target in (([1.0], [1.0, 9.0]), ([1.0, 2.0], [1.0]), (None, [1.0]), ([1.0], None)):
        with pytest.raises(Exception, match="differ in size"):
            scored(pred, target)
    with pytest.raises(Exception, match="no weight for model m"):
        scored([1.0], [1.0], {"other": 1.0})


def test_differences_count_missing_and_misshapen_samples(spark):
    def rows(*values):
        return spark.createDataFrame(values, "k int, g string, embedding array<float>")

    stored = rows((1, "a", [1.0, 2.0]), (2, "b", [1.0]), (3, "c", None), (5, "e", [1.0, 1.0]))
    again = rows((1, "a", [1.0, 2.0]), (2, "b", [1.0, 2.0]), (3, "c", [1.0]), (4, "d", [1.0]), (5, "e", [1.0, 3.0]))
    got = {r.g: tuple(r)[1:] for r in quality.feature_diff(stored, again, ["k"], ["g"]).collect()}
    assert got == {
        "a": (0.0, 0.0, 0, 0, True), "b": (0.0, 0.0, 0, 1, False), "c": (0.0, 0.0, 1, 0, False),
        "d": (0.0, 0.0, 1, 0, False), "e": (2.0, 2.0, 0, 0, False),
    }


def test_constant_images_single_values_and_empty_meters(spark):
    df = spark.createDataFrame([([2.0, 2.0],)], "x array<float>")
    assert df.select(panels.minmax_image(F.col("x"))).first()[0] == [0.0, 0.0]
    one = spark.createDataFrame([(0, 1, 2.0, 0.0)], "channel int, n bigint, mean double, m2 double")
    assert stats.merge_moments(one).first()["std"] is None
    meter = spark.createDataFrame([("t", "m", "l", 1.0, 0)], "mode string, model string, loss string, val double, n int")
    assert meters.meter_avg(meter).first()["avg"] is None
    assert meters.meter_merge(meters.meter_avg(meter)).first()["avg"] is None


def test_co_moments_of_parts_are_those_of_the_whole(spark):
    """However rows are dealt out, with a large mean, nulls, empty tensors and several tokens a row."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 7, 4)) @ np.diag([3, 1, 0.1, 0.01]) + 1e6
    rows = [(v.ravel().tolist(),) for v in x] + [(None,), ([],)]
    flat = x.reshape(-1, 4)
    for parts in (1, 5, 40):
        df = spark.createDataFrame(rows, "t array<double>").repartition(parts)
        found = panels.co_moments(df, "t", 4)
        assert found.n == 630 and found.mean == pytest.approx(flat.mean(axis=0), rel=1e-14)
        away = flat - flat.mean(axis=0)
        assert found.c == pytest.approx(away.T @ away, rel=1e-6, abs=1e-5)
    assert panels.co_moments(df.where("false"), "t", 4) is None
    for bad in ([1.0, 2.0, 3.0], [1.0] * 9):
        with pytest.raises(Exception, match="channels"):
            panels.co_moments(spark.createDataFrame([(bad,)], "t array<double>"), "t", 4)
    with pytest.raises(ValueError, match="no vectors"):
        panels.fit_pca(df.where("false"), 2, "t", 4)


def test_a_fit_scans_once(spark, tmp_path):
    rng = np.random.default_rng(6)
    spark.createDataFrame([(v.tolist(),) for v in rng.normal(size=(50, 12))], "t array<float>").write.parquet(str(tmp_path / "t"))
    scanned = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            scanned.add(batch.num_rows)
            yield batch

    df = spark.read.parquet(str(tmp_path / "t")).mapInArrow(counted, "t array<float>")
    panels.fit_pca(df, 3, "t", 4)
    assert scanned.value == 50


def test_projection_of_wide_vectors(spark):
    rng = np.random.default_rng(0)
    width, values = 1024, rng.normal(size=(200, 1024))
    values[:, 7] *= 30
    df = spark.createDataFrame([(v.tolist(),) for v in values], "vector array<double>")
    fit = panels.fit_pca(df, 1)
    got = [r.pc1 for r in panels.project(df, fit).select("pc1").collect()]
    assert len(fit.mean) == width and np.argmax(np.abs(fit.components[0])) == 7
    assert np.allclose(sorted(got), sorted((values - values.mean(axis=0)) @ np.array(fit.components[0])))
