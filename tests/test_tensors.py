"""Tensor functions against numpy, hand-worked cases and identities."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays
from pyspark.sql import functions as F

from featmill.functions import tensors as t


def one(spark, values, column, kind="array<float>"):
    df = spark.createDataFrame([(values,)], f"x {kind}")
    return df.select(column.alias("y")).first()["y"]


def seq(n):
    return [float(i) for i in range(n)]


def test_layouts(spark):
    chw = np.arange(3 * 4 * 4, dtype=float).reshape(3, 4, 4)
    tokens = one(spark, chw.ravel().tolist(), t.chw_to_tokens("x", 3, 4, 4))
    assert tokens == chw.reshape(3, 16).T.ravel().tolist()
    assert one(spark, tokens, t.tokens_to_chw("x", 3, 16)) == chw.ravel().tolist()
    thwc = np.arange(2 * 3 * 4 * 5, dtype=float).reshape(2, 3, 4, 5)
    expected = np.einsum("thwc->cthw", thwc).ravel().tolist()
    assert one(spark, thwc.ravel().tolist(), t.history_permute("x", 2, 3, 4, 5)) == expected


def test_not_a_square(spark):
    with pytest.raises(ValueError):
        t.tokens_to_chw("x", 3, 15)


def test_resize(spark):
    assert one(spark, [1.0, 2.0], t.resize_nearest("x", 1, 1, 2, 1, 4)) == [1.0, 1.0, 2.0, 2.0]
    up = one(spark, seq(16), t.resize_nearest("x", 1, 4, 4, 8, 8))
    assert up == np.arange(16.0).reshape(4, 4).repeat(2, 0).repeat(2, 1).ravel().tolist()
    assert one(spark, up, t.resize_nearest("x", 1, 8, 8, 4, 4)) == seq(16)


def test_block_upscale_leaves_the_rest_black(spark):
    out = np.array(one(spark, seq(9), t.block_upscale("x", 3, 3, 1, out=7))).reshape(7, 7)
    assert out[:6, :6].tolist() == np.arange(9.0).reshape(3, 3).repeat(2, 0).repeat(2, 1).tolist()
    assert not out[6:].any() and not out[:, 6:].any()


def test_center_crop(spark):
    assert one(spark, seq(25), t.center_crop("x", 1, 5, 5, 3)) == [6, 7, 8, 11, 12, 13, 16, 17, 18]
    assert one(spark, seq(16), t.center_crop("x", 1, 4, 4, 4)) == seq(16)


def test_pooling(spark):
    tokens = [9.0, 1.0, 2.0, 6.0]
    assert one(spark, tokens, t.reduce_tokens("x", "mean_pooling", 1, 4, 1)) == [1.5]
    assert one(spark, tokens, t.reduce_tokens("x", "max_pooling", 1, 4, 1)) == [2.0]
    assert one(spark, tokens, t.reduce_tokens("x", "cls", 1, 4, 1)) == [9.0]
    assert one(spark, tokens, t.reduce_tokens("x", "identity", 1, 4, 1)) == tokens
    assert one(spark, tokens, t.reduce_tokens("x", None, 1, 4, 1)) == [1.0, 2.0]
    with pytest.raises(NotImplementedError):
        t.reduce_tokens("x", "median", 1, 4)


def test_pooling_per_channel(spark):
    x = np.random.default_rng(0).normal(size=(6, 3))
    got = one(spark, x.ravel().tolist(), t.pool_mean("x", 3, 6, 2), "array<double>")
    np.testing.assert_allclose(got, x[1:4].mean(axis=0))
    got = one(spark, x.ravel().tolist(), t.pool_max("x", 3, 6, 2), "array<double>")
    np.testing.assert_allclose(got, x[1:4].max(axis=0))


def test_denormalize_cases(spark):
    x, mean, std = F.array(F.lit(2.0)), F.array(F.lit(1.0)), F.array(F.lit(3.0))
    none = F.lit(None).cast("array<double>")
    for m, s, expected in ((mean, std, 7.0), (none, std, 6.0), (mean, none, 3.0), (none, none, 2.0)):
        assert one(spark, [0.0], t.feature_denormalize(x, m, s, 1, 1)) == [expected]
    assert one(spark, [0.0], t.feature_normalize(x, mean, none, 1, 1)) == [2.0]
    assert one(spark, [0.0], t.feature_normalize(x, none, std, 1, 1)) == [2.0]


def test_denormalize_undoes_normalize(spark):
    x = np.random.default_rng(1).normal(size=(4, 3))
    mean, std = (F.array(*[F.lit(float(v)) for v in row]) for row in ([1.0, -2.0, 0.5], [2.0, 3.0, 0.1]))
    there = t.feature_normalize("x", mean, std, 3, 4)
    back = t.feature_denormalize(there, mean, std, 3, 4)
    np.testing.assert_allclose(one(spark, x.ravel().tolist(), back, "array<double>"), x.ravel())
    first = t.feature_normalize("x", mean, std, 3, 4, tokens_first=False)
    expected = (x.T.reshape(3, 4) - [[1.0], [-2.0], [0.5]]) / [[2.0], [3.0], [0.1]]
    np.testing.assert_allclose(one(spark, x.T.ravel().tolist(), first, "array<double>"), expected.ravel())


def test_image_normalize(spark):
    px = [0, 128, 255, 10, 20, 30]
    got = one(spark, px, t.image_normalize("x", 2), "array<int>")
    want = (np.array(px).reshape(2, 3) / 255 - t.IMAGENET_MEAN) / t.IMAGENET_STD
    np.testing.assert_allclose(got, want.ravel())


def test_obs_split_with_and_without_proprioception(spark):
    visual, proprio = t.obs_split("x", 2)
    assert one(spark, seq(5), F.struct(visual.alias("a"), proprio.alias("b"))) == ([0, 1, 2], [3, 4])
    visual, proprio = t.obs_split("x", 0)
    assert one(spark, seq(5), F.struct(visual.alias("a"), proprio.alias("b"))) == (seq(5), [])


def test_l2_normalize_of_zeros(spark):
    assert one(spark, [3.0, 4.0], t.l2_normalize("x")) == [0.6, 0.8]
    assert one(spark, [0.0, 0.0], t.l2_normalize("x")) == [0.0, 0.0]


def test_null_stays_null_and_a_wrong_size_fails(spark):
    assert one(spark, None, t.chw_to_tokens("x", 1, 2, 2)) is None
    assert one(spark, None, t.pool_mean("x", 1, 4)) is None
    with pytest.raises(Exception, match="4 elements was expected"):
        one(spark, [1.0, 2.0], t.chw_to_tokens("x", 1, 2, 2))


@pytest.mark.parametrize(
    "apply",
    [
        lambda: t.chw_to_tokens("x", 1, 2, 2),
        lambda: t.center_crop("x", 1, 2, 2, 1),
        lambda: t.pool_spatial("x", 1, 4),
        lambda: t.pool_mean("x", 1, 4),
        lambda: t.block_upscale("x", 2, 2, 1, 5),
        lambda: t.concat_models(["x", "x"], [1, 1], 4),
        lambda: t.feature_normalize("x", F.array(F.lit(0.0)), F.array(F.lit(1.0)), 1, 4),
        lambda: t.feature_denormalize("x", F.array(F.lit(0.0)), F.lit(None).cast("array<double>"), 1, 4),
    ],
)
@pytest.mark.parametrize("n", [3, 5])
def test_shorter_and_larger_tensors_fail(spark, apply, n):
    with pytest.raises(Exception, match="elements was expected"):
        one(spark, [1.0] * n, apply())


def test_statistics_of_another_length_fail_and_a_zero_spread_counts_as_one(spark):
    stats = [F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(0.0), F.lit(0.5))]
    assert one(spark, [1.0, 2.0, 3.0, 4.0], t.feature_normalize("x", *stats, 2, 2)) == [0.0, 0.0, 2.0, 4.0]
    with pytest.raises(Exception, match="statistics of 1 channels"):
        one(spark, [1.0, 2.0, 3.0, 4.0], t.feature_normalize("x", *stats, 1, 4))


def test_bf16_special_values(spark):
    x = [1.0, -0.0, float("inf"), float("-inf"), 1.00390625, 1.01171875, 3.4e38, 1e-40]
    got = one(spark, x, t.bf16_round("x"))
    # 1 + 1/256 lies half way between two values and goes to the even one, as does 1 + 3/256.
    assert got[:6] == [1.0, -0.0, float("inf"), float("-inf"), 1.0, 1.015625]
    assert got[6] == float("inf") or got[6] < 3.4e38
    assert np.isnan(t.bf16_values(t.bf16_bits(np.array([np.nan], dtype=np.float32)))).all()


@settings(max_examples=200, deadline=None)
@given(arrays(np.float32, 16, elements=st.floats(-(2.0**100), 2.0**100, width=32)))
def test_bf16_rounds_to_the_nearest_value(x):
    low = t.bf16_values((x.view(np.uint32) >> 16).astype(np.uint16))
    high = t.bf16_values(((x.view(np.uint32) >> 16) + 1).astype(np.uint16))
    got = t.bf16_values(t.bf16_bits(x)).astype(np.float64)
    wide = x.astype(np.float64)
    best = np.minimum(np.abs(wide - low), np.abs(wide - high.astype(np.float64)))
    assert (np.abs(wide - got) == best).all()


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 5), st.integers(1, 6), st.integers(1, 6), st.integers(1, 9), st.integers(1, 9))
def test_resize_index(c, h, w, out_h, out_w):
    """The gather index equals picking rows and columns one by one."""
    rows, cols = t._nearest(h, out_h), t._nearest(w, out_w)
    x = t.grid(c, h, w)
    for y in range(out_h):
        for z in range(out_w):
            assert (x[:, rows][:, :, cols][:, y, z] == x[:, int(y * h / out_h), int(z * w / out_w)]).all()
