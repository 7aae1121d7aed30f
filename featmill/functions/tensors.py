"""Tensor functions over flat row-major ``array<float>`` columns, ``Column -> Column``.

Re-arrangements (transpose, resize, crop, slice, ...) all are one gather: the source position of every
output element is worked out once with numpy on an index tensor, becomes a literal array in the plan, and
``transform(index, i -> tensor[i])`` picks the elements inside the JVM. On 65,536-element tensors that
costs no more than the scan, where index arithmetic per element costs six times it.

A lambda evaluates whatever it refers to once per element. Tensors therefore enter lambdas through
:func:`bind`, which evaluates them once per row, however the optimizer has inlined them.

A null tensor stays null; a tensor of another size ends the job (:func:`sized`) instead of being misread.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

# Channel statistics of ImageNet images scaled to [0, 1] (fixed values).
IMAGENET_MEAN = (0.485, 0.456, 0.406)
IMAGENET_STD = (0.229, 0.224, 0.225)

# Norms below this are raised to it before dividing (fixed value).
L2_FLOOR = 1e-12


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column | str, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row; null for a null value."""
    return F.transform(F.array(_col(value)), lambda v: F.when(v.isNotNull(), body(v)))[0]


def int_array(values: np.ndarray) -> Column:
    """A literal ``array<int>``.

    Passed as one string, which constant folding turns into the array; element by element, the plan of a
    large tensor would take longer to build than to run.
    """
    return F.split(F.lit(",".join(map(str, np.ravel(values).tolist()))), ",").cast("array<int>")


def double_array(values: Sequence[float]) -> Column:
    """A literal ``array<double>``, passed the same way; the digits of ``repr`` give the exact values back."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def sized(value: Column | str, size: int, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` of a tensor with ``size`` elements; one of another size ends the job, a null one stays null."""

    def checked(t: Column) -> Column:
        said = F.concat(F.lit(f"a tensor of {size} elements was expected, not of "), F.size(t).cast("string"))
        return F.when(F.size(t) == size, body(t)).otherwise(F.raise_error(said))

    return bind(value, checked)


def gather(tensor: Column | str, index: np.ndarray, size: int) -> Column:
    """``out[k] = tensor[index[k]]`` for a static ``index`` into a tensor of ``size`` elements."""
    positions = int_array(index)
    return sized(tensor, size, lambda t: F.transform(positions, lambda i: t[i]))


def unroll(df: DataFrame, keys: Sequence, tensor: Column | str, pos: str = "pos", value: str = "value") -> DataFrame:
    """``(keys..., pos, value)``, one row per element.

    The outer form keeps the optimizer from adding a filter on the tensor's size, which would compute the
    tensor a second time.
    """
    rows = df.select(*keys, F.posexplode_outer(_col(tensor)).alias(pos, value))
    return rows.where(F.col(pos).isNotNull())


def grid(*shape: int) -> np.ndarray:
    """Positions 0..n-1 arranged as a tensor of ``shape``."""
    return np.arange(math.prod(shape), dtype=np.int64).reshape(shape)


# ---- layout -----------------------------------------------------------------------------------------


def chw_to_tokens(tensor, c: int, h: int, w: int) -> Column:
    """``[c, h, w]`` to ``[h*w, c]``."""
    return gather(tensor, grid(c, h * w).T, c * h * w)


def tokens_to_chw(tokens, c: int, n_tokens: int) -> Column:
    """``[n_tokens, c]`` of a square grid to ``[c, h, w]``."""
    side = math.isqrt(n_tokens)
    if side * side != n_tokens:
        raise ValueError(f"{n_tokens} tokens do not form a square grid")
    return gather(tokens, grid(n_tokens, c).T, n_tokens * c)


def history_permute(obs, t: int, h: int, w: int, c: int) -> Column:
    """``[t, h, w, c]`` to ``[c*t, h, w]`` with the channel varying slowest."""
    return gather(obs, grid(t, h, w, c).transpose(3, 0, 1, 2), t * h * w * c)


def _nearest(n_in: int, n_out: int) -> np.ndarray:
    return np.arange(n_out) * n_in // n_out


def resize_nearest(tensor, c: int, h: int, w: int, out_h: int, out_w: int) -> Column:
    """Nearest-neighbour spatial resize; source row and column are ``floor(dst * in / out)``."""
    rows, cols = _nearest(h, out_h), _nearest(w, out_w)
    return gather(tensor, grid(c, h, w)[:, rows][:, :, cols], c * h * w)


def block_upscale(image, h: int, w: int, channels: int, out: int = 224) -> Column:
    """Repeat every cell of ``[h, w, channels]`` ``out // h`` times both ways; uncovered border cells are 0."""
    factor = out // h
    index = np.full((out, out, channels), -1)
    index[: factor * h, : factor * w] = grid(h, w, channels).repeat(factor, 0).repeat(factor, 1)
    size = h * w * channels
    if (index >= 0).all():
        return gather(image, index, size)
    padded = F.concat(_col(image), F.array(F.lit(0.0).cast("float")))
    return gather(padded, np.where(index < 0, size, index), size + 1)


def center_crop(tensor, c: int, h: int, w: int, k: int) -> Column:
    """The ``k`` by ``k`` window in the middle of ``[c, h, w]``."""
    top, left = round((h - k) / 2), round((w - k) / 2)
    return gather(tensor, grid(c, h, w)[:, top : top + k, left : left + k], c * h * w)


# ---- pixels -----------------------------------------------------------------------------------------


def gray_to_rgb(px, n_pixels: int) -> Column:
    """``[n]`` to ``[n, 3]``."""
    return gather(px, grid(n_pixels).repeat(3), n_pixels)


def drop_alpha(px, n_pixels: int) -> Column:
    """``[n, 4]`` to ``[n, 3]``."""
    return gather(px, grid(n_pixels, 4)[:, :3], 4 * n_pixels)


def image_normalize(px, n_pixels: int, mean=IMAGENET_MEAN, std=IMAGENET_STD, scale: float = 255.0) -> Column:
    """Interleaved ``[n, 3]`` pixel values to ``(x / scale - mean) / std`` per channel."""
    if len(mean) != len(std):
        raise ValueError("mean and std differ in length")
    means, stds = (F.array(*[F.lit(float(v)) for v in values]) for values in (mean, std))
    scaled = F.transform(_col(px), lambda x: x.cast("double") / scale)
    return feature_normalize(scaled, means, stds, len(mean), n_pixels)


def image_to_float(px) -> Column:
    """Pixel values as doubles, neither scaled nor normalised."""
    return F.transform(_col(px), lambda x: x.cast("double"))


# ---- statistics applied to features --------------------------------------------------------------------


def _channels(n_tokens: int, c: int, tokens_first: bool) -> Column:
    """Channel of every element of a feature, as a literal array."""
    return int_array(np.tile(np.arange(c), n_tokens) if tokens_first else np.arange(c).repeat(n_tokens))


def feature_normalize(x, mean, std, c: int, n_tokens: int, tokens_first: bool = True) -> Column:
    """``(x - mean) / std`` per channel; unchanged when either array is null.

    ``mean`` and ``std`` are length-``c`` arrays: literals, or columns of the row. A spread of 0 counts as 1, so a
    channel that is the same everywhere becomes 0. A tensor or array of another length ends the job.
    """
    mean, std = _col(mean), _col(std)
    channels = _channels(n_tokens, c, tokens_first)

    def scale(v: Column, k: Column) -> Column:
        return (v.cast("double") - mean[k]) / F.when(std[k] == 0, 1.0).otherwise(std[k])

    def apply(t: Column) -> Column:
        plain = F.transform(t, lambda v: v.cast("double"))
        return F.when(mean.isNull() | std.isNull(), plain).otherwise(_same_length(F.zip_with(t, channels, scale), c, mean, std))

    return sized(x, c * n_tokens, apply)


def _same_length(value: Column, c: int, *arrays: Column) -> Column:
    """``value``, unless one of the arrays has not ``c`` elements, which ends the job; null arrays are left alone."""
    other = F.lit(False)
    for a in arrays:
        other = other | F.coalesce(F.size(a) != c, F.lit(False))
    return F.when(other, F.raise_error(F.lit(f"statistics of {c} channels were expected"))).otherwise(value)


def feature_denormalize(x, mean, std, c: int, n_tokens: int, tokens_first: bool = True) -> Column:
    """``x * std + mean`` per channel; a null array leaves its step out. Other lengths end the job."""
    mean, std = _col(mean), _col(std)
    channels = _channels(n_tokens, c, tokens_first)

    def undo(v: Column, k: Column) -> Column:
        return v.cast("double") * F.coalesce(std[k], F.lit(1.0)) + F.coalesce(mean[k], F.lit(0.0))

    return sized(x, c * n_tokens, lambda t: _same_length(F.zip_with(t, channels, undo), c, mean, std))


# ---- token selection and pooling -----------------------------------------------------------------------


def pool_cls(tokens, c: int) -> Column:
    """Token 0."""
    return F.slice(_col(tokens), 1, c)


def pool_spatial(tokens, c: int, n_tokens: int, discard: int = 0) -> Column:
    """All tokens but the first and the last ``discard``."""
    return sized(tokens, c * n_tokens, lambda t: F.slice(t, c + 1, c * (n_tokens - 1 - discard)))


def _per_channel(tokens, c: int, n_tokens: int, discard: int, reduce) -> Column:
    """``reduce`` over the spatial tokens of every channel."""
    used = n_tokens - 1 - discard
    by_channel = gather(tokens, grid(n_tokens, c)[1 : n_tokens - discard].T, n_tokens * c)
    starts = int_array(np.arange(c) * used + 1)
    return bind(by_channel, lambda rows: F.transform(starts, lambda s: reduce(F.slice(rows, s, used))))


def pool_mean(tokens, c: int, n_tokens: int, discard: int = 0) -> Column:
    """Mean over the spatial tokens, one value per channel."""
    used = n_tokens - 1 - discard
    return _per_channel(
        tokens,
        c,
        n_tokens,
        discard,
        lambda part: F.aggregate(part, F.lit(0.0), lambda acc, v: acc + v.cast("double")) / used,
    )


def pool_max(tokens, c: int, n_tokens: int, discard: int = 0) -> Column:
    """Maximum over the spatial tokens, one value per channel."""
    return _per_channel(tokens, c, n_tokens, discard, F.array_max)


def reduce_tokens(tokens, method: str | None, c: int, n_tokens: int, discard: int = 0) -> Column:
    """Token selection by name: mean_pooling, max_pooling, cls, identity, or None for the spatial tokens."""
    if method is None:
        return pool_spatial(tokens, c, n_tokens, discard)
    if method == "identity":
        return _col(tokens)
    if method == "cls":
        return pool_cls(tokens, c)
    if method == "mean_pooling":
        return pool_mean(tokens, c, n_tokens, discard)
    if method == "max_pooling":
        return pool_max(tokens, c, n_tokens, discard)
    raise NotImplementedError(f"token reduction {method!r}")


def concat_models(tokens: Sequence, channels: Sequence[int], n_tokens: int) -> Column:
    """Per token, the channels of all models side by side."""
    joined = F.concat(*[sized(t, c * n_tokens, lambda v: v) for t, c in zip(tokens, channels, strict=True)])
    starts = np.cumsum([0] + [c * n_tokens for c in channels[:-1]])
    blocks = [start + grid(n_tokens, c) for start, c in zip(starts, channels, strict=True)]
    return gather(joined, np.concatenate(blocks, axis=1), sum(channels) * n_tokens)


def obs_split(obs, k: int) -> tuple[Column, Column]:
    """Visual part and the last ``k`` proprioceptive values; ``k`` may be 0."""
    obs = _col(obs)
    n = F.size(obs)
    return F.slice(obs, F.lit(1), n - k), F.slice(obs, n - k + 1, F.lit(k))


# ---- values --------------------------------------------------------------------------------------------


def clip_symmetric(x: Column, limit: Column | float | None) -> Column:
    """Clamp a value to ``[-limit, limit]``; a null limit leaves it alone."""
    if limit is None:
        return x
    limit = limit if isinstance(limit, Column) else F.lit(float(limit))
    return F.when(limit.isNull(), x).otherwise(F.greatest(-limit, F.least(limit, x)))


def sum_of_squares(tensor) -> Column:
    return F.aggregate(
        _col(tensor), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")
    )


def l2_normalize(tensor) -> Column:
    """The flat tensor divided by its L2 norm."""

    def divide(t: Column) -> Column:
        norm = F.greatest(F.sqrt(sum_of_squares(t)), F.lit(L2_FLOOR))
        return bind(norm, lambda n: F.transform(t, lambda v: v.cast("double") / n))

    return bind(tensor, divide)


def foreground_mask(first_component: Column, values: Column, threshold: float = -100.0) -> Column:
    """Values of background positions (first component below ``threshold``) become 0."""
    return F.when(first_component < threshold, F.lit(0.0)).otherwise(values)


def bf16_bits(values: np.ndarray) -> np.ndarray:
    """float32 to bfloat16 bit patterns, rounding to nearest, ties to even; NaN stays NaN."""
    bits = np.ascontiguousarray(values, dtype=np.float32).view(np.uint32)
    rounded = (bits + np.uint32(0x7FFF) + ((bits >> 16) & np.uint32(1))) >> 16
    return np.where(np.isnan(values), np.uint32(0x7FC0), rounded).astype(np.uint16)


def bf16_values(bits: np.ndarray) -> np.ndarray:
    """bfloat16 bit patterns to float32."""
    return (bits.astype(np.uint32) << 16).view(np.float32)


@F.arrow_udf(ArrayType(FloatType()))
def bf16_round(tensor: pa.Array) -> pa.Array:
    """Round every element to the nearest bfloat16 value, all tensors of an Arrow batch at once."""
    flat = tensor.values.cast(pa.float32())
    rounded = bf16_values(bf16_bits(flat.to_numpy(zero_copy_only=False)))
    values = pa.array(rounded, pa.float32(), mask=flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else None)
    return pa.ListArray.from_arrays(tensor.offsets, values, mask=tensor.is_null() if tensor.null_count else None)
