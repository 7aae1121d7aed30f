"""Inspection panels: projection to RGB, scaling, masks, stacking."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmill.functions.hashing import seeded_uniform
from featmill.functions.tensors import bind, double_array, foreground_mask, int_array, sized, unroll

# Colour of a mask drawn without a random colour (fixed values).
MASK_COLOR = (30 / 255, 144 / 255, 255 / 255)


@dataclass(frozen=True)
class Projection:
    """A fitted projection: channel means and one row of loadings per component."""

    mean: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]


def token_rows(df: DataFrame, keys: Sequence[str], tokens: str, c: int, n_tokens: int) -> DataFrame:
    """One row per token: ``(keys..., token, vector)`` with ``vector`` the token's ``c`` channels."""
    starts = int_array(np.arange(n_tokens) * c + 1)
    vectors = bind(tokens, lambda t: F.transform(starts, lambda s: F.slice(t, s, c)))
    return unroll(df, keys, vectors, "token", "vector")


# Bytes of co-moment matrices that a fit may shuffle; it decides how many tasks read the tokens.
MOMENT_BYTES = 16 << 30


@dataclass
class CoMoments:
    """Number of vectors, their mean, and the sum of products of their deviations; mergeable."""

    n: int
    mean: np.ndarray
    c: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> CoMoments:
        mean = rows.mean(axis=0)
        away = rows - mean
        return cls(len(rows), mean, away.T @ away)

    def merged(self, other: CoMoments) -> CoMoments:
        if len(self.mean) != len(other.mean):
            raise ValueError(f"vectors of {len(self.mean)} and of {len(other.mean)} channels")
        n, gap = self.n + other.n, other.mean - self.mean
        self.c += other.c
        self.c += np.outer(gap, gap) * (self.n * other.n / n)
        return CoMoments(n, self.mean + gap * (other.n / n), self.c)


def co_moments(df: DataFrame, tokens: str, c: int | None = None) -> CoMoments | None:
    """Co-moments of all token vectors, from one scan; None without any.

    ``tokens`` holds flat tensors ``[n_tokens, c]`` of any number of tokens, or one vector a row where ``c`` is not given. A null is
    passed over; a tensor that is no multiple of ``c``, or vectors of several lengths, end the job. Each task adds up one
    matrix while its rows pass by; matrices meet in about the square root of their number of tasks and then in one, one
    at a time.
    """
    spark = df.sparkSession
    width = c

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            # Any null ones are passed over by taking values through the offsets of the others.
            column = batch.column(0).drop_null()
            sizes = np.diff(column.offsets.to_numpy())
            if not len(sizes):
                continue
            most = width or int(sizes.max())
            if (sizes % most).any() or (width is None and (sizes != most).any()):
                raise ValueError(f"tensors of sizes {sorted(set(sizes.tolist()))[:5]} for {most} channels")
            rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, most)
            if len(rows):
                total = CoMoments.of(rows) if total is None else total.merged(CoMoments.of(rows))
        if total is not None:
            yield _moment_batch(total)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for n, mean, products in zip(*(batch.column(k) for k in range(3)), strict=True):
                mean = np.frombuffer(mean.as_py())
                part = CoMoments(n.as_py(), mean, np.frombuffer(products.as_py()).reshape(len(mean), -1).copy())
                total = part if total is None else total.merged(part)
        if total is not None:
            yield _moment_batch(total)

    kind = "n bigint, mean binary, products binary"
    side = 8 * (c or 1) ** 2
    tasks = max(spark.sparkContext.defaultParallelism, MOMENT_BYTES // side)
    parts = df.select(tokens).coalesce(int(min(tasks, 1 << 20))).mapInArrow(add, kind)
    middle = max(1, math.isqrt(spark.sparkContext.defaultParallelism))
    found = parts.repartition(middle).mapInArrow(meet, kind).repartition(1).mapInArrow(meet, kind).collect()
    if not found:
        return None
    mean = np.frombuffer(found[0]["mean"])
    return CoMoments(found[0]["n"], mean, np.frombuffer(found[0]["products"]).reshape(len(mean), -1))


def _moment_batch(total: CoMoments) -> pa.RecordBatch:
    columns = [pa.array([total.n], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (total.mean, total.c)]]
    return pa.RecordBatch.from_arrays(columns, names=["n", "mean", "products"])


def principal(moments: CoMoments, k: int = 3) -> Projection:
    """The ``k`` directions of greatest variance. Each one's sign is fixed by making its largest loading positive."""
    values, vectors = np.linalg.eigh(moments.c)
    loadings = vectors[:, np.argsort(-values, kind="stable")[:k]]
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])])
    return Projection(tuple(map(float, moments.mean)), tuple(tuple(map(float, row)) for row in (loadings * signs).T))


def fit_pca(tokens: DataFrame, k: int = 3, column: str = "vector", c: int | None = None) -> Projection:
    """Fit ``k`` components on all token vectors, in one scan; see :func:`co_moments`.

    One matrix of ``c`` by ``c`` reaches the driver. Without any vector there is nothing to fit, an error.
    """
    moments = co_moments(tokens, column, c)
    if moments is None:
        raise ValueError("no vectors to fit")
    return principal(moments, k)


def project(tokens: DataFrame, fit: Projection) -> DataFrame:
    """Centre and project token vectors; adds ``pc1``, ``pc2``, ... A vector of another length ends the job."""
    mean = double_array(fit.mean)

    def component(row: Sequence[float]) -> Column:
        loadings = double_array(row)

        def along(v: Column) -> Column:
            centred = F.zip_with(v, mean, lambda x, m: x.cast("double") - m)
            return F.aggregate(F.zip_with(centred, loadings, lambda x, a: x * a), F.lit(0.0), lambda acc, x: acc + x)

        return sized("vector", len(row), along)

    return tokens.select("*", *[component(row).alias(f"pc{i}") for i, row in enumerate(fit.components, start=1)])


def minmax_scale(df: DataFrame, columns: Sequence[str], keep: Column | None = None) -> DataFrame:
    """Scale columns to [0, 1] over all rows, or over the rows where ``keep`` holds; the others become 0.

    All extremes come from one aggregation, used as a scalar subquery. A constant column becomes 0.
    """
    inside = F.lit(True) if keep is None else keep
    extremes = F.struct(*[f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))])
    # As a column of its own the subquery is planned once, not once per use.
    bounded = df.withColumn("_bounds", df.where(inside).agg(extremes.alias("bounds")).scalar())
    scaled = {}
    for c in columns:
        low, high = F.col(f"_bounds.lo_{c}"), F.col(f"_bounds.hi_{c}")
        share = F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(F.lit(0.0))
        scaled[c] = F.when(inside, share).otherwise(F.lit(0.0))
    return bounded.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def minmax_image(values: Column) -> Column:
    """Scale one image's values to [0, 1]; a constant image becomes 0."""

    def scale(v: Column) -> Column:
        ends = F.struct(F.array_min(v).cast("double").alias("lo"), F.array_max(v).cast("double").alias("hi"))
        return bind(ends, lambda e: F.transform(v, lambda x: share(x.cast("double"), e["lo"], e["hi"])))

    def share(x: Column, low: Column, high: Column) -> Column:
        return F.when(high > low, (x - low) / (high - low)).otherwise(F.when(x.isNotNull(), 0.0))

    return bind(values, scale)


def pca_rgb(
    df: DataFrame,
    keys: Sequence[str],
    tokens: str,
    c: int,
    n_tokens: int,
    threshold: float = -100.0,
    fit: Projection | None = None,
) -> tuple[DataFrame, Projection]:
    """Three components per token as colours in [0, 1], and the fit used.

    Tokens whose first component is below ``threshold`` are background and black; the others are scaled
    per component over the whole foreground.
    """
    # Whole tensors are fitted as they are; only the projection takes tokens apart.
    fit = fit or fit_pca(df, 3, tokens, c)
    rows = token_rows(df, keys, tokens, c, n_tokens)
    projected = project(rows, fit).drop("vector")
    scaled = minmax_scale(
        projected.withColumns({"r": F.col("pc1"), "g": F.col("pc2"), "b": F.col("pc3")}),
        ["r", "g", "b"],
        F.col("pc1") >= threshold,
    )
    return scaled, fit


def apply_foreground(projected: DataFrame, threshold: float = -100.0) -> DataFrame:
    """Zero the components of background tokens."""
    names = [c for c in projected.columns if c.startswith("pc")]
    first = F.col("pc1")
    return projected.select(
        *[c for c in projected.columns if c not in names],
        *[foreground_mask(first, F.col(c), threshold).alias(c) for c in names],
    )


def mask_filter(masks: DataFrame, pred_iou_thresh: float = 0.5, stability_score_thresh: float = 0.6) -> DataFrame:
    """Masks above both quality thresholds."""
    return masks.where((F.col("iou") > pred_iou_thresh) & (F.col("stability") > stability_score_thresh))


def mask_overlay(masks: DataFrame, image: str, mask: str, cells: str, seed: int | None = None) -> DataFrame:
    """Summed colour per pixel, ``(image, pixel, r, g, b)``, of masks given as arrays of 0/1 cells.

    Pixels no mask covers are left out (black). With ``seed`` every mask gets its own colour, else all
    share the fixed one. Only covered pixels leave the map side, already summed there.
    """
    if seed is None:
        color = [F.lit(v) for v in MASK_COLOR]
    else:
        color = [seeded_uniform(seed, F.col(image), F.col(mask), F.lit(channel)) for channel in "rgb"]
    painted = masks.select(image, *[v.alias(n) for v, n in zip(color, "rgb", strict=True)], cells)
    pixels = unroll(painted, [image, "r", "g", "b"], cells, "pixel", "_on").where("_on > 0")
    return pixels.groupBy(image, "pixel").agg(*[F.sum(n).alias(n) for n in "rgb"])


def _tagged_union(parts: Mapping[str, DataFrame], tag: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn(tag, F.lit(name)) for name, df in parts.items()])


def panel_stack(panels: Mapping[str, DataFrame]) -> DataFrame:
    """Panels of several sources, such as prediction and truth, under a ``source`` column."""
    return _tagged_union(panels, "source")


def dataset_union(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Samples of several datasets, with the same columns in any order, under a ``dataset`` column."""
    return _tagged_union(parts, "dataset")
