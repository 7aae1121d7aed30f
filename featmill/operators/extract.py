"""Batch feature extraction through a user model, user transforms, and batch collation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from featmill.functions.tensors import resize_nearest

# Tensors that an extractor of each model family has to return (fixed values).
OUTPUTS = {
    "google_vit": ("cls_token", "embedding"),
    "facebook_sam": ("embedding",),
    "openai_clip": ("embedding", "cls_token", "pooled_cls_token"),
    "facebook_dinov2": ("embedding", "cls_token", "pooled_cls_token"),
    "llava": ("embedding",),
    "depth-anything": ("embedding",),
}
# Side length to which a model family's embedding is resized; None keeps it (fixed values).
# SAM stores its own size and, under "<model>_32", a 32 by 32 copy.
STORED_SIZE = {"facebook_sam": (None, 32), "depth-anything": (64,)}


def model_family(model: str) -> str:
    """Family of a file-system model name; unknown models are an error."""
    for family in OUTPUTS:
        if family in model:
            return family
    raise NotImplementedError(f"model {model} is not supported")


def outputs_of(model: str) -> tuple[str, ...]:
    """Tensors that a model, by its file-system name, has to return; a model of no known family returns its embedding."""
    try:
        return OUTPUTS[model_family(model)]
    except NotImplementedError:
        return ("embedding",)


def stored_sets(model: str, c: int, h: int, w: int) -> dict[str, tuple[int, int, int]]:
    """``{name: [c, h, w]}`` of the feature sets stored for a model; the first is the model's own."""
    try:
        sides = STORED_SIZE.get(model_family(model), (None,))
    except NotImplementedError:
        sides = (None,)
    return {
        model if side is None or len(sides) == 1 else f"{model}_{side}": (c, h, w) if side is None else (c, side, side)
        for side in sides
    }


def extract_tensors(
    df: DataFrame,
    image: str,
    make_model: Callable[[], Callable[[np.ndarray], Mapping[str, np.ndarray]]],
    input_shape: Sequence[int],
    outputs: Sequence[str],
    tensors: str = "tensors",
    batch_size: int = 8,
) -> DataFrame:
    """Run a user model once over every sample; adds the struct ``tensors`` with one flat array for each of ``outputs``.

    ``make_model`` is called once per Python worker and returns a function from a stacked batch ``[b, *input_shape]`` to named
    tensors ``[b, ...]``, or to one tensor where there is one output. A model that returns other names than
    ``outputs``, or a tensor of another number of samples, ends the job.
    """
    names = list(outputs)

    def make_predict():
        model = make_model()

        def predict(images: np.ndarray) -> dict[str, np.ndarray]:
            found = model(images)
            if not isinstance(found, Mapping):
                found = {names[0]: found} if len(names) == 1 else {}
            if set(found) != set(names):
                raise ValueError(f"the model has to return {names}, not {sorted(found)}")
            flat = {name: np.asarray(found[name], dtype=np.float32) for name in names}
            for name, values in flat.items():
                if len(values) != len(images):
                    raise ValueError(f"{len(values)} tensors {name} for {len(images)} images")
            return {name: values.reshape(len(images), -1) for name, values in flat.items()}

        return predict

    run = predict_batch_udf(
        make_predict,
        return_type=StructType([StructField(name, ArrayType(FloatType())) for name in names]),
        batch_size=batch_size,
        input_tensor_shapes=[list(input_shape)],
    )
    # Called that, the model runs once where several columns use its tensors: the optimiser copies no such expression.
    return df.withColumn(tensors, run.asNondeterministic()(F.col(image)))


def extract_features(
    df: DataFrame,
    image: str,
    make_model: Callable[[], Callable[[np.ndarray], np.ndarray]],
    input_shape: Sequence[int],
    output: str = "embedding",
    batch_size: int = 8,
) -> DataFrame:
    """Run a user model over every sample in batches of ``batch_size``; adds ``output``.

    ``make_model`` is called once per Python worker and returns a function from a stacked batch
    ``[b, *input_shape]`` to ``[b, n]`` flat feature tensors.
    """

    def make_predict():
        model = make_model()

        def predict(images: np.ndarray) -> np.ndarray:
            return np.asarray(model(images), dtype=np.float32).reshape(len(images), -1)

        return predict

    run = predict_batch_udf(
        make_predict,
        return_type=ArrayType(FloatType()),
        batch_size=batch_size,
        input_tensor_shapes=[list(input_shape)],
    )
    return df.withColumn(output, run(F.col(image)))


def stored_embeddings(embedding: Column, model: str, c: int, h: int, w: int) -> dict[str, Column]:
    """What is stored for a model: its embedding, resized as its family requires, by column name."""
    return {
        name: embedding if shape == (c, h, w) else resize_nearest(embedding, c, h, w, *shape[1:])
        for name, shape in stored_sets(model, c, h, w).items()
    }


def stored_rows(df: DataFrame, models: Sequence[str], c: int, h: int, w: int) -> DataFrame:
    """``(..., name, tensor)``: what is stored for rows ``(model, embedding)`` of any of ``models``, in one pass."""
    by_model = None
    for model in models:
        made = stored_embeddings(F.col("embedding"), model, c, h, w)
        entries = F.array(*[F.struct(F.lit(n).alias("name"), t.alias("tensor")) for n, t in made.items()])
        match = F.col("model") == model
        by_model = F.when(match, entries) if by_model is None else by_model.when(match, entries)
    kept = [x for x in df.columns if x not in ("model", "embedding")]
    return df.select(*kept, F.inline_outer(by_model)).where(F.col("name").isNotNull())


def patch_mean(c: int, h: int, w: int, patch: int) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A model stand-in: the mean of every patch, ``[c, h, w]`` to ``[c, h/patch, w/patch]``."""

    def make():
        def run(images: np.ndarray) -> np.ndarray:
            blocks = images.reshape(len(images), c, h // patch, patch, w // patch, patch)
            return blocks.astype(np.float64).mean(axis=(3, 5))

        return run

    return make


def transform_hook(df: DataFrame, column: str, hook: Callable[[Column], Column] | None) -> DataFrame:
    """Apply an optional user transform to a decoded column; a Column function stays inside Catalyst,
    and a pandas UDF is one too."""
    return df if hook is None else df.withColumn(column, hook(F.col(column)))


def decoder_hook(
    members: DataFrame, decoders: Mapping[str, Callable[[Column], Column]]
) -> dict[str, DataFrame]:
    """Decode each column of ``(column, data)`` rows by its own decoder, one table per column.

    Columns without a decoder come back as bytes under the name ``None``.
    """
    out: dict[str, DataFrame] = {}
    for name, decode in decoders.items():
        rows = members.where(F.col("column") == name)
        out[name] = rows.withColumn("value", decode(F.col("data"))).drop("data")
    out[None] = members.where(~F.col("column").isin(list(decoders))).withColumnRenamed("data", "value")
    return out


def collate_batches(df: DataFrame, batch: str, pos: str, columns: Sequence[str]) -> DataFrame:
    """One row per batch with each column stacked into an array, in ``pos`` order.

    A group is one batch, so its size is bounded by the batch size.
    """
    packed = df.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(pos, *columns))).alias("_rows"))
    return packed.select(batch, F.size("_rows").alias("size"), *[F.col(f"_rows.{c}").alias(c) for c in columns])
