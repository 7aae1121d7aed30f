"""Bytes of stored tensors and images, and the Arrow UDFs that decode and encode them.

Formats: safetensors (8-byte little-endian header length, JSON header, raw buffers) and ``.npy``.
"""

from __future__ import annotations

import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    DoubleType,
    FloatType,
    IntegerType,
    ShortType,
    StructType,
)

from featmill.functions.tensors import bf16_bits, bf16_values

# Element types of the safetensors format and their numpy types (fixed values).
TENSOR_TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "U8": "|u1"}

FLOATS = ArrayType(FloatType())
FEATURE_TYPE = StructType().add("embedding", FLOATS).add("cls", FLOATS).add("pooled_cls", FLOATS)
IMAGE_TYPE = StructType().add("h", IntegerType()).add("w", IntegerType()).add("px", ArrayType(ShortType()))


def load_tensors(data: bytes) -> dict[str, np.ndarray]:
    """Tensors of a safetensors blob; bfloat16 is widened to float32."""
    size = int.from_bytes(data[:8], "little")
    header = json.loads(data[8 : 8 + size])
    body = memoryview(data)[8 + size :]
    out = {}
    for name, entry in header.items():
        if name == "__metadata__":
            continue
        start, end = entry["data_offsets"]
        raw = body[start:end]
        if entry["dtype"] == "BF16":
            values = bf16_values(np.frombuffer(raw, "<u2"))
        else:
            values = np.frombuffer(raw, TENSOR_TYPES[entry["dtype"]])
        out[name] = values.reshape(entry["shape"])
    return out


def save_tensors(tensors: dict[str, np.ndarray], bf16: bool = False) -> bytes:
    """A safetensors blob of float tensors, as float32 or rounded to bfloat16."""
    header, bodies, offset = {}, [], 0
    for name, values in tensors.items():
        values = np.ascontiguousarray(values, dtype="<f4")
        raw = (bf16_bits(values).astype("<u2") if bf16 else values).tobytes()
        header[name] = {
            "dtype": "BF16" if bf16 else "F32",
            "shape": list(values.shape),
            "data_offsets": [offset, offset + len(raw)],
        }
        bodies.append(raw)
        offset += len(raw)
    head = json.dumps(header, separators=(",", ":")).encode()
    head += b" " * (-len(head) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(bodies)


def _npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def decode_features(data: Column, c: int, h: int, w: int) -> Column:
    """Struct of ``embedding`` as tokens ``[h*w, c]``, ``cls`` and ``pooled_cls`` from stored bytes.

    A tensor of another shape than ``[c, h, w]`` fails the job.
    """

    @F.pandas_udf(FEATURE_TYPE)
    def decode(blobs: pd.Series) -> pd.DataFrame:
        rows = []
        for blob in blobs:
            tensors = load_tensors(blob) if blob is not None else {}
            if "embedding" in tensors:
                if tensors["embedding"].shape != (c, h, w):
                    raise ValueError(f"stored tensor is {tensors['embedding'].shape}, not {(c, h, w)}")
                tensors["embedding"] = tensors["embedding"].reshape(c, h * w).T
            parts = [tensors.get(name) for name in ("embedding", "cls_token", "pooled_cls_token")]
            rows.append([None if part is None else part.astype(np.float32).ravel() for part in parts])
        return pd.DataFrame(rows, columns=["embedding", "cls", "pooled_cls"])

    return decode(data)


def encode_features(
    embedding: Column, c: int, h: int, w: int, cls: Column | None = None, bf16: bool = False, pooled: Column | None = None,
    size: tuple[int, int] | None = None,
) -> Column:
    """Safetensors bytes of an embedding ``[c, h, w]`` and, where given, of a class token and a pooled one.

    With ``size`` the embedding is stored as ``[c, *size]``, each cell the nearest one's value.
    """
    rows, columns = (np.arange(s) * n // s for s, n in zip(size or (h, w), (h, w), strict=True))

    @F.pandas_udf(BinaryType())
    def encode(values: pd.Series, token: pd.Series, pooled_token: pd.Series) -> pd.Series:
        blobs = []
        for v, *tokens in zip(values, token, pooled_token, strict=True):
            whole = np.asarray(v, dtype=np.float32).reshape(c, h, w)
            tensors = {"embedding": whole if size is None else whole[:, rows][:, :, columns]}
            for name, t in zip(("cls_token", "pooled_cls_token"), tokens, strict=True):
                if t is not None:
                    tensors[name] = np.asarray(t, dtype=np.float32)
            blobs.append(save_tensors(tensors, bf16))
        return pd.Series(blobs)

    none = F.lit(None).cast("array<float>")
    return encode(embedding, none if cls is None else cls, none if pooled is None else pooled)


@F.pandas_udf(IMAGE_TYPE)
def decode_images(data: pd.Series) -> pd.DataFrame:
    """RGB pixels of ``.npy`` images: gray is repeated, alpha dropped, RGB left alone."""
    rows = []
    for blob in data:
        if blob is None:
            rows.append((None, None, None))
            continue
        px = _npy(blob)
        if px.ndim == 2:
            px = np.repeat(px[:, :, None], 3, axis=2)
        elif px.ndim == 3 and px.shape[2] == 4:
            px = px[:, :, :3]
        rows.append((px.shape[0], px.shape[1], px.astype(np.int16).ravel()))
    return pd.DataFrame(rows, columns=["h", "w", "px"]).astype({"h": "Int32", "w": "Int32"})


def encode_image(px: Column, *shape: int) -> Column:
    """``.npy`` bytes of an 8-bit image of ``shape``."""

    @F.pandas_udf(BinaryType())
    def encode(values: pd.Series) -> pd.Series:
        blobs = []
        for v in values:
            buffer = io.BytesIO()
            np.save(buffer, np.asarray(v).astype(np.uint8).reshape(shape))
            blobs.append(buffer.getvalue())
        return pd.Series(blobs)

    return encode(px)


@F.pandas_udf(ArrayType(DoubleType()))
def decode_vector(data: pd.Series) -> pd.Series:
    """Flat values of an ``.npy`` array, such as a stored mean."""
    return data.map(lambda blob: None if blob is None else _npy(blob).astype(np.float64).ravel())
