"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Spark cuts a text into runs of letters and digits and runs of other symbols and hashes them; single words and pairs of
neighbours fall into 2^18 slots, a pair of equal words into a slot of its own. A slot's value is the square root of
its share of the text's n-grams, so every text has length one whatever its size. Training shards run
follow-the-regularised-leader on their own rows and the shards' weights are averaged. A score is one sparse dot
product per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featmill.llm.common import materialize, text_of

SLOTS = 1 << 18
# Labelled rows to learn from (those whose ids hash lowest), the fewest in a shard, the most shards, passes over them.
SAMPLE, SHARD, SHARDS, PASSES = 24_000, 1_500, 8, 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.005, 0.0
TOKENS = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_REPEAT = 1


def token_hashes(text: str = "text"):
    """``array<bigint>``: the hashes of a text's tokens; empty for a null or empty text."""
    return F.transform(F.regexp_extract_all(text_of(text), F.lit(TOKENS), F.lit(0)), lambda w: F.xxhash64(w))


def features(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text's n-grams and their values; slot 0 is always there, so an empty text has a score too."""
    h = hashes.astype(np.int64, copy=False).view(np.uint64)
    pairs = ((h[:-1] * _PAIR) ^ (h[1:] >> np.uint64(7))) * _PAIR
    slots = np.concatenate((h, pairs)) >> np.uint64(64 - 18)
    if len(h) > 1:
        slots[len(h) :][h[1:] == h[:-1]] = _REPEAT
    found, counts = np.unique(slots.astype(np.int64), return_counts=True)
    values = np.sqrt(counts / max(1, counts.sum()))
    return np.concatenate(([0], found)), np.concatenate(([1.0], values))


def _leader(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Weights after all passes; the two labels weigh the same, however many rows each has."""
    z, n = np.zeros(SLOTS), np.zeros(SLOTS)
    ones = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    weighs = np.where(labels == 1, 0.5 / ones, 0.5 / (1 - ones))

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(PASSES):
        for (i, x), y, c in zip(rows, labels, weighs, strict=True):
            w = weights(i)
            g = c * (1.0 / (1.0 + np.exp(-float(w @ x))) - y) * x
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            np.add.at(z, i, g - step * w)
            np.add.at(n, i, g * g)
    return weights(np.arange(SLOTS))


def train(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> np.ndarray:
    """Weights learned from ``docs(doc_id, text)`` and ``labels(doc_id, <label> 0/1)``.

    At most ``sample`` labelled documents are used. A null id or label teaches nothing; of several labels of one id the
    smallest counts. Without labelled rows all weights are 0. The sample's ids are a table of bounded size and
    broadcast; only its documents' token hashes are shuffled.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("_y"))
    chosen = known.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(sample)
    chosen = materialize(chosen, "labelled")
    shards = max(1, min(SHARDS, chosen.count() // SHARD))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "_h", F.pmod("_h", F.lit(shards)).alias("_shard"), F.col("_y").cast("double").alias("y"), token_hashes().alias("h")
    )

    def lead(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_h", kind="stable")
        w = _leader([features(np.asarray(h, np.int64)) for h in group["h"]], group["y"].to_numpy())
        return pd.DataFrame({"rows": [len(group)], "w": [w.astype("<f8").tobytes()]})

    found = rows.groupBy("_shard").applyInPandas(lead, "rows long, w binary").toPandas()
    total = np.zeros(SLOTS)
    for n, w in zip(found["rows"], found["w"], strict=True):
        total += n * np.frombuffer(w, "<f8")
    return total / max(1, found["rows"].sum() if len(found) else 1)


def score(docs: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``score``, 0 to 1, for each row of ``docs(text)``; a null text is an empty one."""
    table = weights.astype("<f4")

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            margins = np.empty(batch.num_rows)
            for k in range(batch.num_rows):
                i, x = features(flat[ends[k] : ends[k + 1]])
                margins[k] = table[i] @ x
            scores = pa.array(1.0 / (1.0 + np.exp(-margins)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*keep, "score"])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], token_hashes().alias("_h"))
    return rows.mapInArrow(dots, T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())]))
