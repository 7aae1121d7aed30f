"""Queries that run whole jobs on a dataset folder made from the tables, and read back what they left."""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from featmill.functions.naming import sample_key
from featmill.operators.ordinals import number_rows, shard_assign
from featmill.operators.stats import channel_stats
from featmill.operators.extract import outputs_of
from featmill.plans import jobs
from featmill.plans.registry import MODEL_SIZES
from featmill.session import scratch_path
from featmill.sources.column_store import write_buckets, write_column
from featmill.sources.files import read_splits
from featmill.sources.tarshards import read_shards, write_shards
from featmill.sources.tensor_bytes import decode_features, encode_image
from featmill.workload.base import C, H, W, big, long_form, query, table
from featmill.workload.shards import _write_files
from featmill.workload.tensors import _PX, _pixels


@query(
    "organize_images",
    """WITH placed AS (SELECT page_id, html, (row_number() OVER (ORDER BY printf('class%d/page_%05d', page_id % 7, page_id)) - 1)
  // 20 AS shard_idx FROM pages)
SELECT printf('web_train-%06d-train.tar', shard_idx) AS shard, printf('page_%05d', page_id) AS key, md5(html) AS digest
FROM placed""",
)
def organize_images(spark, sf):
    """Pages as files in class folders, organised into shards of 20 in path order."""
    pages = table(spark, sf, "pages").select(
        F.format_string("class%d/page_%05d.v1.JPEG", F.col("page_id") % 7, "page_id").alias("path"),
        F.encode("html", "UTF-8").alias("data"),
    )
    folder, root = scratch_path(spark, "raw"), scratch_path(spark, "root")
    _write_files(pages, folder)
    jobs.organize_images(spark, folder, root, "web", samples_per_shard=20)
    rows = read_shards(spark, f"{root}/web/images", "*-train.tar")
    return rows.select("shard", sample_key(F.col("member")).alias("key"), F.md5("data").alias("digest"))


@query(
    "subsample_and_split",
    """WITH frames AS (SELECT user_id, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
  row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS ordinal FROM events),
kept AS (SELECT *, (row_number() OVER (ORDER BY ordinal) - 1) // 15 AS shard_idx, count(*) OVER () AS total
  FROM frames WHERE ordinal % 32 = 0),
sized AS (SELECT *, ceil(total / 15.0::DOUBLE) AS n FROM kept),
split AS (SELECT *, CASE WHEN shard_idx < ceil(n * 0.8::DOUBLE) THEN 'train'
  WHEN shard_idx < ceil(n * 0.8::DOUBLE) + ceil(n * 0.05::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM sized)
SELECT printf('ssv2_1in32-%06d-', shard_idx) || split || '.tar' AS shard, printf('video%08d_%06d', user_id, frame_idx) AS key,
  md5(props) AS digest, count(*) OVER (PARTITION BY split) AS split_samples FROM split""",
)
def subsample_and_split(spark, sf):
    """One archive of frames per user, every 32nd frame of all to shards of 15, which are then split."""
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", F.encode("props", "UTF-8").alias("data"))
    frames = number_rows(events, ["user_id"], ["ts", "event_id"], ordinal="frame")
    archives, root = scratch_path(spark, "archives"), scratch_path(spark, "root")
    write_shards(
        frames.select(
            F.format_string("video%08d.tar", "user_id").alias("shard"),
            F.format_string("frame_%08d.jpg", "frame").alias("member"),
            "data",
        ),
        archives,
    )
    jobs.subsample_videos(spark, archives, root, "ssv2", samples_per_shard=15)
    jobs.split_dataset(spark, root, "ssv2_1in32", samples_per_shard=15)
    rows = read_shards(spark, f"{root}/ssv2_1in32/images").select(
        "shard",
        sample_key(F.col("member")).alias("key"),
        F.md5("data").alias("digest"),
        F.regexp_extract("shard", r"-([a-z]+)\.tar$", 1).alias("split"),
    )
    # One row per split.
    sizes = read_splits(spark, root).select("split", F.col("n").alias("split_samples"))
    return rows.join(F.broadcast(sizes), "split").drop("split")


def patch_tensors(outputs):
    """A stand-in model: means of 4 by 4 patches, ``[b, 8, 8, 3]`` to ``[b, 3, 2, 2]``, as class token the means of the colours and
    as pooled token their largest values; ``outputs`` says which of them it returns."""

    def make():
        def run(px):
            found = {
                "embedding": np.moveaxis(px.reshape(len(px), 2, 4, 2, 4, 3).mean(axis=(2, 4)), 3, 1),
                "cls_token": px.mean(axis=(1, 2)),
                "pooled_cls_token": px.max(axis=(1, 2)),
            }
            return {name: found[name] for name in outputs}

        return run

    return make


_TENSORS, _SUMS = ("embedding", "cls", "pooled_cls"), ("size", "first", "last", "total", "placed")


@F.pandas_udf(StructType([StructField(f"{t}_{c}", LongType() if c == "size" else DoubleType()) for t in _TENSORS for c in _SUMS]))
def tensor_sums(features: pd.DataFrame) -> pd.DataFrame:
    """Of each decoded tensor its size, its first and last value, its sum and its sum by place, added up from front to back."""

    def sums(t):
        if t is None:
            return (None,) * len(_SUMS)
        t = np.asarray(t, np.float64)
        placed = t * (np.arange(1, len(t) + 1) % 97)
        # A running sum keeps the order; the zero to start from makes no negative one.
        return len(t), t[0], t[-1], t.cumsum()[-1] + 0.0, placed.cumsum()[-1] + 0.0

    rows = [sum(map(sums, tensors), ()) for tensors in zip(*(features[t] for t in _TENSORS), strict=True)]
    out = pd.DataFrame(rows, columns=[f"{t}_{c}" for t in _TENSORS for c in _SUMS])
    return out.astype({c: "Int64" if c.endswith("_size") else "float64" for c in out.columns})


# Embeddings that each set stores: side, and the tokens beside it.
_SETS_SQL = """(VALUES ('google_vit-huge-patch14-224-in21k', 2, true, false), ('facebook_sam-vit-huge', 2, false, false),
  ('facebook_sam-vit-huge_32', 32, false, false), ('openai_clip-vit-large-patch14', 2, true, true),
  ('facebook_dinov2-large', 2, true, true), ('llava-hf_llava-1.5-7b-hf', 2, false, false),
  ('liheyoung_depth-anything-large-hf', 64, false, false)) s("set", side, has_cls, has_pooled)"""


@query(
    "extract_dataset",
    f"""WITH px AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS o, vec_id, embedding FROM embeddings),
cells AS (SELECT o, vec_id, i, {_PX.format("i")}::DOUBLE AS x FROM px, range(64) r(i)),
means AS (SELECT o, vec_id, (i // 32) * 2 + (i % 8) // 4 AS patch, avg(x) AS v, max(x) AS largest FROM cells GROUP BY ALL),
images AS (SELECT o, vec_id, list(v ORDER BY patch) AS v, avg(v) AS mean, max(largest) AS largest FROM means GROUP BY ALL),
tensors AS (
  SELECT o, vec_id, "set", 'embedding' AS tensor, list_transform(range(side * side * 3),
    lambda i: v[(i // 3 // side) * 2 // side * 2 + (i // 3 % side) * 2 // side + 1]) AS t FROM images, {_SETS_SQL}
  UNION ALL SELECT o, vec_id, "set", 'cls', [mean, mean, mean] FROM images, {_SETS_SQL} WHERE has_cls
  UNION ALL SELECT o, vec_id, "set", 'pooled_cls', [largest, largest, largest] FROM images, {_SETS_SQL} WHERE has_pooled)
SELECT "set", printf('emb_train-%06d-train.tar', o // 50) AS shard, lpad(vec_id::VARCHAR, 8, '0') AS key, tensor,
  len(t)::BIGINT AS size, t[1] AS "first", t[-1] AS "last", list_sum(t) AS total,
  list_sum(list_transform(t, lambda x, i: x * (i % 97))) AS placed FROM tensors""",
)
def extract_dataset(spark, sf):
    """Embeddings as gray images; the tensors of all six model families, of the first shards and then of all that lack them.

    Of every stored tensor: its size, its first and last value, its sum, and its sum by place.
    """
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    placed = shard_assign(e.select("vec_id"), ["vec_id"], 50).join(e, "vec_id")
    root = scratch_path(spark, "root")
    write_shards(
        placed.select(
            F.format_string("emb_train-%06d-train.tar", "shard_idx").alias("shard"),
            F.concat(F.lpad(F.col("vec_id").cast("string"), 8, "0"), F.lit(".image")).alias("member"),
            encode_image(_pixels(), 8, 8).alias("data"),
        ),
        f"{root}/emb/images",
    )
    parts = []
    for k, model in enumerate(MODEL_SIZES):
        outputs = outputs_of(model.replace("/", "_").lower())
        extractor = jobs.Extractor(model, patch_tensors(outputs), (8, 8, 3), (3, 2, 2))
        if k == 0:
            jobs.extract_dataset(spark, root, "emb", extractor, num=130, samples_per_shard=50, bf16=False)
        jobs.extract_dataset(spark, root, "emb", extractor, samples_per_shard=50, bf16=False)
        for name, shape in extractor.sets.items():
            rows = read_shards(spark, f"{root}/emb/{name}", "*-train.tar")
            # Tensors are summed up by the task that decodes them.
            summed = rows.withColumn("s", tensor_sums(decode_features(F.col("data"), *shape)))
            tensors = [F.struct(F.lit(t).alias("tensor"), *[F.col(f"s.{t}_{c}").alias(c) for c in _SUMS]) for t in _TENSORS]
            long = summed.select(F.lit(name).alias("set"), "shard", sample_key(F.col("member")).alias("key"), F.inline(F.array(*tensors)))
            parts.append(long.where(F.col("size").isNotNull()))
    rows = reduce(DataFrame.unionAll, parts)
    # Pandas knows no null beside NaN; a tensor that is there has all its sums.
    values = [F.coalesce(c, F.lit(float("nan"))).alias(c) for c in _SUMS[1:]]
    return rows.select("set", "shard", "key", "tensor", "size", *values)


_MIX = {"d0": 1.0, "d1": 2.0, "d2": 0.5, "d3": 1.0, "d4": 1.0, "d5": 1.0, "d6": 3.0, "d7": 1.0, "d8": 2.0, "d9": 1.0}


_BATCHES_SQL = f"""WITH mix(dataset, w) AS (VALUES {",".join(f"('{k}',{v}::DOUBLE)" for k, v in _MIX.items())}),
s AS (SELECT 'd' || label AS dataset, lpad(vec_id::VARCHAR, 8, '0') AS key, vec_id, embedding FROM embeddings),
lens AS (SELECT dataset, w, count(*) AS n FROM s JOIN mix USING (dataset) GROUP BY ALL),
weights AS (SELECT dataset, w * n / (SELECT sum(w * n) FROM lens) AS weight FROM lens),
rates AS (SELECT dataset, weight / (SELECT max(weight) FROM weights) AS rate FROM weights),
gaps AS (SELECT *, floor(-ln((('0x' || substr(md5('5:' || dataset || ':' || key), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)
  / rate * 16777216.0::DOUBLE)::DECIMAL(24,0) AS gap FROM s JOIN rates USING (dataset)),
raced AS (SELECT *, sum(gap) OVER (PARTITION BY dataset ORDER BY vec_id) AS t FROM gaps),
ranked AS (SELECT *, row_number() OVER (ORDER BY t, dataset, vec_id) - 1 AS mix_rank FROM raced),
long AS (SELECT i // 16 AS channel, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) r(i)),
stats AS (SELECT channel, avg(v) AS mean, stddev_samp(v) AS std FROM long GROUP BY ALL)
SELECT dataset, key, mix_rank // 16 AS batch_idx, mix_rank % 16 AS batch_pos, vec_id AS image, i AS pos,
  round((embedding[(i % 4) * 16 + i // 4 + 1]::DOUBLE - mean) / std, 6) + 0.0 AS value
FROM ranked, range(64) r(i) JOIN stats ON channel = i % 4"""


@query("frame_batches", _BATCHES_SQL)
def frame_batches(spark, sf):
    """Embeddings of all ten labels mixed, normalised and batched from a column store."""
    return _batches(spark, sf, write_column)


@query("bucketed_batches", _BATCHES_SQL)
def bucketed_batches(spark, sf):
    """The same from columns in buckets by (dataset, key), which stay where they are."""
    return _batches(spark, sf, partial(write_buckets, buckets=8))


def _batches(spark, sf, write):
    from featmill.functions.tensors import chw_to_tokens

    e = table(spark, sf, "embeddings")
    samples = e.select(
        F.concat(F.lit("d"), F.col("label").cast("string")).alias("dataset"),
        F.lit("train").alias("split"),
        F.expr("vec_id div 100").alias("shard_idx"),
        F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("key"),
        F.col("vec_id").alias("image"),
        chw_to_tokens("embedding", C, H, W).alias("embedding"),
    )
    root = scratch_path(spark, "columns")
    write(samples.drop("embedding"), root, "images")
    write(samples.drop("image"), root, "facebook_dinov2-large")
    model = "facebook/dinov2-large"
    stats = channel_stats(
        e.select(F.lit("facebook_dinov2-large").alias("model"), "embedding"), "embedding", C, H * W, ["model"]
    )
    batches = jobs.frame_batches(spark, root, _MIX, {model: (C, H, W)}, batch_size=16, seed=5, stats=stats)
    rows = long_form(
        batches, ["dataset", "key", "batch_idx", "batch_pos", "image"], F.col("`facebook_dinov2-large`"), exact=False
    )
    return rows.select("dataset", "key", big("batch_idx").alias("batch_idx"), big("batch_pos").alias("batch_pos"),
                       "image", "pos", "value")
