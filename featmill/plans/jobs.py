"""Whole jobs over a dataset folder, put together from the operators.

Layout: ``<root>/<dataset>/images/*.tar``, ``<root>/<dataset>/<model>/*.tar`` and
``<root>/<dataset>/splits.json``. Jobs list shards by their headers, decide on keys alone, and fetch only the
bytes they need. Each can be run again after a crash and skips what is complete.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyarrow.fs import FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featmill.functions.naming import (
    OWN_VIEW,
    sample_key,
    shard_name,
    shard_range,
    split_shard_name,
    video_frame_key,
)
from featmill.operators import extract as ex
from featmill.operators import quality as q
from featmill.operators.columns import merge_columns, resume_pending
from featmill.operators.mixing import epoch_limit, mix_all_exhausted, pick_shards, sample_per_shard, sliding_shuffle
from featmill.operators.ordinals import number_rows, shard_assign, split_assign, split_totals, subsample_listed
from featmill.operators.stats import channel_stats, normalize_model
from featmill.plans.catalog import mix_concat, mix_entries, mix_weights
from featmill.session import materialize, qualified
from featmill.sources.column_store import open_column
from featmill.sources.files import read_image_folder, read_stats, write_splits, write_stats
from featmill.sources.member_index import indexed_members, indexed_report
from featmill.sources.tarshards import (
    _filesystem,
    arrange,
    fetch_files,
    fetch_members,
    list_members,
    read_shards,
    write_shards,
)
from featmill.sources.tensor_bytes import decode_features, decode_images, encode_features

# Video sets: file mark of their archives and the default sampling rate (fixed values).
VIDEO_RATES = {"ego4d": 150, "ssv2": 32, "epic_kitchen": 60}


@dataclass(frozen=True)
class Extractor:
    """A user model: ``make()`` returns a function from pixel batches ``[b, h, w, 3]`` to the tensors of its family.

    The family follows from the model's name and says which tensors those are (``operators.extract.OUTPUTS``): an
    ``embedding`` ``[b, c, h, w]`` and, for some, ``cls_token`` and ``pooled_cls_token`` ``[b, n]``. Models of no known family return an
    embedding.
    """

    model: str
    make: Callable[[], Callable[[np.ndarray], np.ndarray | Mapping[str, np.ndarray]]]
    input_shape: tuple[int, int, int]
    output_shape: tuple[int, int, int]
    batch_size: int = 8

    @property
    def column(self) -> str:
        return self.model.replace("/", "_").lower()

    @property
    def sets(self) -> dict[str, tuple[int, int, int]]:
        """Feature sets stored for the model, with the shapes of their embeddings; the model's own comes first."""
        return ex.stored_sets(self.column, *self.output_shape)

    def run(self, images: DataFrame) -> DataFrame:
        """The tensors, one column each, for rows whose ``data`` is a stored image."""
        decoded = images.withColumn("_px", decode_images("data")["px"]).drop("data")
        floats = decoded.withColumn("_px", F.col("_px").cast("array<float>"))
        outputs = ex.outputs_of(self.column)
        found = ex.extract_tensors(floats, "_px", self.make, self.input_shape, outputs, "_tensors", self.batch_size)
        return found.select("*", *[F.col(f"_tensors.{name}") for name in outputs]).drop("_px", "_tensors")

    def encoded(self, found: DataFrame, bf16: bool) -> list[Column]:
        """Structs ``(name, data)``: the bytes stored in each set for rows of :meth:`run`."""
        tokens = [F.col(name) if name in found.columns else None for name in ("cls_token", "pooled_cls_token")]
        out = []
        for k, (name, shape) in enumerate(self.sets.items()):
            # Resized copies hold the embedding only.
            cls, pooled = tokens if k == 0 else (None, None)
            data = encode_features(F.col("embedding"), *self.output_shape, cls=cls, bf16=bf16, pooled=pooled, size=shape[1:])
            out.append(F.struct(F.lit(name).alias("name"), data.alias("data")))
        return out


def _exists(spark: SparkSession, path: str) -> bool:
    from pyarrow import fs

    files, local = _filesystem(qualified(spark, path))
    return files.get_file_info(local).type != fs.FileType.NotFound


def index_of(path: str) -> str:
    """Where the member index of the shards in a dataset's folder ``path`` is kept."""
    root, _, folder = path.rstrip("/").rpartition("/")
    return f"{root}/_index/{folder}"


def shard_report(spark: SparkSession, path: str) -> DataFrame:
    """Integrity of the shards below ``path``; none if there is no such folder. Shards are walked once, and when they change."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "shard string, ok boolean, n bigint, error string")
    return indexed_report(q.list_shard_files(spark, path), index_of(path))


def _arranged(samples: DataFrame, name, path: str) -> DataFrame:
    """Listed samples ``(key, ...)`` by target shard and member, without those of finished shards."""
    named = samples.withColumn("target", name).withColumn("member", F.concat("key", F.lit(".image")))
    done = shard_report(samples.sparkSession, path).where("ok").select(F.col("shard").alias("target"))
    return arrange(resume_pending(named, done, ["target"]), "target")


def _write_images(fetched: DataFrame, path: str) -> None:
    write_shards(fetched.select(F.col("target").alias("shard"), "member", "data"), path, arranged=True)


def organize_images(
    spark: SparkSession, folder: str, root: str, dataset: str, split: str = "train", samples_per_shard: int = 1000,
    pattern: str = "*.JPEG",
) -> None:
    """Files of an image folder, in path order, to shards of the dataset's split."""
    target = f"{root}/{dataset}/images"
    paths = read_image_folder(spark, folder, pattern, content=False)
    placed = shard_assign(paths, ["path"], samples_per_shard)
    name = shard_name(F.lit(dataset), F.lit(OWN_VIEW), F.lit(split), F.col("shard_idx"), F.lit(False))
    _write_images(fetch_files(_arranged(placed, name, target)), target)


def subsample_videos(
    spark: SparkSession, archives: str, root: str, dataset: str, rate: int | None = None, samples_per_shard: int = 1000
) -> None:
    """Every ``rate``-th frame of the frame archives, laid end to end in name order, to shards.

    Frames are chosen from the archives' headers; only the chosen ones are read.
    """
    if rate is None:
        if dataset not in VIDEO_RATES:
            raise NotImplementedError(f"{dataset} has no default rate")
        rate = VIDEO_RATES[dataset]
    target = f"{root}/{dataset}_1in{rate}/images"
    frames = materialize(read_shards(spark, archives, payload=False, members="*.jpg*").drop("data"), "frames")
    kept = subsample_listed(frames, "shard", "ordinal", rate)
    placed = shard_assign(kept.drop("member"), ["shard", "frame_idx"], samples_per_shard)
    video = F.replace(F.col("shard"), F.lit(".tar"), F.lit(""))
    keyed = placed.withColumn("key", video_frame_key(video, F.col("frame_idx")))
    name = F.format_string("%s-%06d.tar", F.lit(f"{dataset}_1in{rate}"), "shard_idx")
    _write_images(fetch_members(_arranged(keyed, name, target), archives, arranged=True), target)


def split_dataset(spark: SparkSession, root: str, dataset: str, samples_per_shard: int = 1000) -> None:
    """Rename image shards after their split and write ``splits.json``; does nothing where that exists.

    The catalog is written last, so a run that broke off is taken up where it stopped: shards renamed before
    keep their rank, because the split is appended to the name.
    """
    if _exists(spark, f"{root}/{dataset}/splits.json"):
        return
    path = f"{root}/{dataset}/images"
    files = q.list_shard_files(spark, path, "*-*.tar").select(
        F.lit(dataset).alias("dataset"),
        F.regexp_replace("shard", r"-(train|val|test)\.tar$", ".tar").alias("shard"),
        F.col("shard").alias("found"),
    )
    # Only the last shard can be short, so only its headers are read.
    last = files.agg(F.max(F.struct("shard", "found")).alias("last")).first()["last"]
    if last is None:
        raise ValueError(f"no image shards in {path}")
    counted = q.count_steps(read_shards(spark, path, last["found"], payload=False)).first()["n"]
    size = F.when(F.col("found") == last["found"], F.lit(counted)).otherwise(samples_per_shard)
    shards = materialize(split_assign(files.withColumn("n", size.cast("bigint")), "dataset", "shard"), "splits")
    target = split_shard_name(F.col("shard"), F.col("split"))
    folder = qualified(spark, path)

    def rename(rows):
        handle, base = _filesystem(folder)
        for row in rows:
            here, there = (f"{base}/{row[name]}" for name in ("found", "target"))
            # A repeated task finds what it has moved already under its new name.
            if handle.get_file_info(here).type != FileType.NotFound:
                handle.move(here, there)
            elif handle.get_file_info(there).type == FileType.NotFound:
                raise FileNotFoundError(here)

    shards.select("found", target.alias("target")).where("found <> target").foreachPartition(rename)
    write_splits(split_totals(shards.select("dataset", "shard", "n"), "dataset", "shard", "n", samples_per_shard), root)


def extract_dataset(
    spark: SparkSession, root: str, dataset: str, extractor: Extractor, split: str = "train", start: int = 0,
    num: int = -1, samples_per_shard: int = 1000, bf16: bool = True,
) -> None:
    """Extract a model's features for every image shard of a split that lacks a complete shard in one of the model's sets.

    The sets are folders beside ``images``: the model's own, with all tensors of its family, and resized copies where
    the family has them. One pass over the images writes all of them.

    ``start`` and ``num`` restrict the samples, rounded out to whole shards.
    """
    images, target = f"{root}/{dataset}/images", f"{root}/{dataset}"
    files = q.list_shard_files(spark, images, f"*-{split}.tar")
    ranked = number_rows(files, order=["shard"], ordinal="_idx", size="_shards")
    first, end = shard_range(start, num, F.col("_shards") * samples_per_shard, samples_per_shard)
    wanted = ranked.where((F.col("_idx") >= first) & (F.col("_idx") < end)).drop("_idx", "_shards")
    done = None
    for name in extractor.sets:
        complete = shard_report(spark, f"{target}/{name}").where("ok").select("shard")
        done = complete if done is None else done.join(complete, "shard", "left_semi")
    pending = resume_pending(wanted, done, ["shard"])
    # A shard's images are fetched, extracted and written in one task, to all sets at once; only the listing is shuffled.
    listed = indexed_members(materialize(pending, "pending"), index_of(images))
    rows = fetch_members(arrange(listed), images, arranged=True)
    found = extractor.run(rows.select("shard", sample_key(F.col("member")).alias("key"), "data"))
    stored = found.select("shard", "key", F.array(*extractor.encoded(found, bf16)).alias("_sets")).select("shard", "key", F.inline("_sets"))
    write_shards(
        stored.select(
            F.concat_ws("/", "name", "shard").alias("shard"), F.concat("key", F.lit("."), "name", F.lit(".safetensors")).alias("member"), "data"
        ),
        target,
        arranged=True,
    )


def feature_statistics(
    spark: SparkSession, root: str, dataset: str, sizes: Mapping[str, tuple[int, int, int]], stats: str,
    split: str = "train",
) -> DataFrame:
    """Channel statistics of the models not stored yet; returns those of all ``sizes``."""
    known = set()
    if _exists(spark, stats):
        # At most one row per model of this call.
        complete = read_stats(spark, stats, list(sizes)).where("mean is not null and std is not null")
        known = {row["model"] for row in complete.select("model").distinct().collect()}
    for model, (c, h, w) in sizes.items():
        column = model.replace("/", "_").lower()
        if column in known:
            continue
        rows = read_shards(spark, f"{root}/{dataset}/{column}", f"*-{split}.tar")
        tokens = rows.select(F.lit(model).alias("model"), decode_features(F.col("data"), c, h, w)["embedding"].alias("e"))
        write_stats(channel_stats(tokens, "e", c, h * w, ["model"], tokens_first=True), stats)
    return read_stats(spark, stats, list(sizes))


def check_dataset(
    spark: SparkSession, root: str, dataset: str, extractors: Sequence[Extractor], split: str = "val", seed: int = 0,
    shards: int = 5, per_shard: int = 8,
) -> DataFrame:
    """Recompute a seeded sample and compare: ``(model, shard, total, largest, missing, missized, equal, keys_ok, passed)``.

    Images and features are paired by their position in the shard, as the keys are part of the check.
    """
    images = f"{root}/{dataset}/images"

    def files(path: str) -> DataFrame:
        return q.list_shard_files(spark, path, f"*-{split}.tar").select("shard", "path")

    def positions(chosen: DataFrame) -> DataFrame:
        return list_members(chosen).withColumnRenamed("ordinal", "pos")

    # Shards are chosen by name, so only the headers of those are read.
    chosen = materialize(pick_shards(files(images), "shard", seed, shards), "chosen")
    sample = materialize(sample_per_shard(positions(chosen), "shard", "member", seed, per_shard), "sample")
    out = None
    for extractor in extractors:
        again = extractor.run(fetch_members(sample, images)).select(
            "shard", "pos", sample_key(F.col("member")).alias("image_key"), "embedding"
        )
        for name, shape in extractor.sets.items():
            path = f"{root}/{dataset}/{name}"
            model = extractor.model + name.removeprefix(extractor.column)
            listed = positions(files(path).join(chosen.select("shard"), "shard", "left_semi"))
            stored = fetch_members(listed.join(sample.select("shard", "pos"), ["shard", "pos"], "left_semi"), path)
            stored = stored.select(
                "shard",
                "pos",
                F.lit(model).alias("model"),
                sample_key(F.col("member")).alias("feature_key"),
                decode_features(F.col("data"), *shape)["embedding"].alias("embedding"),
            )
            as_stored = _as_stored(F.col("embedding"), extractor.output_shape, shape)
            mine = again.withColumn("embedding", as_stored).withColumn("model", F.lit(model))
            diff = q.feature_diff(stored, mine, ["shard", "pos"], ["model", "shard"])
            keys = (
                mine.select("shard", "pos", "image_key")
                .join(stored.select("shard", "pos", "feature_key"), ["shard", "pos"], "full_outer")
                .groupBy("shard")
                .agg(F.bool_and(F.col("image_key").eqNullSafe(F.col("feature_key"))).alias("keys_ok"))
            )
            # A sampled shard without features has a row too: all its samples are missing.
            part = diff.join(keys, "shard").withColumn("passed", F.col("equal") & F.col("keys_ok"))
            out = part if out is None else out.unionByName(part)
    return out


def _as_stored(embedding: Column, shape: tuple[int, int, int], stored: tuple[int, int, int]) -> Column:
    """What storing and reading back makes of a feature: bfloat16 values as tokens, in the size of the set."""
    return decode_features(encode_features(embedding, *shape, bf16=True, size=stored[1:]), *stored)["embedding"]


def batch_columns(
    images: DataFrame,
    features: Mapping[str, DataFrame],
    weights: DataFrame,
    batch_size: int = 16,
    seed: int = 0,
    shuffle_buffer: int | None = None,
    expected: DataFrame | None = None,
    world: int = 1,
) -> DataFrame:
    """Mix, align and batch the columns of samples: ``(dataset, key, batch_idx, batch_pos, image, <features>)``.

    ``images`` is ``(dataset, shard_idx, key, image)``, each feature ``(dataset, key, embedding)``, ``weights``
    ``(dataset, weight)``. Mixing, shuffling and batching work on keys; the payloads are joined by key
    afterwards, so they stay aligned by construction. Columns bucketed by (dataset, key) do not move for it.
    With an ``expected`` length the mix ends after one epoch on ``world`` ranks.
    """
    keys = images.select("dataset", "shard_idx", "key")
    mixed = mix_all_exhausted(keys, weights, "dataset", ["shard_idx", "key"], "key", seed)
    if expected is not None:
        mixed = epoch_limit(mixed, expected, batch_size, world)
    if shuffle_buffer:
        tagged = mixed.withColumn("_id", F.concat_ws("/", "dataset", "key"))
        mixed = sliding_shuffle(tagged, ["mix_rank"], "_id", seed, shuffle_buffer).drop("_id", "mix_rank")
        mixed = mixed.withColumnRenamed("position", "mix_rank")
    placed = mixed.select(
        "dataset",
        "key",
        F.expr(f"mix_rank div {int(batch_size)}").alias("batch_idx"),
        (F.col("mix_rank") % batch_size).alias("batch_pos"),
    )
    payloads = [df.select("dataset", "key", F.col("embedding").alias(name)) for name, df in features.items()]
    return merge_columns([placed, images.select("dataset", "key", "image"), *payloads])


def frame_batches(
    spark: SparkSession,
    root: str,
    mix: str | Mapping[str, float] | Sequence[str],
    models: Mapping[str, tuple[int, int, int]],
    split: str = "train",
    ratio: float = 1.0,
    batch_size: int = 16,
    seed: int = 0,
    shuffle_buffer: int | None = None,
    stats: DataFrame | None = None,
    world: int | None = None,
) -> DataFrame:
    """:func:`batch_columns` of a column store, weighted by a mix and the datasets' lengths.

    Columns stored by ``write_buckets`` stay where they are: only keys are shuffled.
    Features are normalised where ``stats`` are given. Every dataset of the mix contributes; in validation
    all count alike. With ``world`` ranks given, the result is one epoch: as many samples as the weighted
    lengths, times ``ratio``, come to in whole steps, and at most all; otherwise it is one pass over all.
    """
    stored = "val" if split == "eval" else split
    images = open_column(spark, root, "images", stored)
    entries = mix_concat(mix_entries(spark, mix))
    lengths = images.groupBy("dataset").agg(F.count("*").alias("n")).join(entries, "dataset")
    if stored == "val":
        lengths = lengths.withColumn("weight", F.lit(1.0))
    weights = materialize(mix_weights(materialize(lengths, "lengths"), ratio), "weights")
    features = {}
    for model, (c, h, w) in models.items():
        name = model.replace("/", "_").lower()
        feature = open_column(spark, root, name, stored)
        features[name] = feature if stats is None else normalize_model(feature, stats, name, c, h * w)
    expected = None if world is None else weights.agg(F.max("expected").alias("expected"))
    weights = weights.select("dataset", "weight")
    return batch_columns(images, features, weights, batch_size, seed, shuffle_buffer, expected, world or 1)
