"""Names and keys of samples, shards, views and models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Models whose targets also carry a class token, by name fragment (fixed values).
CLS_MODELS = ("google/vit", "facebook/dino", "openai/clip")
# Robot datasets that are left out of splitting, by name fragment (fixed values).
EXCLUDED_DATASETS = ("_sim", "uiuc_d3field", "cmu_playing_with_food", "robot_vqa")
# Fragments that mark a camera as moving with the arm (fixed values).
WRIST_MARKS = ("wrist", "hand")
# View name of datasets that have no camera views (fixed value).
OWN_VIEW = "__self__"


def model_name_legit(name: Column, lower: bool = True) -> Column:
    """File-system form of a model name."""
    legit = F.translate(name, "/", "_")
    return F.lower(legit) if lower else legit


def is_packed_model(name: Column) -> Column:
    """Models whose features belong in the shared columns."""
    return ~name.contains("llava")


def dataset_eligible(dataset: Column) -> Column:
    """Robot datasets that take part in splitting."""
    keep = F.lit(True)
    for fragment in EXCLUDED_DATASETS:
        keep = keep & ~dataset.contains(fragment)
    return keep


def view_select(views: Column, mode: str | list | None) -> Column:
    """Camera views to use: None the first, a list all, "static"/"wrist" by name, else the first."""
    first = F.slice(views, 1, 1)
    if isinstance(mode, list):
        chosen = views
    elif mode in ("static", "wrist"):
        moving = lambda v: v.contains(WRIST_MARKS[0]) | v.contains(WRIST_MARKS[1])
        chosen = F.filter(views, moving if mode == "wrist" else lambda v: ~moving(v))
    else:
        chosen = first
    return F.when(F.size(chosen) == 0, first).otherwise(chosen)


def sample_key(member: Column) -> Column:
    """Everything before the first dot of a member name."""
    return F.substring_index(member, ".", 1)


def member_column(member: Column) -> Column:
    """Everything after the first dot of a member name."""
    return F.substring(member, F.instr(member, ".") + 1, F.length(member))


def path_key(path: Column) -> Column:
    """Sample key of a file path: the file name up to its first dot."""
    return sample_key(F.substring_index(path, "/", -1))


def robot_frame_key(dataset: Column, view: Column, episode: Column, frame: Column) -> Column:
    """``{dataset}[_{view}]_seq{episode:06d}_{frame:06d}``"""
    prefix = F.when(view == OWN_VIEW, dataset).otherwise(F.concat_ws("_", dataset, view))
    return F.format_string("%s_seq%06d_%06d", prefix, episode, frame)


def video_frame_key(video: Column, frame: Column) -> Column:
    """``{video}_{frame:06d}``"""
    return F.format_string("%s_%06d", video, frame)


def shard_name(dataset: Column, view: Column, split: Column, shard_idx: Column, robot: Column) -> Column:
    """``{dataset}[_{view}]_{split}-{idx:06d}[-{split}].tar``; robot sets go without the closing split."""
    prefix = F.when(view == OWN_VIEW, dataset).otherwise(F.concat_ws("_", dataset, view))
    stem = F.format_string("%s_%s-%06d", prefix, split, shard_idx)
    return F.concat(F.when(robot, stem).otherwise(F.concat_ws("-", stem, split)), F.lit(".tar"))


def shard_dir(root: Column, view: Column, column: Column) -> Column:
    """``root[/view]/column``"""
    return F.when(view == OWN_VIEW, F.concat_ws("/", root, column)).otherwise(
        F.concat_ws("/", root, view, column)
    )


def split_shard_name(shard: Column, split: Column) -> Column:
    """Name of a shard once its split is known: ``x.tar`` to ``x-{split}.tar``."""
    return F.replace(shard, F.lit(".tar"), F.concat(F.lit("-"), split, F.lit(".tar")))


def in_split(shard: Column, split: str, packed: bool = False) -> Column:
    """Shards of a split by name: ``*-{split}.tar``, or ``*-{split}*.tar`` in the packed layout."""
    return shard.like(f"%-{split}%.tar" if packed else f"%-{split}.tar")


def has_cls(model: Column) -> Column:
    found = F.lit(False)
    for fragment in CLS_MODELS:
        found = found | model.contains(fragment)
    return found


def target_names(model: Column) -> Column:
    """The model itself and, where it has a class token, ``{model}_cls``."""
    return F.when(has_cls(model), F.array(model, F.concat(model, F.lit("_cls")))).otherwise(F.array(model))


def target_base(target: Column) -> Column:
    """Model a target belongs to."""
    return F.replace(target, F.lit("_cls"), F.lit(""))


def target_part(target: Column) -> Column:
    """Which stored tensor a target reads: ``cls`` or ``embedding``."""
    return F.when(target.contains("_cls"), "cls").otherwise("embedding")


def shard_range(start: int, num: int, total: Column, samples_per_shard: int = 1000) -> tuple[Column, Column]:
    """First and one-past-last shard index covering ``num`` samples from ``start`` (all when num <= 0)."""
    first = F.lit(start // samples_per_shard).cast("long")
    end = F.lit(start + num).cast("long") if num > 0 else total.cast("long")
    return first, F.ceil(end / F.lit(float(samples_per_shard)))
