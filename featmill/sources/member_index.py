"""An index of the members of tar shards, kept as Parquet tables, so that headers are walked once per shard.

An archive has no table of contents: to know its members, every header has to be read, one after another. The index keeps what
such a walk finds: a row for each member with the places of its header and its bytes and its position in name order, and a
closing row for the shard with the number of members, the place of the closing block, or what is wrong with it. A shard is known
by its name, length and time of change; one that has changed since is walked again, rows of older states are passed over.

With it listings, positions and integrity come from a table read, payloads are cut at the borders of members, and the headers of
one huge shard can be checked again by many tasks (:func:`verify_members`).
"""

from __future__ import annotations

import tarfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featmill.session import qualified
from featmill.sources.tarshards import BATCH_ROWS, _filesystem, payload_tasks, spread_files

STATE = ("shard", "length", "modified")
SCHEMA = (
    "shard string, length bigint, modified bigint, member string, header bigint, offset bigint, size bigint, ordinal bigint,"
    " n bigint, error string"
)
_TYPES = pa.schema(
    [("shard", pa.string()), ("length", pa.int64()), ("modified", pa.int64()), ("member", pa.string())]
    + [(c, pa.int64()) for c in ("header", "offset", "size", "ordinal", "n")]
    + [("error", pa.string())]
)
# Headers that one task checks.
TASK_HEADERS = 1 << 14


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TYPES)], schema=_TYPES)


def walk_shard(handle) -> tuple[list[tarfile.TarInfo], int]:
    """Headers in name order and the place of the closing block, in one walk; raises for an incomplete archive."""
    found = []
    with tarfile.open(fileobj=handle, mode="r:") as tar:
        while (info := tar.next()) is not None:
            if info.isfile():
                found.append(info)
            tar.members.clear()
        place = tar.offset
    handle.seek(place)
    block = handle.read(tarfile.BLOCKSIZE)
    if len(block) < tarfile.BLOCKSIZE or any(block):
        raise tarfile.ReadError("no end of archive")
    return sorted(found, key=lambda info: info.name.encode("utf-8", "surrogateescape")), place


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, length, modified, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            state, found, place, error = (shard, length, modified), [], None, None
            try:
                handles, local = _filesystem(path)
                with handles.open_input_file(local) as handle:
                    found, place = walk_shard(handle)
            except (tarfile.TarError, OSError) as problem:
                error = f"{type(problem).__name__}: {problem}"
            for start in range(0, len(found), BATCH_ROWS):
                part = enumerate(found[start : start + BATCH_ROWS], start)
                yield _batch([(*state, i.name, i.offset, i.offset_data, i.size, k, None, None) for k, i in part])
            yield _batch([(*state, None, place, None, None, None, len(found), error)])


def _stored(spark: SparkSession, index: str) -> DataFrame | None:
    from pyarrow import fs

    files, local = _filesystem(qualified(spark, index))
    if files.get_file_info(local).type == fs.FileType.NotFound:
        return None
    return spark.read.schema(SCHEMA + ", v string").parquet(index)


def refresh_index(files: DataFrame, index: str) -> DataFrame:
    """Rows of the index for ``files(shard, path, length, modified)``; walks those shards that it does not have yet.

    New rows go into a folder of their own. Where two jobs have walked one shard, the rows of one of them count.
    """
    spark = files.sparkSession
    stored = _stored(spark, index)
    pending = files.select(*STATE, "path")
    if stored is not None:
        pending = pending.join(stored.where("member IS NULL").select(*STATE).distinct(), list(STATE), "left_anti")
    spread = spread_files(pending, *STATE, "path")
    walked = spread.mapInArrow(_walk, SCHEMA)
    if not pending.isEmpty():
        walked.write.parquet(f"{index}/v={uuid.uuid4().hex}")
        stored = _stored(spark, index)
    if stored is None:
        return spark.createDataFrame([], SCHEMA)
    known = stored.where("member IS NULL").groupBy(*STATE).agg(F.min("v").alias("v"))
    # One row per shard; what is joined to it is not moved unless there are too many shards to send to all tasks.
    current = known.join(files.select(*STATE), list(STATE), "left_semi")
    return stored.join(current, [*STATE, "v"]).drop("v")


def indexed_members(files: DataFrame, index: str) -> DataFrame:
    """``(shard, member, header, offset, size, ordinal)`` of the members of complete shards, from the index."""
    return refresh_index(files, index).where("member IS NOT NULL").select("shard", "member", "header", "offset", "size", "ordinal")


def indexed_report(files: DataFrame, index: str) -> DataFrame:
    """``(shard, ok, n, error)`` as an integrity check by walking gives it, from the index."""
    closing = refresh_index(files, index).where("member IS NULL")
    return closing.select("shard", F.col("error").isNull().alias("ok"), "n", "error")


def verify_members(files: DataFrame, index: str) -> DataFrame:
    """``(shard, ok, n, error)``: the headers of all members read again at their places, a shard's by many tasks.

    Each header's checksum has to be right, its size that of the index, and the closing block has to be empty. ``error``
    names the first header that is not, by place.
    """
    rows = refresh_index(files, index)
    broken = rows.where("error IS NOT NULL").select("shard", F.lit(False).alias("ok"), "n", "error")
    sound = rows.where("error IS NULL").select("shard", *STATE[1:], "member", "header", "offset", "size")
    placed = sound.join(files.select(*STATE, "path"), list(STATE)).select("shard", "path", "member", "header", "offset", "size")
    tasks = max(payload_tasks(files.sparkSession), -(-placed.count() // TASK_HEADERS))
    dealt = placed.repartitionByRange(tasks, "shard", "header").sortWithinPartitions("shard", "header")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, handle = None, None
        for batch in batches:
            found = []
            for shard, path, member, header, offset, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != opened:
                    if handle is not None:
                        handle.close()
                    files_, local = _filesystem(path)
                    opened, handle = path, files_.open_input_file(local)
                found.append((shard, header, member is not None, _wrong(handle, member, header, offset, size)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*found), (pa.string(), pa.int64(), pa.bool_(), pa.string()))],
                names=["shard", "header", "is_member", "error"],
            )
        if handle is not None:
            handle.close()

    checked = dealt.mapInArrow(check, "shard string, header bigint, is_member boolean, error string")
    report = checked.groupBy("shard").agg(
        F.count(F.when(F.col("error").isNotNull(), 1)).alias("_bad"), F.count(F.when(F.col("is_member"), 1)).alias("n"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("header"))).alias("error"),
    )
    return report.select("shard", (F.col("_bad") == 0).alias("ok"), "n", "error").unionByName(broken)


def _wrong(handle, member: str | None, header: int, offset: int | None, size: int | None) -> str | None:
    """What is wrong with the header, or with the closing block where there is no member."""
    # Long names take blocks of their own; the member's header is the last block before its bytes.
    handle.seek(header if member is None else offset - tarfile.BLOCKSIZE)
    block = handle.read(tarfile.BLOCKSIZE)
    if member is None:
        return None if len(block) == tarfile.BLOCKSIZE and not any(block) else f"no end of archive at {header}"
    try:
        info = tarfile.TarInfo.frombuf(block, "utf-8", "surrogateescape")
    except tarfile.HeaderError as problem:
        return f"{type(problem).__name__} at {header}: {problem}"
    if info.size != size or (offset - header == tarfile.BLOCKSIZE and info.name != member):
        return f"another member at {header}"
    return None
