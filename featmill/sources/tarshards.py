"""Tar shards as a Spark data source, ``spark.read/df.write.format("tarshards")``.

Reading gives one row per archive member: ``shard`` (path below the root), ``member``, the ``offset`` and
``size`` of its bytes in the archive, and the bytes as ``data``. A shard is split by byte range: every task
walks the 512-byte member headers, which seeks over the payloads, and reads the payloads of the members that
start inside its own range. One oversized shard therefore is read by many tasks, and no task ever holds a
whole shard.

A listing also gives each member's ``ordinal``, its position in the name order of its shard, which the task that
walks the shard knows by itself; it is null where bytes are read, because several tasks may share a shard then.

With the option ``pushdown``, filters on ``shard``, ``member``, ``offset``, ``size`` and, in listings, ``ordinal`` are pushed down: shards that
cannot match are not opened, and of other members no byte is read. It is off by default, because Spark 4.1 keeps one set of
pushed filters per DataFrame read from a Python source: it is right for a DataFrame that is used once in a plan and always
under the same filters, and wrong for one that is joined with itself under others. ``pattern`` and ``members`` belong to the
source itself and are always safe.

Options: ``path``; ``pattern``, shell-style on the file name, e.g. ``*-train.tar`` (default ``*.tar``); ``members``, shell-style
on the member name, which listings also count by (default ``*``);
``payload=false`` to list members without touching their bytes (``data`` is null; :func:`fetch_members` reads
the bytes of chosen members afterwards); ``splitBytes``, the most one task reads (default 512 MiB);
``parallelism``, the least number of tasks to aim for. Small shards are packed together, each counted with
the cost of opening it.

Writing expects ``shard``, ``member`` and ``data`` with the rows of a shard next to each other in one task;
:func:`write_shards` arranges that. Shards of one file name in different folders are filled side by side, so one pass
over a shard's samples can write several sets of them. Each shard is written under a name no reader lists and renamed when
complete, so a lost or repeated task leaves no half shard behind.
"""

from __future__ import annotations

import fnmatch
import tarfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import BinaryType, StructField, StructType

from featmill.session import materialize, qualified

SCHEMA = "shard string, member string, offset bigint, size bigint, ordinal bigint, data binary"
# A batch is handed to Spark at this many rows or bytes, whichever comes first.
BATCH_ROWS, BATCH_BYTES = 1024, 32 << 20
# Bytes of an archive gathered before they are written.
WRITE_BYTES = 1 << 16
# Opening a shard counts like reading this many bytes.
OPEN_COST = 1 << 20


def _filesystem(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def list_shards(path: str, pattern: str = "*.tar") -> list[tuple[str, int]]:
    """Shard paths below ``path`` with their sizes, in lexical order."""
    from pyarrow import fs

    files, base = _filesystem(path)
    found = files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    base = base.rstrip("/") + "/"
    shards = [
        (info.path[len(base) :], info.size)
        for info in found
        if info.is_file and fnmatch.fnmatchcase(info.base_name, pattern)
    ]
    return sorted(shards)


def walk_members(handle) -> Iterator[tuple[tarfile.TarFile, tarfile.TarInfo]]:
    """Members of an open archive in file order, reading headers only."""
    with tarfile.open(fileobj=handle, mode="r:") as tar:
        while (info := tar.next()) is not None:
            if info.isfile():
                yield tar, info
            tar.members.clear()


def count_members(handle) -> int:
    """Members of a complete archive; raises ``tarfile.ReadError`` for one that is cut off or not an archive.

    An archive that stops between two members still reads without an error; only the closing block of zeros
    tells that its writer finished.
    """
    members = 0
    with tarfile.open(fileobj=handle, mode="r:") as tar:
        while (info := tar.next()) is not None:
            members += info.isfile()
            tar.members.clear()
        handle.seek(tar.offset)
        closing = handle.read(tarfile.BLOCKSIZE)
    if len(closing) < tarfile.BLOCKSIZE or any(closing):
        raise tarfile.ReadError("no end of archive")
    return members


@dataclass
class ShardRanges(InputPartition):
    """Byte ranges of shards, as ``(shard, start, end)``."""

    ranges: list[tuple[str, int, int]]


def pack_ranges(
    shards: list[tuple[str, int]], split_bytes: int, parallelism: int, split: bool = True
) -> list[ShardRanges]:
    """Cut large shards and pack small ones into ranges of about equal cost, in shard order."""
    total = sum(size + OPEN_COST for _, size in shards)
    step = max(1, min(split_bytes, max(OPEN_COST, total // max(parallelism, 1))))
    packed: list[ShardRanges] = []
    ranges, cost = [], 0
    for shard, size in shards:
        width = step if split else max(size, 1)
        for start in range(0, max(size, 1), width):
            part = min(width, size - start) + OPEN_COST
            if ranges and cost + part > step + OPEN_COST:
                packed.append(ShardRanges(ranges))
                ranges, cost = [], 0
            ranges.append((shard, start, start + width))
            cost += part
    if ranges:
        packed.append(ShardRanges(ranges))
    return packed


# What a pushed filter asks of a value that is never null.
_ASKS = {
    EqualTo: lambda v, x: v == x,
    EqualNullSafe: lambda v, x: v == x,
    GreaterThan: lambda v, x: v > x,
    GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x,
    LessThanOrEqual: lambda v, x: v <= x,
    In: lambda v, x: v in x,
    StringStartsWith: lambda v, x: v.startswith(x),
    StringEndsWith: lambda v, x: v.endswith(x),
    StringContains: lambda v, x: x in v,
    IsNotNull: lambda v, x: True,
}


def asked(f: Filter, columns: tuple[str, ...]) -> tuple[str, Callable] | None:
    """``(column, test)`` of a filter on one of ``columns``; None for one that Spark has to apply itself."""
    if isinstance(f, Not):
        inner = asked(f.child, columns)
        return None if inner is None or isinstance(f.child, IsNotNull) else (inner[0], lambda v: not inner[1](v))
    test = _ASKS.get(type(f))
    if test is None or len(f.attribute) != 1 or f.attribute[0].lower() not in columns:
        return None
    value = getattr(f, "value", None)
    if value is None and not isinstance(f, IsNotNull):
        return None
    if isinstance(f, In):
        if any(x is None for x in value):
            return None
        value = set(value)
    return f.attribute[0].lower(), lambda v: test(v, value)


class TarShardReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.pattern = options.get("pattern", "*.tar")
        self.members = options.get("members", "*")
        self.payload = options.get("payload", "true").lower() == "true"
        self.pushdown = options.get("pushdown", "false").lower() == "true"
        self.split_bytes = int(options.get("splitbytes", 512 << 20))
        self.parallelism = int(options.get("parallelism", 8))
        self.filters: list[Filter] = []

    def _columns(self) -> tuple[str, ...]:
        return ("shard", "member", "offset", "size", *(() if self.payload else ("ordinal",)))

    def pushFilters(self, filters):
        for f in filters:
            if not self.pushdown or asked(f, self._columns()) is None:
                yield f
            else:
                self.filters.append(f)

    def _tests(self, *columns: str) -> list[tuple[str, Callable]]:
        return [a for a in (asked(f, self._columns()) for f in self.filters) if a[0] in columns]

    def partitions(self):
        tests = self._tests("shard")
        shards = [(s, size) for s, size in list_shards(self.path, self.pattern) if all(test(s) for _, test in tests)]
        if not self.payload:
            # Headers alone are one cheap walk per shard, whatever its size.
            return pack_ranges([(shard, 0) for shard, _ in shards], self.split_bytes, self.parallelism, split=False)
        return pack_ranges(shards, self.split_bytes, self.parallelism)

    def read(self, partition: ShardRanges):
        if partition is None:
            return
        files, base = _filesystem(self.path)
        by_header, by_place = self._tests("member", "offset", "size"), self._tests("ordinal")

        def wanted(info) -> bool:
            values = {"member": info.name, "offset": info.offset_data, "size": info.size}
            return all(test(values[c]) for c, test in by_header)

        rows, held = [], 0
        for shard, start, end in partition.ranges:
            with files.open_input_file(f"{base.rstrip('/')}/{shard}") as handle:
                if not self.payload:
                    # Numbered before anything is filtered away.
                    for ordinal, info in enumerate(named_members(handle, self.members)):
                        if wanted(info) and all(test(ordinal) for _, test in by_place):
                            rows.append((shard, info.name, info.offset_data, info.size, ordinal, None))
                            if len(rows) >= BATCH_ROWS:
                                yield _batch(rows)
                                rows = []
                    continue
                for tar, info in walk_members(handle):
                    if info.offset >= end:
                        break
                    if info.offset < start or not fnmatch.fnmatchcase(info.name, self.members) or not wanted(info):
                        continue
                    rows.append((shard, info.name, info.offset_data, info.size, None, tar.extractfile(info).read()))
                    held += info.size
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def named_members(handle, pattern: str = "*") -> list[tarfile.TarInfo]:
    """Headers of the members whose names match, in name order; those of one name in file order.

    One archive's headers are held at a time.
    """
    found = [info for _, info in walk_members(handle) if fnmatch.fnmatchcase(info.name, pattern)]
    return sorted(found, key=lambda info: info.name.encode("utf-8", "surrogateescape"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    shard, member, offset, size, ordinal, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(shard, pa.string()),
            pa.array(member, pa.string()),
            pa.array(offset, pa.int64()),
            pa.array(size, pa.int64()),
            pa.array(ordinal, pa.int64()),
            pa.array(data, pa.binary()),
        ],
        names=["shard", "member", "offset", "size", "ordinal", "data"],
    )


@dataclass
class ShardsWritten(WriterCommitMessage):
    shards: int
    members: int


def publish(files, part: str, final: str) -> None:
    """Give a finished file its name; another attempt's file of the same content may be there already."""
    try:
        files.move(part, final)
    except OSError:
        # Some file systems do not rename onto an existing file.
        files.delete_file(final)
        files.move(part, final)


# A header as ``tarfile`` writes it, for a member without a name or bytes, and the sum of its bytes beside the sum's own field.
_PLAIN = tarfile.TarInfo("").tobuf()
_PLAIN_SUM = int(_PLAIN[148:154], 8)


def member_header(name: str, size: int) -> bytes:
    """The header of a member, the same bytes as ``tarfile`` gives. Short plain names are put into a ready header."""
    if not name.isascii() or len(name) > tarfile.LENGTH_NAME or "\0" in name or size >= 8**11:
        info = tarfile.TarInfo(name)
        info.size = size
        return info.tobuf()
    label, digits = name.encode(), b"%011o" % size
    total = _PLAIN_SUM + sum(label) + sum(digits) - 11 * ord("0")
    return b"".join((label, _PLAIN[len(label) : 124], digits, _PLAIN[135:148], b"%06o\0" % total, _PLAIN[155:]))


class Archive:
    """An archive being written; its bytes are those of ``tarfile``, gathered to fewer writes."""

    def __init__(self, files, path: str) -> None:
        self.path, self.members, self.stream = path, 0, files.open_output_stream(path)
        self.parts: list[bytes] = []
        self.held = self.written = 0

    def _put(self, *parts: bytes) -> None:
        self.parts += parts
        self.held += sum(map(len, parts))
        if self.held >= WRITE_BYTES:
            self._flush()

    def _flush(self) -> None:
        # Large members go on their own, not copied once more.
        for whole in self.parts if self.held > 4 * WRITE_BYTES else [b"".join(self.parts)]:
            self.stream.write(whole)
        self.written, self.held = self.written + self.held, 0
        self.parts.clear()

    def add(self, member: str, data: bytes) -> None:
        self._put(member_header(member, len(data)), data, bytes(-len(data) % tarfile.BLOCKSIZE))
        self.members += 1

    def close(self) -> None:
        self._put(bytes(2 * tarfile.BLOCKSIZE))
        self._put(bytes(-(self.written + self.held) % tarfile.RECORDSIZE))
        self._flush()
        self.stream.close()


def fill_archives(
    files, base: str, iterator: Iterator[pa.RecordBatch], arranged: bool = True
) -> Iterator[tuple[str, str, int]]:
    """Write rows to archives under names that no reader lists; gives ``(shard, name, members)`` of each that is complete.

    Shards of one file name in several folders fill side by side; one of another file name completes those before it. Rows that
    are not ``arranged`` keep all their shards open to the end.
    """
    opened: dict[str, Archive] = {}
    folders: set[str] = set()

    def complete() -> Iterator[tuple[str, str, int]]:
        for name, archive in opened.items():
            archive.close()
            yield name, archive.path, archive.members
        opened.clear()

    for batch in iterator:
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("shard", "member", "data")]
        for i in range(batch.num_rows):
            shard, member, data = (column[i].as_py() for column in columns)
            if shard not in opened:
                if arranged and any(name.rsplit("/", 1)[-1] != shard.rsplit("/", 1)[-1] for name in opened):
                    yield from complete()
                part = f"{base}/{shard}.{uuid.uuid4().hex}.part"
                folder = part.rsplit("/", 1)[0]
                if folder not in folders:
                    files.create_dir(folder, recursive=True)
                    folders.add(folder)
                opened[shard] = Archive(files, part)
            opened[shard].add(member, data)
    yield from complete()


class TarShardWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> ShardsWritten:
        files, base = _filesystem(self.path)
        base = base.rstrip("/")
        shards = total = 0
        for shard, part, members in fill_archives(files, base, iterator):
            publish(files, part, f"{base}/{shard}")
            shards, total = shards + 1, total + members
        return ShardsWritten(shards, total)


class TarShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tarshards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TarShardReader:
        return TarShardReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> TarShardWriter:
        return TarShardWriter(self.options)

    def streamReader(self, schema: StructType):
        from featmill.sources.tarstream import TarShardStreamReader

        return TarShardStreamReader(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool):
        from featmill.sources.tarstream import TarShardStreamWriter

        return TarShardStreamWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make ``tarshards`` known to the session, and let sources take filters where they are asked to."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TarShards)


def read_shards(
    spark: SparkSession, path: str, pattern: str = "*.tar", payload: bool = True, members: str = "*", pushdown: bool = False
) -> DataFrame:
    """One row per member, whose name matches ``members``, of the shards below ``path``."""
    register(spark)
    return (
        spark.read.format("tarshards")
        .option("pattern", pattern)
        .option("members", members)
        .option("payload", str(payload).lower())
        .option("pushdown", str(pushdown).lower())
        .option("parallelism", spark.sparkContext.defaultParallelism)
        .load(qualified(spark, path))
    )


# Payload bytes a task is given, and those it holds at a time.
TASK_BYTES, FETCH_BYTES = 1 << 29, 1 << 26


def payload_tasks(spark: SparkSession, listed: DataFrame | None = None, size: str = "size") -> int:
    """Tasks for work whose rows are small but whose payloads are not.

    An explicit number, as adaptive execution would merge the partitions of a listing into a single one. With a
    listing it follows the bytes listed; they are added up by a job of its own, which reads no payload.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if listed is None or size not in listed.columns:
        return tasks
    total = listed.agg(F.sum(size)).first()[0] or 0
    return max(tasks, -(-total // TASK_BYTES))


def shard_of(spark: SparkSession, root: str) -> Column:
    """Name of the shard in a file's ``path``: what follows the root folder."""
    return F.replace(F.col("path"), F.lit(qualified(spark, root).rstrip("/") + "/"), F.lit(""))


# Shards whose headers one task walks where there are very many, as many as a listing packs together; tasks for each core that
# write down which shards those are.
TASK_SHARDS, LISTING_TASKS = 512, 4


def spread_files(files: DataFrame, *columns: str) -> DataFrame:
    """``(columns...)`` of shard files, dealt out to tasks by their number, at least one for each core while there are files.

    Spark packs a folder's files by the cost of opening them, a few dozen to a task. Their names are written by a few tasks first,
    so that the shuffle does not have a piece for each two of very many tasks.
    """
    spark = files.sparkSession
    rows = files.select(*columns)
    if files.isStreaming:
        return rows.repartition(payload_tasks(spark), columns[-1])
    cores = spark.sparkContext.defaultParallelism
    rows = materialize(rows.coalesce(LISTING_TASKS * cores), "files")
    number = rows.count()
    tasks = max(1, min(number, max(cores, -(-number // TASK_SHARDS))))
    return rows.repartition(tasks, columns[-1])


def list_members(files: DataFrame) -> DataFrame:
    """``(shard, member, offset, size, ordinal)`` of the given shard files ``(shard, path)``, from their headers.

    Like a listing by :func:`read_shards`, for shards that a query has chosen.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for shard, path in zip(*(batch.column(names.index(c)).to_pylist() for c in ("shard", "path")), strict=True):
                handles, local = _filesystem(path)
                with handles.open_input_file(local) as handle:
                    found = named_members(handle)
                for start in range(0, len(found), BATCH_ROWS):
                    part = enumerate(found[start : start + BATCH_ROWS], start)
                    rows = [(shard, info.name, info.offset_data, info.size, k, None) for k, info in part]
                    yield _batch(rows).drop_columns(["data"])

    spread = spread_files(files, "shard", "path")
    return spread.mapInArrow(walk, "shard string, member string, offset bigint, size bigint, ordinal bigint")


def arrange(members: DataFrame, shard: str = "shard", member: str = "member") -> DataFrame:
    """Bring the rows of each shard together, in member order, ready for ``write_shards(arranged=True)``.

    Done on a listing before the payloads are fetched, it saves shuffling them.
    """
    return members.repartition(payload_tasks(members.sparkSession, members), shard).sortWithinPartitions(shard, member)


def bounded_runs(sizes: list[int], most: int = FETCH_BYTES) -> Iterator[tuple[int, int]]:
    """``(start, end)`` of consecutive runs of rows with at most ``most`` bytes; a larger row is a run of its own."""
    start, held = 0, 0
    for k, size in enumerate(sizes):
        if k > start and held + size > most:
            yield start, k
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def fetch_members(members: DataFrame, path: str, shard: str = "shard", arranged: bool = False) -> DataFrame:
    """Add ``data`` to listed members ``(shard, member, offset, size, ...)`` by reading just their bytes.

    For spot checks and lookups: the cost follows the members asked for, not the shards they are in. The work
    is dealt out by position, so many members of one shard are read by many tasks. ``arranged`` keeps rows
    where they are, for a listing already brought into the order of a write.
    """
    listed = members.drop("data")
    path = qualified(members.sparkSession, path)
    schema = StructType([*listed.schema.fields, StructField("data", BinaryType())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(path)
        base = base.rstrip("/")
        opened, handle = None, None
        for batch in batches:
            names = batch.schema.names
            for start, end in bounded_runs(batch.column(names.index("size")).to_pylist()):
                part = batch.slice(start, end - start)
                places = zip(*(part.column(names.index(c)).to_pylist() for c in (shard, "offset", "size")), strict=True)
                data = []
                for name, offset, size in places:
                    if name != opened:
                        if handle is not None:
                            handle.close()
                        opened, handle = name, files.open_input_file(f"{base}/{name}")
                    handle.seek(offset)
                    data.append(handle.read(size))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], names=[*names, "data"])
        if handle is not None:
            handle.close()

    if not arranged:
        # Read three times: for its bytes, for the borders of the ranges, and for its rows. Headers are walked once.
        listed = materialize(listed, "chosen")
        listed = listed.repartitionByRange(payload_tasks(members.sparkSession, listed), shard, "offset")
        listed = listed.sortWithinPartitions(shard, "offset")
    return listed.mapInArrow(fetch, schema)


def fetch_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Add the bytes of whole files as ``data``, in the tasks and order the rows are in.

    Sizes are asked for first, so that a task holds no more than ``FETCH_BYTES`` at a time, or one larger file.
    """
    schema = StructType([*files.schema.fields, StructField("data", BinaryType())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                some = batch.slice(start, BATCH_ROWS)
                places = [_filesystem(name) for name in some.column(some.schema.names.index(path)).to_pylist()]
                sizes = [handles.get_file_info(local).size or 0 for handles, local in places]
                for begin, end in bounded_runs(sizes):
                    data = []
                    for handles, local in places[begin:end]:
                        with handles.open_input_stream(local) as stream:
                            data.append(stream.read())
                    part = some.slice(begin, end - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], names=[*part.schema.names, "data"])

    return files.mapInArrow(fetch, schema)


def write_shards(df: DataFrame, path: str, existing: DataFrame | None = None, arranged: bool = False) -> None:
    """Write ``(shard, member, data)`` rows as tar shards, members in name order.

    ``existing`` is an integrity report (``shard``, ``ok``): shards that it finds complete are left alone.
    Unless the rows are ``arranged`` already, they are shuffled by shard first.
    """
    spark = df.sparkSession
    register(spark)
    if existing is not None:
        if arranged:
            raise ValueError("leave finished shards out before arranging the others")
        df = df.join(existing.where("ok").select("shard"), "shard", "left_anti")
    rows = df.select(
        "shard",
        "member",
        F.lit(None).cast("bigint").alias("offset"),
        F.length("data").cast("bigint").alias("size"),
        F.lit(None).cast("bigint").alias("ordinal"),
        "data",
    )
    if not arranged:
        rows = rows.repartition("shard").sortWithinPartitions("shard", "member")
    rows.write.format("tarshards").mode("append").save(qualified(spark, path))
