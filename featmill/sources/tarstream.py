"""Tar shards as a stream and as the sink of one, ``spark.readStream/df.writeStream.format("tarshards")``.

Source: an offset counts the entries of a log. When a trigger looks for new shards, those that no entry names yet are
written down as the next entry, and only then offered; an entry's shards are read by byte ranges like any others. So a shard
is read by exactly one trigger, whichever order shards arrive in and whatever their times are, and a trigger that is repeated
after a crash reads the same shards again. What one trigger finds beyond its share waits for the next ones, and the folder is
listed again when nothing waits. Options: those of the batch source; ``log``, a folder of its own for each
query that has to live as long as its checkpoint; ``maxShards``, the most a trigger takes.

Sink: tasks write shards under names that no reader lists, and the trigger's commit gives them their names, which carry the
number of the trigger. A trigger that is repeated gives the same names again, so nothing is there twice. Rows
of one shard have to be in one task; they need no order, which streams cannot give, so a task keeps the shards of a trigger
that are its own open at the same time.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql.datasource import DataSourceStreamArrowWriter, DataSourceStreamReader, WriterCommitMessage

from featmill.sources.tarshards import (
    ShardRanges,
    TarShardReader,
    _filesystem,
    fill_archives,
    list_shards,
    pack_ranges,
    publish,
)


class ArrivalLog:
    """Numbered entries of ``[shard, size]`` lists, each in a file that appears when it is complete."""

    def __init__(self, path: str) -> None:
        self.path = path

    def last(self) -> int:
        from pyarrow import fs

        files, base = _filesystem(self.path)
        found = files.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return max((int(info.base_name) for info in found if info.base_name.isdigit()), default=0)

    def entry(self, number: int) -> list[tuple[str, int]]:
        files, base = _filesystem(self.path)
        with files.open_input_stream(f"{base.rstrip('/')}/{number}") as stream:
            return [tuple(x) for x in json.loads(stream.read())]

    def entries(self, after: int, upto: int) -> list[tuple[str, int]]:
        return [shard for number in range(after + 1, upto + 1) for shard in self.entry(number)]

    def add(self, shards: list[tuple[str, int]]) -> None:
        files, base = _filesystem(self.path)
        base, number = base.rstrip("/"), self.last() + 1
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{base}/{number}.part") as stream:
            stream.write(json.dumps(shards).encode())
        publish(files, f"{base}/{number}.part", f"{base}/{number}")


class TarShardStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        if "log" not in options:
            raise ValueError("a stream of shards needs the option log")
        self.reader = TarShardReader({**options, "payload": "true", "pushdown": "false"})
        self.log = ArrivalLog(options["log"])
        self.most = int(options.get("maxshards", 0))
        self.known: set[str] | None = None
        # Shards that a listing has found and no entry names yet.
        self.waiting: Iterator[tuple[str, int]] = iter(())

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        last = self.log.last()
        if self.known is None:
            self.known = {shard for shard, _ in self.log.entries(0, last)}
        new = self.share()
        if not new:
            found = list_shards(self.reader.path, self.reader.pattern)
            self.waiting = iter([s for s in found if s[0] not in self.known])
            new = self.share()
        if not new:
            return {"entry": last}
        self.log.add(new)
        self.known.update(shard for shard, _ in new)
        return {"entry": last + 1}

    def share(self) -> list[tuple[str, int]]:
        return list(islice(self.waiting, self.most or None))

    def partitions(self, start: dict, end: dict) -> list[ShardRanges]:
        shards = self.log.entries(start["entry"], end["entry"])
        return list(pack_ranges(sorted(shards), self.reader.split_bytes, self.reader.parallelism))

    def read(self, partition: ShardRanges) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)


@dataclass
class PartsWritten(WriterCommitMessage):
    """``(shard, hidden name)`` of what a task has written."""

    parts: list[tuple[str, str]]


class TarShardStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> PartsWritten:
        files, base = _filesystem(self.path)
        return PartsWritten([(shard, part) for shard, part, _ in fill_archives(files, base.rstrip("/"), iterator, arranged=False)])

    def commit(self, messages: list[PartsWritten | None], batchId: int) -> None:
        files, base = _filesystem(self.path)
        parts = [p for message in messages if message is not None for p in message.parts]
        twice = sorted(shard for shard, n in Counter(shard for shard, _ in parts).items() if n > 1)
        if twice:
            self.abort(messages, batchId)
            raise ValueError(f"rows of one shard come from several tasks: {twice[:5]}")
        for shard, part in parts:
            publish(files, part, f"{base.rstrip('/')}/{shard.removesuffix('.tar')}-{batchId:06d}.tar")

    def abort(self, messages: list[PartsWritten | None], batchId: int) -> None:
        files, _ = _filesystem(self.path)
        for message in messages:
            for _, part in message.parts if message is not None else ():
                files.delete_file(part)
