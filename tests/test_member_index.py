"""Filters that go down into the tar source, positions from its listings, and the member index."""

from __future__ import annotations

import io
import os
import tarfile

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from featmill.operators import ordinals as o
from featmill.operators import quality as q
from featmill.sources import member_index as mi
from featmill.sources import tarshards as ts


def write_tar(path, members):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with tarfile.open(path, "w") as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


@pytest.fixture
def folder(tmp_path):
    """Three shards of frames out of order, with notes among them."""
    for s in range(3):
        members = [(f"f{i:03d}.jpg", f"{s}:{i}".encode() * 50) for i in (3, 1, 0, 2, 4)]
        members.insert(2, ("about.txt", b"notes" * 2000))
        members.append(("z" * 150 + ".jpg", b"long name"))
        write_tar(f"{tmp_path}/in/s{s}.tar", members)
    return f"{tmp_path}/in"


class Counting:
    """A file system that counts the bytes read through it."""

    def __init__(self):
        from pyarrow import fs

        self.inner, self.opened, self.bytes = fs.LocalFileSystem(), [], 0

    def open_input_file(self, path):
        self.opened.append(os.path.basename(path))
        outer, handle = self, self.inner.open_input_file(path)

        class Handle(io.RawIOBase):
            def readable(self):
                return True

            def seekable(self):
                return True

            def seek(self, place, whence=0):
                return handle.seek(place, whence)

            def tell(self):
                return handle.tell()

            def read(self, n=-1):
                data = handle.read(n if n is not None and n >= 0 else None)
                outer.bytes += len(data)
                return data

        return Handle()

    def get_file_info(self, selector):
        return self.inner.get_file_info(selector)


def rows_of(reader):
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


def test_a_filter_saves_bytes(folder, monkeypatch):
    files = Counting()
    monkeypatch.setattr(ts, "_filesystem", lambda path: (files, path))
    everything = rows_of(ts.TarShardReader({"path": folder}))
    whole = files.bytes
    files.bytes, files.opened = 0, []
    reader = ts.TarShardReader({"path": folder, "pushdown": "true"})
    asked = [
        ds.StringEndsWith(("member",), ".jpg"), ds.EqualTo(("shard",), "s1.tar"), ds.Not(ds.EqualTo(("member",), "f003.jpg")),
        ds.GreaterThan(("size",), 20), ds.IsNotNull(("member",)), ds.StringContains(("data",), "x"), ds.EqualTo(("ordinal",), 1),
    ]
    # What the source cannot answer is left to Spark: bytes, and positions where bytes are read.
    assert list(reader.pushFilters(asked)) == asked[-2:]
    found = rows_of(reader)
    assert set(files.opened) == {"s1.tar"}
    want = [r for r in everything if r["shard"] == "s1.tar" and r["member"].endswith(".jpg") and r["member"] != "f003.jpg" and r["size"] > 20]
    assert found == want and len(found) == 4
    # Headers aside, only the bytes of the members found are read: none of about.txt.
    headers = 512 * 12
    assert files.bytes <= sum(r["size"] for r in found) + headers < 10_000 < whole


def test_spark_hands_filters_down(spark, folder):
    def read():
        return ts.read_shards(spark, folder, pushdown=True)

    rows = read().where(F.col("member").endswith(".jpg") & (F.col("shard") == "s2.tar"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan
    assert rows.count() == 6
    # Filters on bytes and alternatives stay above the scan, with the same rows.
    assert read().where("member = 'about.txt' OR shard = 's0.tar'").count() == 9
    assert read().where(F.length("data") > 5000).count() == 3


def test_one_scans_filters_are_not_anothers(spark, folder):
    """As they are read by default, in one plan or one after the other."""
    both = ts.read_shards(spark, folder, payload=False)
    first, second = both.where("shard = 's0.tar'"), both.where("ordinal = 2")
    assert [df.count() for df in (both, first, both, second, first, both)] == [21, 7, 21, 3, 7, 21]
    assert first.join(both, "ordinal").count() == 21 and both.union(second).count() == 24


def test_positions_need_no_shuffle(spark, folder):
    listed = ts.read_shards(spark, folder, payload=False)
    nth = q.nth_member(listed, [0, 2, 5])
    assert "Exchange" not in nth._jdf.queryExecution().executedPlan().toString()
    names = ["about.txt", "f000.jpg", "f001.jpg", "f002.jpg", "f003.jpg", "f004.jpg", "z" * 150 + ".jpg"]
    got = {(r["shard"], r["pos"], r["member"]) for r in nth.collect()}
    assert got == {(f"s{s}.tar", p, names[p]) for s in range(3) for p in (0, 2, 5)}
    frames = ts.read_shards(spark, folder, payload=False, members="f*.jpg")
    assert {(r["member"], r["ordinal"]) for r in frames.where("shard = 's0.tar'").collect()} == {(f"f{i:03d}.jpg", i) for i in range(5)}
    kept = o.subsample_listed(frames.drop("data"), "shard", "ordinal", 4)
    every = [(f"s{s}.tar", i) for s in range(3) for i in range(5)]
    assert sorted((r["shard"], r["frame_idx"]) for r in kept.collect()) == every[::4]
    usual = o.subsample_global(frames.select("shard", "member"), "shard", ["member"], 4)
    assert sorted((r["shard"], r["frame_idx"]) for r in usual.collect()) == every[::4]


def test_listing_of_chosen_files_has_positions(spark, folder):
    chosen = q.list_shard_files(spark, folder).where("shard <> 's1.tar'")
    got = ts.list_members(chosen).where("ordinal = 1").collect()
    assert sorted((r["shard"], r["member"]) for r in got) == [("s0.tar", "f000.jpg"), ("s2.tar", "f000.jpg")]
    assert ts.spread_files(chosen, "shard", "path").rdd.getNumPartitions() == 2


def zero_headers(path, keep_time=True):
    """Make every header unreadable without touching the members' bytes, the length or the time."""
    stat = os.stat(path)
    with tarfile.open(path) as tar:
        places = [m.offset_data - 512 for m in tar.getmembers()]
    with open(path, "r+b") as out:
        for place in places:
            out.seek(place)
            out.write(b"\xff" * 512)
    if keep_time:
        os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))


def test_headers_are_walked_once(spark, folder, tmp_path):
    index = str(tmp_path / "index")

    def files():
        return q.list_shard_files(spark, folder)

    before = {(r["shard"], r["member"]): bytes(r["data"]) for r in ts.read_shards(spark, folder).collect()}
    first = mi.indexed_members(files(), index)
    assert first.count() == 21 and len([n for n in os.listdir(index) if n.startswith("v=")]) == 1
    zero_headers(f"{folder}/s1.tar")
    # Nothing needs the headers any more: listing, integrity, positions and payloads come from the index.
    again = mi.indexed_members(files(), index)
    assert {(r["shard"], r["member"]): bytes(r["data"]) for r in ts.fetch_members(again, folder).collect()} == before
    assert all(r["ok"] and r["n"] == 7 for r in mi.indexed_report(files(), index).collect())
    assert q.nth_member(again, [1]).where("member = 'f000.jpg'").count() == 3
    assert len([n for n in os.listdir(index) if n.startswith("v=")]) == 1
    # Checking the places again finds them.
    found = {r["shard"]: r for r in mi.verify_members(files(), index).collect()}
    assert found["s0.tar"]["ok"] and found["s2.tar"]["ok"] and found["s0.tar"]["n"] == 7
    assert not found["s1.tar"]["ok"] and " at 0" in found["s1.tar"]["error"]
    # A shard that has changed is walked again, a new one for the first time, and both states stay in the table.
    write_tar(f"{folder}/s1.tar", [("new.jpg", b"x")])
    write_tar(f"{folder}/sub/s3.tar", [("more.jpg", b"y" * 600)])
    with open(f"{folder}/s4.tar", "wb") as out:
        out.write(b"no archive" * 100)
    report = {r["shard"]: (r["ok"], r["n"]) for r in mi.indexed_report(files(), index).collect()}
    assert report == {"s0.tar": (True, 7), "s1.tar": (True, 1), "s2.tar": (True, 7), "sub/s3.tar": (True, 1), "s4.tar": (False, 0)}
    assert mi.indexed_members(files(), index).count() == 16
    walked = {r["shard"]: (r["ok"], r["n"]) for r in q.shard_integrity(files()).collect()}
    assert walked == report
    assert {r["shard"]: r["ok"] for r in mi.verify_members(files(), index).collect()} == {s: ok for s, (ok, _) in report.items()}


def test_one_shard_is_checked_by_many_tasks(spark, tmp_path, monkeypatch):
    write_tar(f"{tmp_path}/in/big.tar", [(f"m{i:05d}", b"x" * (i % 7)) for i in range(3000)])
    files = q.list_shard_files(spark, f"{tmp_path}/in")
    index = str(tmp_path / "index")
    mi.refresh_index(files, index)
    path = f"{tmp_path}/in/big.tar"
    stat = os.stat(path)
    with tarfile.open(path) as tar:
        place = tar.getmember("m02000").offset
    with open(path, "r+b") as out:
        out.seek(place + 124)
        out.write(b"7")
    os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    monkeypatch.setattr(mi, "TASK_HEADERS", 100)
    [row] = mi.verify_members(files, index).collect()
    assert not row["ok"] and row["n"] == 3000 and f"at {place}" in row["error"]


def test_index_without_shards(spark, tmp_path):
    files = spark.createDataFrame([], "shard string, path string, length bigint, modified bigint")
    assert mi.indexed_members(files, str(tmp_path / "index")).count() == 0
    assert mi.indexed_report(files, str(tmp_path / "index")).count() == 0


def test_whole_files_are_fetched_in_bounded_runs(spark, tmp_path, monkeypatch):
    sizes = [10, 5_000, 0, 300, 40_000, 1, 1]
    for k, size in enumerate(sizes):
        (tmp_path / f"f{k}").write_bytes(bytes([k]) * size)
    df = spark.createDataFrame([(k, str(tmp_path / f"f{k}")) for k in range(len(sizes))], "k int, path string")
    got = {r["k"]: bytes(r["data"]) for r in ts.fetch_files(df).collect()}
    assert got == {k: bytes([k]) * size for k, size in enumerate(sizes)}
    assert list(ts.bounded_runs(sizes, 6_000)) == [(0, 4), (4, 5), (5, 7)]
