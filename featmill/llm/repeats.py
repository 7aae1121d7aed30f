"""Substring dedup: remove passages that also stand in a document with a smaller id.

Every run of 50 words of every text gets a Rabin-Karp hash. A task drops what repeats inside its own documents and
hands each bucket of hashes, in one piece, what is left: the hashes, document by document. The bucket's task sorts
them and knows which document has each hash first; the others get the hash back. A document's hashes that came back
mark the windows to remove, and overlapping windows merge into maximal intervals.

A bucket is chosen by a second hash of the window, so what decides is 64 bits and the logarithm of the number of
buckets, which grows with the data. A window that a great many documents share is at most one entry per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmill.llm.common import blank_words, even_keys, mixed, partitions, rolling, text_of, word_hashes

# Words in a window; windows a task holds before it hands them on; documents to an output batch.
WIDTH, HELD, ROWS = 50, 3_000_000, 512
_BASE, _SECOND = 0x5851F42D4C957F2D, 0x14057B7EF767814F
_LAST = (1 << 63) - 1  # stands for a null id


def _windows(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return mixed(rolling(h, width, _BASE)), mixed(rolling(h, width, _SECOND))


def _packed(docs: np.ndarray, hashes: np.ndarray) -> bytes:
    """Ids and hashes, sorted by id: the ids with their numbers of hashes compressed, then the hashes."""
    ids, counts = np.unique(docs, return_counts=True)
    head = zstandard.compress(np.concatenate((np.diff(ids, prepend=0), counts)).astype("<i8").tobytes(), 1)
    return len(head).to_bytes(8, "little") + head + hashes.astype("<u8").tobytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    head = np.frombuffer(zstandard.decompress(blob[8 : 8 + n]), "<i8").reshape(2, -1)
    return np.repeat(np.cumsum(head[0]), head[1]), np.frombuffer(blob[8 + n :], "<u8")


def _later(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by (hash, id) without repeats: first ones ``(ids, hashes)``, and those of larger ids."""
    order = np.lexsort((docs, hashes))
    docs, hashes = docs[order], hashes[order]
    fresh = np.ones(len(docs), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    first = docs[np.maximum.accumulate(np.where(fresh, np.arange(len(docs)), 0))]
    own = fresh.copy()
    own[1:] |= docs[1:] != docs[:-1]
    later = own & (docs != first)
    return docs[fresh], hashes[fresh], docs[later], hashes[later]


def find_repeats(docs: DataFrame, width: int, buckets: list[int], homes: list[int]) -> DataFrame:
    """``(home, blob)``: ids with the hashes of their windows that a document with a smaller id has too."""

    def by_home(ids: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, bytes]]:
        home = mixed(ids.astype(np.int64).view(np.uint64)) % np.uint64(len(homes))
        order = np.lexsort((ids, home))
        ids, hashes, home = ids[order], hashes[order], home[order].astype(np.int64)
        edges = np.flatnonzero(np.diff(home, prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(home)]):
            yield homes[home[a]], _packed(ids[a:b], hashes[a:b])

    def table(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        kind, key, blob = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(blob, pa.binary())], names=["kind", "key", "blob"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        total = 0

        def hand_on() -> pa.RecordBatch:
            ids, one, two = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            bucket = (two % np.uint64(len(buckets))).astype(np.int64)
            rows, away = [], []
            order = np.argsort(bucket, kind="stable")
            ids, one, bucket = ids[order], one[order], bucket[order]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(bucket)]):
                first_ids, first, later_ids, later = _later(ids[a:b], one[a:b])
                by_id = np.argsort(first_ids, kind="stable")
                rows.append((0, buckets[bucket[a]], _packed(first_ids[by_id], first[by_id])))
                away.append((later_ids, later))
            later_ids, later = (np.concatenate(x) for x in zip(*away, strict=True))
            return table(rows + [(1, home, blob) for home, blob in by_home(later_ids, later)])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            flat, ends = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            for k in range(batch.num_rows):
                one, two = _windows(flat[ends[k] : ends[k + 1]], width)
                if len(one):
                    one, place = np.unique(one, return_index=True)
                    held.append((np.full(len(one), ids[k]), one, two[place]))
                    total += len(one)
                    if total >= HELD:
                        yield hand_on()
                        total = 0
        if held:
            yield hand_on()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition holds one bucket, and pieces that only pass on their way home."""
        parts = []
        for batch in batches:
            whole = batch.column(0).to_numpy() == 0
            parts += [_unpacked(blob.as_py()) for blob in batch.column(2).filter(pa.array(whole))]
            yield batch.filter(pa.array(~whole))
        if parts:
            ids, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
            _, _, later_ids, later = _later(ids, hashes)
            yield table([(1, home, blob) for home, blob in by_home(later_ids, later)])

    hashes = docs.select(
        F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), F.transform(blank_words(text_of("text")), lambda w: F.xxhash64(w)).alias("h")
    )
    shape = "kind int, key bigint, blob binary"
    dealt = hashes.mapInArrow(count, shape).repartition(len(buckets), "key")
    return dealt.mapInArrow(resolve, shape).select("key", "blob")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, n_words, removed, text)`` for each row of ``docs(doc_id, text)``; other columns are not read.

    ``removed`` holds the maximal intervals ``(start, end)`` of removed words, counted from 0, end exclusive; ``text``
    the kept words joined by one space. Words are runs of characters other than space and U+0009 to U+000D; a null
    text has none. A null id counts as larger than all others. Rows with equal ids are no copies of each other; each
    loses what a smaller id has. Texts under ``width`` words lose nothing.

    Texts travel once, compressed, to the partition that their ids' pieces come home to, and are read there one by one.
    """
    spark = docs.sparkSession
    keys = even_keys(spark, partitions(spark))

    def parcel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(1).compress
        for batch in batches:
            ids = batch.column(0)
            codes = ids.fill_null(_LAST).to_numpy()
            home = mixed(codes.astype(np.int64).view(np.uint64)) % np.uint64(len(keys))
            key = np.array(keys, np.int64)[home.astype(np.int64)]
            blobs = [pack((t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(np.ones(len(key), np.int32)), ids, pa.array(blobs, pa.binary())],
                names=["key", "kind", "doc_id", "blob"],
            )

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pieces of a partition come first, then its documents."""
        unpack, pieces, ids, hashes = zstandard.ZstdDecompressor().decompress, [], None, None
        out: list[tuple] = []

        def hand_on() -> pa.RecordBatch:
            interval = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            columns = list(zip(*out, strict=True))
            out.clear()
            kinds = (pa.int64(), pa.int64(), pa.list_(interval), pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_words", "removed", "text"]
            )

        for batch in batches:
            kinds, owners, blobs = (batch.column(i) for i in (1, 2, 3))
            for k in range(batch.num_rows):
                if kinds[k].as_py() == 0:
                    pieces.append(_unpacked(blobs[k].as_py()))
                    continue
                if ids is None:
                    ids, hashes = (np.concatenate(x) for x in zip(*pieces, strict=True)) if pieces else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                    order = np.argsort(ids, kind="stable")
                    ids, hashes = ids[order], hashes[order]
                    pieces.clear()
                owner = owners[k].as_py()
                code = _LAST if owner is None else owner
                mine = hashes[np.searchsorted(ids, code) : np.searchsorted(ids, code, "right")]
                words = unpack(blobs[k].as_py()).split()
                removed, kept = [], words
                if len(mine):
                    starts = np.flatnonzero(np.isin(_windows(word_hashes(words), width)[0], mine))
                    removed, kept = _cut(words, starts, width)
                out.append((owner, len(words), [{"start": a, "end": b} for a, b in removed], b" ".join(kept).decode()))
                if len(out) >= ROWS:
                    yield hand_on()
        if out:
            yield hand_on()

    pieces = find_repeats(docs, width, keys, keys).select(
        "key", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("doc_id"), "blob"
    )
    texts = docs.select("doc_id", "text").mapInArrow(parcel, "key bigint, kind int, doc_id bigint, blob binary")
    met = pieces.union(texts).repartition(len(keys), "key").sortWithinPartitions("kind")
    return met.mapInArrow(
        clean, "doc_id bigint, n_words bigint, removed array<struct<start:bigint,end:bigint>>, text string"
    )


def _cut(words: list[bytes], starts: np.ndarray, width: int) -> tuple[list[tuple[int, int]], list[bytes]]:
    """Maximal intervals covered by windows at ``starts``, and the words outside them."""
    if not len(starts):
        return [], words
    breaks = np.flatnonzero(np.diff(starts) > width)
    begins = starts[np.concatenate(([0], breaks + 1))].tolist()
    ends = (starts[np.concatenate((breaks, [len(starts) - 1]))] + width).tolist()
    kept, at = [], 0
    for a, b in zip(begins, ends, strict=True):
        kept += words[at:a]
        at = b
    return list(zip(begins, ends, strict=True)), kept + words[at:]
