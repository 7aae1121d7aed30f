"""MinHash near-dedup with min-max hashing.

A text's set is its distinct runs of five words. Under each of 48 permutations of the 64-bit hashes a set keeps both
its smallest and its largest value: 96 signature values for 48 evaluations, each equal in two sets with a chance of
their Jaccard similarity. Bands of four values (two permutations) make 24 keys; sets of similarity 0.85 share one with
a chance of 1 - 2e-8.

Rows are numbered once; a row is known by its doc_id, which may be null or repeat, and the 128-bit digest of its text.
Rows with equal sets form a class, and only its representative, the row of the smallest id, goes on. Representatives
that share a key are compared on their full sets, but not all pairs of a bucket: every member is first compared with the bucket's
most central member, the one whose keys are the most common, which links a group of copies to its original at once.
Linked representatives are contracted to components. A bucket whose members are all in one component is settled: more
links would change nothing. In the others, members that do not belong to the bucket's largest component are compared
with all members of other components, in blocks: a task holds some of the former and lets the latter pass by, so that
neither a large bucket nor a large component meets in one task. Before that, shingles that only one representative of
such buckets has are counted; they bound a pair's similarity from above, and what cannot reach the threshold is not
compared. No pair that can is given up, so the components are those of all links between representatives that share a
key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmill.llm.common import fresh, materialize, mixed, rolling, rows_once, text_of, word_hashes

# Words in a shingle, permutations, permutations to a band, shingles evaluated at a time.
SHINGLE, PERMUTATIONS, TO_BAND, CHUNK = 5, 48, 2, 1 << 15
# Pairs that share a copy of a hub's set; members a task holds, and members it lets pass by.
PER_TASK, HELD, PASSING = 256, 512, 4096
# Texts whose sets a task holds at a time before it writes them.
SETS = 256
BANDS = PERMUTATIONS // TO_BAND
_BASE = 0x5851F42D4C957F2D


def _factors() -> tuple[np.ndarray, np.ndarray]:
    drawn = mixed(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return drawn[:PERMUTATIONS, None] | np.uint64(1), drawn[PERMUTATIONS:, None]


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of five words; of all words where there are fewer."""
    h = word_hashes((text or "").encode().lower().split())
    if not len(h):
        return h
    return np.unique(mixed(rolling(h, min(SHINGLE, len(h)), _BASE) + np.uint64(min(SHINGLE, len(h)))))


def band_keys(shingles: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = factors
    low, high = np.full(PERMUTATIONS, (1 << 64) - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for start in range(0, len(shingles), CHUNK):
        values = shingles[None, start : start + CHUNK] * a + b
        low, high = np.minimum(low, values.min(axis=1)), np.maximum(high, values.max(axis=1))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in (low[::2], high[::2], low[1::2], high[1::2]):
        keys = mixed(keys * np.uint64(_BASE) + part)
    return keys


def _digest() -> Column:
    """128-bit name of a row's text."""
    return F.unhex(F.md5(text_of("text").cast("binary")))


def signatures(docs: DataFrame) -> DataFrame:
    """``(row, id, digest, n, set, keys)``: number, doc_id and digest of each row, size and 128-bit name of its text's
    set, and its band keys. Rows keep their numbers only once they are written."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        factors = _factors()
        for batch in batches:
            sizes, names, keys = [], [], []
            for text in batch.column(2):
                shingles = shingle_set(text.as_py())
                sizes.append(len(shingles))
                names.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                keys.append(band_keys(shingles, factors).view(np.int64) if len(shingles) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "digest", "n", "set", "keys"],
            )

    rows = docs.select(F.col("doc_id").alias("id"), _digest().alias("digest"), "text")
    signed = rows.mapInArrow(sign, "id bigint, digest binary, n bigint, set binary, keys array<bigint>")
    return signed.select(F.monotonically_increasing_id().alias("row"), "*")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, hub)`` whose sets' intersection is at least ``percent`` of their union.

    A hub's pairs are dealt out in parts, each of which gets one copy of the hub's set.
    """
    size = pairs.groupBy("hub").agg(F.count("*").alias("_n"))
    parts = size.select("hub", F.ceil(F.col("_n") / PER_TASK).cast("int").alias("_parts"))
    left = pairs.join(parts, "hub").withColumn("_part", F.pmod(F.xxhash64("a"), F.col("_parts")).cast("int"))
    left = left.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("one")), "a")
    right = parts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    right = right.join(sets.select(F.col("id").alias("hub"), F.col("shingles").alias("two")), "hub").drop("_parts")
    both = left.join(right, ["hub", "_part"]).select("a", "hub", "one", "two")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(_lists(batch.column(2)), _lists(batch.column(3)), strict=True)
            good = [_linked(x, len(x), y, len(y), percent) for x, y in pairs]
            yield batch.select(["a", "hub"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(alike, "a bigint, hub bigint").distinct()


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def _linked(x: np.ndarray, n: int, y: np.ndarray, m: int, percent: int) -> bool:
    """Whether sets of ``n`` and ``m`` hashes, of which ``x`` and ``y`` may be in both, are similar enough."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (n + m - common)


def _own_shingles(sets: DataFrame) -> DataFrame:
    """``(id, own)``: how many of its hashes no other row of ``sets(id, shingles)`` has; rows without any are left out."""
    each = sets.select("id", F.explode("shingles").alias("h"))
    single = each.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    return single.groupBy("id").agg(F.count("*").cast("int").alias("own"))


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, hub)`` between members of different components of a bucket.

    ``members(key, rep, component)`` lists buckets with several components, ``sets(id, shingles, keys)`` what their
    members have. Each pair is compared in the first bucket that it shares.
    """
    known = materialize(sets.join(_own_shingles(sets), "id", "left").select(
        "id", "shingles", "keys", F.size("shingles").alias("n"), F.coalesce("own", F.lit(0)).alias("own")
    ), "known")
    # A member with too many hashes of its own is linked with nothing.
    possible = known.where((F.col("n") - F.col("own")) * 100 >= F.col("n") * percent).select(F.col("id").alias("rep"))
    members = members.join(possible, "rep")
    shares = members.groupBy("key", "component").agg(F.count("*").alias("here"))
    buckets = shares.groupBy("key").agg(F.max_by("component", F.struct("here", "component")).alias("main"), F.max("here").alias("here"), F.sum("here").alias("all"))
    buckets = buckets.where("here < all").select(
        "key", "main", F.ceil((F.col("all") - F.col("here")) / HELD).cast("int").alias("blocks"), F.ceil(F.col("all") / PASSING).cast("int").alias("lanes")
    )
    placed = members.join(materialize(buckets, "open-buckets"), "key")
    spread = F.xxhash64("rep", F.lit(7))
    held = placed.where("component <> main").select(
        "key", "rep", "component", F.lit(0).alias("kind"), F.pmod(spread, "blocks").cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"),
    )
    passing = placed.select(
        "key", "rep", "component", F.lit(1).alias("kind"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("rep", F.lit(8)), "lanes").cast("int").alias("lane"),
    )
    met = held.select(*passing.columns).union(passing).join(known.withColumnRenamed("id", "rep"), "rep")
    met = met.repartition("key", "block", "lane").sortWithinPartitions("key", "block", "lane", "kind")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, block = None, None
        for batch in batches:
            plain = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "block", "lane", "kind", "rep", "component", "n", "own")}
            shingles, keys = _lists(batch.column("shingles")), _lists(batch.column("keys"))
            links = []
            for k in range(batch.num_rows):
                group = (plain["key"][k], plain["block"][k], plain["lane"][k])
                if group != here:
                    here, block = group, []
                row = (plain["rep"][k], plain["component"][k], int(plain["n"][k]), int(plain["own"][k]), shingles[k], keys[k])
                if plain["kind"][k] == 0:
                    block.append((*row[:4], row[4].copy(), row[5].copy()))
                    continue
                if isinstance(block, list):
                    block = _Block(block)
                links += [(row[0], rep) for rep in block.linked(row, group[0], percent)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "hub"]
            )

    return met.mapInArrow(compare, "a bigint, hub bigint").distinct()


class _Block:
    """Members that a task holds while others pass by."""

    def __init__(self, rows: list[tuple]) -> None:
        self.rows = rows
        self.component, self.n, self.own = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
        self.keys = np.stack([r[5] for r in rows]) if rows else np.zeros((0, BANDS), np.int64)

    def linked(self, row: tuple, key: int, percent: int) -> list[int]:
        rep, component, n, own, shingles, keys = row
        # No more can be common than what neither has for itself, and no less in either than what one has.
        most, least = np.minimum(self.n - self.own, n - own), np.maximum(self.n + own, n + self.own)
        shared = self.keys == keys
        first = shared.any(axis=1) & (self.keys[np.arange(len(self.n)), shared.argmax(axis=1)] == key)
        found = np.flatnonzero((self.component != component) & (100 * most >= percent * least) & first)
        return [self.rows[k][0] for k in found if _linked(shingles, n, self.rows[k][4], self.rows[k][2], percent)]


def connected(links: DataFrame) -> DataFrame:
    """``(id, component)`` of every id in ``links(a, b)``, by large-star and small-star contraction.

    Each round links a node's larger neighbours, then its smaller ones, to the smallest of them all. It ends when
    every node has one link and none is linked to a node that has one itself: that is its component's smallest.
    """
    links = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    while True:
        ends = links.select("a", F.lit(1).alias("up")).union(links.select("b", F.lit(0)))
        per = ends.groupBy("a").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
        if per.where("up > 1 OR (up = 1 AND least = 0)").isEmpty():
            break
        both = links.union(links.select("b", "a"))
        # A component's smallest id has very many links: what is known of an id is written before it is joined to them.
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large, "large")
        floor = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "floor")
        small = large.join(floor, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = materialize(small.union(floor.select("a", F.col("m").alias("b"))).distinct(), "links")
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def _placed(docs: DataFrame, percent: int) -> DataFrame:
    """``(row, id, digest, n, component_id, kept)`` for each row of ``docs(doc_id, text)``."""
    signed = materialize(signatures(docs), "signatures")
    # Null ids last; rows that share an id follow each other in the order of their texts' digests.
    order = F.struct(F.col("id").isNull().alias("missing"), "id", "digest", "row")
    classes = signed.where("n > 0").groupBy("set").agg(F.min(order).alias("first"))
    classes = materialize(classes.select(F.col("first.row").alias("rep"), "set", "first"), "classes")
    reps = signed.join(classes.select("rep"), F.col("row") == F.col("rep"))
    keyed = reps.select("rep", "id", "digest", F.explode("keys").alias("key")).distinct()
    keyed = materialize(keyed, "keyed")
    # Aggregates of a key are written before they are joined to its rows: only then both sides are dealt out by the join
    # alone, and adaptive execution splits a key that a great many rows have.
    buckets = materialize(keyed.groupBy("key").agg(F.count("*").alias("members")), "buckets").where("members > 1")
    keyed = materialize(keyed.join(buckets, "key"), "members")
    members = keyed.select("rep", "key", "members")

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors()
        kind = pa.list_(pa.int64())
        for batch in batches:
            # A text's set is as large as the text: a few are made at a time.
            for start in range(0, batch.num_rows, SETS):
                part = batch.slice(start, SETS)
                found = [shingle_set(t.as_py()) for t in part.column(1)]
                keys = [band_keys(x, factors).view(np.int64) if len(x) else [] for x in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x.view(np.int64) for x in found], kind), pa.array(keys, kind)], names=["id", "shingles", "keys"]
                )

    # Rows that repeat give a representative's text once.
    known = [F.col("id").isNotNull().alias("_known"), F.coalesce("id", F.lit(0).cast("bigint")).alias("_id"), "digest"]
    texts = docs.select(F.col("doc_id").alias("id"), _digest().alias("digest"), "text").select(*known, "text")
    names = keyed.select("rep", "id", "digest").distinct().select(*known, "rep")
    texts = rows_once(texts.join(names, ["_known", "_id", "digest"]), ["_known", "_id", "digest", "rep"], "text")
    sets = materialize(
        texts.select("rep", "text").mapInArrow(as_sets, "id bigint, shingles array<bigint>, keys array<bigint>"), "sets"
    )

    # Every member with the most central member of its bucket.
    centre = members.groupBy("rep").agg(F.sum("members").alias("centre"))
    best = members.join(centre, "rep").groupBy("key").agg(F.min_by("rep", F.struct(-F.col("centre"), F.col("rep"))).alias("hub"))
    best = materialize(best, "hubs")
    pairs = members.join(best, "key").where("rep <> hub")
    tried = materialize(pairs.select(F.col("rep").alias("a"), "hub").distinct(), "pairs")
    found = [materialize(_verified(tried, sets, percent), "links")]
    # What is left to compare lies in buckets that still hold several components.
    parts = connected(found[0].select("a", F.col("hub").alias("b")))
    placed = members.join(parts.withColumnRenamed("id", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")
    )
    placed = materialize(placed, "placed")
    open_keys = placed.groupBy("key").agg(F.min("component").alias("_a"), F.max("component").alias("_b"))
    open_keys = materialize(open_keys, "open-keys").where("_a < _b")
    placed = materialize(placed.join(open_keys.select("key"), "key", "left_semi").select("key", "rep", "component"), "open")
    there = sets.join(placed.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    found.append(materialize(_across(placed, there, percent), "links"))

    links = reduce(DataFrame.union, [f.select("a", F.col("hub").alias("b")) for f in found])
    parts = materialize(connected(links), "components")
    linked = classes.join(parts.withColumnRenamed("id", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")
    )
    linked = materialize(linked, "linked")
    heads = materialize(linked.groupBy("component").agg(F.min("first").alias("head")), "heads")
    heads = linked.join(heads, "component").select("set", F.col("head.id").alias("component_id"), F.col("head.row").alias("head"))
    out = signed.drop("keys").join(heads, "set", "left")
    alone = F.col("head").isNull()
    return out.select(
        "row", "id", "digest", "n", F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | (F.col("row") == F.col("head"))).alias("kept"),
    )


def near_components(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs(doc_id, text)``; other columns are not read.

    Words are runs of characters other than space and U+0009 to U+000D, with A-Z in lower case. Sets are linked if
    100 * intersection >= percent * union; a text without words is linked with nothing. Rows are linked by their texts
    only, whatever their ids: rows that share an id, or have none, are rows of their own. A component's id is its
    smallest doc_id, null if it has none but null ids, and of its rows exactly one is kept: one of those with that id.
    """
    return _placed(docs, percent).select("id", "n", "component_id", "kept").toDF("doc_id", "n_shingles", "component_id", "kept")


def near_deduplicated(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row of each component, that of the smallest doc_id, and every row without words; all columns stay.

    Of rows with one id and text, the one whose columns have the smallest hash stands for the others.
    """
    same = ["id", "digest"]
    groups = _placed(docs, percent).groupBy(*same).agg(F.max("kept").alias("kept"), (F.max("n") > 0).alias("words"), F.count("*").alias("rows"))
    # Only what does not simply stay: rows of other documents, and rows of which one stays.
    gone_id, gone_digest, gone_kept, gone_row = fresh(docs.columns, "gone_id", "gone_digest", "gone_kept", "gone_row")
    changed = groups.where("NOT kept OR (words AND rows > 1)").select(
        F.col("id").alias(gone_id), F.col("digest").alias(gone_digest), F.col("kept").alias(gone_kept)
    )
    changed = materialize(changed, "changed")
    repeated = changed.where(F.col(gone_kept))
    match = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (_digest() == F.col(gone_digest))
    rest = docs.join(changed, match, "left_anti")
    if repeated.isEmpty():
        return rest
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    one = docs.join(repeated, match).groupBy(gone_id, gone_digest).agg(F.min_by(F.struct(*columns), hashed).alias(gone_row))
    return rest.union(one.select(f"{gone_row}.*"))
