"""Exact top-k inner-product search with ball trees.

Vectors are dealt to shards of bounded size by a hash of their ids; a task turns each shard into a ball tree, whose
leaves and inner nodes are balls (centre, radius). No vector of a ball can score more against a query than
``query . centre + |query| * radius``; nodes are visited in the order of that bound, and a query is done with a tree
when the bound falls below its k-th best score so far.

Queries travel in blocks. A first pass searches each block in one shard, which gives every query a k-th score to
start from; the second pass takes the blocks through all shards in groups, and a task carries the k-th scores from
one shard of its group to the next. A block keeps k rows per query and group, so what is shuffled for the last ranking
does not depend on the number of vectors in a shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featmill.llm.common import materialize

# Vectors in a shard, queries in a block, vectors in a leaf, shards a task goes through with a block.
SHARD, BLOCK, LEAF, GROUP = 16_384, 512, 128, 8
_SLACK = 1e-9


def floor_components(vector: Column | str, factor: int = 1024) -> Column:
    """``floor(factor * x)`` of each component; null for a null or empty vector or one with a null or non-finite component."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    doubles = vector.cast("array<double>")
    finite = F.forall(doubles, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))
    whole = F.transform(doubles, lambda x: F.floor(x * F.lit(float(factor))))
    return F.when((F.size(vector) > 0) & finite, whole)


class BallTree:
    """Balls over the rows of ``points`` (integers held as float64, so that their products are exact)."""

    def __init__(self, ids: np.ndarray, points: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.points = ids[order], points[order]
        self.nodes: list[tuple[np.ndarray | None, int, int]] = []  # rows of a leaf, or the two children
        centres, radii = [], []

        def build(rows: np.ndarray) -> int:
            here = self.points[rows]
            centre = here.mean(axis=0)
            away = np.sqrt(((here - centre) ** 2).sum(axis=1))
            k = len(self.nodes)
            self.nodes.append((rows, -1, -1))
            centres.append(centre)
            radii.append(away.max())
            if len(rows) > LEAF and away.max() > 0:
                one = here[away.argmax()]
                far = ((here - one) ** 2).sum(axis=1)
                split = here @ (here[far.argmax()] - one)
                half = np.argsort(split, kind="stable")
                mid = len(rows) // 2
                self.nodes[k] = (None, build(np.sort(rows[half[:mid]])), build(np.sort(rows[half[mid:]])))
            return k

        if len(ids):
            build(np.arange(len(ids)))
        self.centres, self.radii = np.array(centres), np.array(radii)

    def search(self, query: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k`` rows that score at least ``floor``; ties to smaller ids."""
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        if not len(self.nodes):
            return ids, scores
        bounds = self.centres @ query + self.radii * np.sqrt(query @ query)
        bounds += _SLACK * (1.0 + np.abs(bounds))
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= floor:
            _, node = heapq.heappop(heap)
            rows, left, right = self.nodes[node]
            if rows is None:
                for child in (left, right):
                    if bounds[child] >= floor:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            found = self.points[rows] @ query
            good = (found >= floor) & (self.ids[rows] != own)
            if good.any():
                ids = np.concatenate((ids, self.ids[rows[good]]))
                scores = np.concatenate((scores, found[good]))
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    floor = max(floor, scores[-1])
        return ids, scores


def _merged(ids, scores, more_ids, more_scores, k: int):
    ids, scores = np.concatenate((ids, more_ids)), np.concatenate((scores, more_scores))
    best = np.lexsort((ids, -scores))[:k]
    return ids[best], scores[best]


def _block(group: pd.DataFrame) -> pd.DataFrame:
    """Vectors of one shard or block as one row of bytes."""
    group = group.sort_values("id", kind="stable")
    points = np.stack([np.asarray(v, np.int64) for v in group["v"]])
    return pd.DataFrame(
        {"dim": [points.shape[1]], "n": [len(group)], "ids": [group["id"].to_numpy("<i8").tobytes()],
         "points": [points.astype("<i8").tobytes()]}
    )


def _points(ids: bytes, points: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    whole = np.frombuffer(points, "<i8").reshape(-1, dim)
    if len(whole) and np.abs(whole).max() ** 2 * dim >= 2.0**53:
        raise ValueError("components are too large for exact scores: their products must stay below 2^53")
    return np.frombuffer(ids, "<i8"), whole.astype(np.float64)


def top_inner_products(rows: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best inner products of each query with the other rows.

    ``rows`` has ``id`` and ``v`` (array of integers); null vectors take no part. ``is_query`` marks the queries, in
    terms of ``id``. A query finds fewer than ``k`` where there are fewer candidates. Vectors of another length than the
    query's are no candidates. Rows that share an id are candidates each; a query does not find rows with its own id.
    A row with a null id is no query; as a candidate it is left out. Products must stay below 2^53 (checked).
    """
    rows = rows.where(F.col("v").isNotNull() & F.col("id").isNotNull())
    rows = rows.select("id", "v", F.size("v").alias("dim"))
    counts = {r["dim"]: (r["n"], r["q"]) for r in rows.groupBy("dim").agg(
        F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).collect()}
    sizes = rows.sparkSession.createDataFrame(
        [(d, -(-n // SHARD), max(1, -(-q // BLOCK))) for d, (n, q) in counts.items()], "dim int, shards int, blocks int"
    )
    rows = rows.join(F.broadcast(sizes), "dim")  # one row for each length of vectors
    spread = F.xxhash64("id")
    packed = "dim int, n int, ids binary, points binary"

    def pack(df: DataFrame, part: str) -> DataFrame:
        dealt = df.withColumn("_k", F.pmod(spread, F.col(part)).cast("int"))

        def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            return _block(group).assign(part=key[1])

        return dealt.groupBy("dim", "_k").applyInPandas(one, packed + ", part int")

    shards = materialize(pack(rows.select("id", "v", "dim", "shards"), "shards"), "shards")
    blocks = materialize(
        pack(rows.where(is_query).select("id", "v", "dim", "blocks"), "blocks").withColumnRenamed("part", "block"), "blocks"
    )
    asked = blocks.select("dim", "block", F.col("ids").alias("q_ids"), F.col("points").alias("q_points"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by block group; a tree is built once for a run of rows of the same shard."""
        here, best, queries = None, None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                key = (row.dim, row.block, row.grp)
                if key != here:
                    if best is not None:
                        yield hand_on(here, queries[0], best)
                    here, queries = key, _points(row.q_ids, row.q_points, row.dim)
                    floors = np.frombuffer(row.floors, "<f8") if row.floors is not None else np.full(len(queries[0]), -np.inf)
                    best = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries[0])
                tree = BallTree(*_points(row.ids, row.points, row.dim))
                for j, (own, q) in enumerate(zip(*queries, strict=True)):
                    ids, scores = best[j]
                    floor = max(floors[j], scores[-1]) if len(ids) == k else floors[j]
                    best[j] = _merged(ids, scores, *tree.search(q, own, k, floor), k)
        if best is not None:
            yield hand_on(here, queries[0], best)

    def hand_on(key: tuple, owners: np.ndarray, best: list) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "dim": key[0], "block": key[1],
                "query_id": np.repeat(owners, [len(i) for i, _ in best]),
                "vec_id": np.concatenate([i for i, _ in best] + [np.zeros(0, np.int64)]),
                "score": np.concatenate([s for _, s in best] + [np.zeros(0)]).astype(np.int64),
            }
        )

    found = "dim int, block int, query_id long, vec_id long, score long"
    # First pass: each block in one shard, another one for each block.
    firsts = asked.join(sizes, "dim").withColumn("part", F.col("block") % F.col("shards"))
    first = firsts.join(shards, ["dim", "part"]).withColumn("grp", F.lit(0)).withColumn("floors", F.lit(None).cast("binary"))
    start = materialize(first.repartition("dim", "block").mapInPandas(search, found), "first")

    def floors(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "q": [group["query_id"].tolist()], "f": [group["score"].astype(float).tolist()]})

    least = start.groupBy("dim", "block", "query_id").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") >= k)
    known = least.groupBy("dim", "block").applyInPandas(floors, "dim int, block int, q array<bigint>, f array<double>")

    def with_floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                ids = np.frombuffer(row.q_ids, "<i8")
                values = np.full(len(ids), -np.inf)
                if row.q is not None:
                    at = dict(zip(row.q, row.f, strict=True))
                    values = np.array([at.get(i, -np.inf) for i in ids.tolist()])
                out.append(values.astype("<f8").tobytes())
            yield batch[["dim", "block", "q_ids", "q_points"]].assign(floors=out)

    ready = asked.join(known, ["dim", "block"], "left").mapInPandas(
        with_floors, "dim int, block int, q_ids binary, q_points binary, floors binary"
    )
    # Second pass: a row for each block and shard, groups of shards to a task.
    placed = ready.join(sizes, "dim").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    placed = placed.withColumn("grp", F.floor(F.col("part") / GROUP).cast("int"))
    pairs = placed.join(shards, ["dim", "part"]).repartition("dim", "block", "grp").sortWithinPartitions("dim", "block", "grp", "part")
    every = pairs.select("dim", "block", "grp", "q_ids", "q_points", "floors", "ids", "points").mapInPandas(search, found)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
