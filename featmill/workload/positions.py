"""Queries for ordinals, frames, splits and work distribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from featmill.operators import ordinals as o
from featmill.operators.meters import meter_running
from featmill.workload.base import DOC_SAMPLES_SQL, big, doc_shards, query, r6, table


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")


_FRAMES_SQL = """frames AS (SELECT event_id, user_id, ts,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
  row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS ordinal FROM events)"""


@query(
    "shard_assign",
    """SELECT doc_id, ordinal, ordinal // 50 AS shard_idx
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents)""",
)
def shard_assign(spark, sf):
    return o.shard_assign(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 50)


# Equal lineitem rows are interchangeable, so a shard is described by what it holds.
@query(
    "shard_assign_volume",
    """SELECT shard_idx, count(*) AS n, min(l_orderkey) AS first_order, max(l_orderkey) AS last_order
FROM (SELECT l_orderkey, (row_number() OVER (ORDER BY l_orderkey) - 1) // 1000 AS shard_idx FROM lineitem)
GROUP BY ALL""",
)
def shard_assign_volume(spark, sf):
    placed = o.shard_assign(table(spark, sf, "lineitem").select("l_orderkey"), ["l_orderkey"], 1000, ties=True)
    return placed.groupBy("shard_idx").agg(
        F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"), F.max("l_orderkey").alias("last_order")
    )


@query(
    "frame_number",
    f"""WITH {_FRAMES_SQL}, episodes AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS episode_idx
  FROM (SELECT DISTINCT user_id FROM events))
SELECT event_id, user_id, frame_idx, episode_idx FROM frames JOIN episodes USING (user_id)""",
)
def frame_number(spark, sf):
    df = _events(spark, sf).select("event_id", "user_id", "ts")
    return o.frame_number(df, "user_id", ["ts", "event_id"]).drop("ts")


@query(
    "cum_length",
    """SELECT user_id, length, (sum(length) OVER (ORDER BY user_id) - length)::BIGINT AS cum_len
FROM (SELECT user_id, count(*) AS length FROM events GROUP BY user_id)""",
)
def cum_length(spark, sf):
    return o.cum_length(table(spark, sf, "events").select("user_id"), "user_id")


@query(
    "subsample_global",
    f"WITH {_FRAMES_SQL} SELECT event_id, user_id, frame_idx, ordinal FROM frames WHERE ordinal % 32 = 0",
)
def subsample_global(spark, sf):
    df = _events(spark, sf).select("event_id", "user_id", "ts")
    return o.subsample_global(df, "user_id", ["ts", "event_id"], 32).drop("ts")


@query(
    "subsample_per_video",
    f"WITH {_FRAMES_SQL} SELECT event_id, user_id, frame_idx FROM frames WHERE frame_idx % 15 = 0",
)
def subsample_per_video(spark, sf):
    df = _events(spark, sf).select("event_id", "user_id", "ts")
    return o.subsample_per_video(df, "user_id", ["ts", "event_id"], 15).drop("ts")


@query(
    "split_assign",
    f"WITH {DOC_SAMPLES_SQL} SELECT dataset, shard, shard_rank, n_shards, split FROM split_shards",
)
def split_assign(spark, sf):
    shards = doc_shards(spark, sf).select("dataset", "shard")
    return o.split_assign(shards, "dataset", "shard")


@query(
    "split_totals",
    f"""WITH {DOC_SAMPLES_SQL}
SELECT dataset, coalesce(sum(n) FILTER (split = 'train'), 0)::BIGINT AS train,
  coalesce(sum(n) FILTER (split = 'val'), 0)::BIGINT AS val,
  coalesce(sum(n) FILTER (split = 'test'), 0)::BIGINT AS test
FROM split_sizes GROUP BY dataset""",
)
def split_totals(spark, sf):
    return o.split_totals(doc_shards(spark, sf), "dataset", "shard", "n_samples", 5)


@query(
    "shard_pad",
    f"""WITH {DOC_SAMPLES_SQL}, slots AS (SELECT *, copy * n_shards + shard_rank AS slot
  FROM ranked, range(8) c(copy))
SELECT dataset, shard, copy, slot FROM slots WHERE slot < ceil(n_shards / 8.0::DOUBLE) * 8""",
)
def shard_pad(spark, sf):
    shards = doc_shards(spark, sf).select("dataset", "shard")
    return o.shard_pad(shards, "dataset", "shard", 8).select("dataset", "shard", "copy", big("slot").alias("slot"))


@query(
    "shard_repeat",
    f"""WITH {DOC_SAMPLES_SQL}, slots AS (SELECT *, copy * n_shards + shard_rank AS slot
  FROM ranked, range(32) c(copy))
SELECT dataset, shard, copy, slot FROM slots
WHERE copy < CASE WHEN n_shards < 32 THEN ceil(32.0::DOUBLE / n_shards) ELSE 1 END""",
)
def shard_repeat(spark, sf):
    shards = doc_shards(spark, sf).select("dataset", "shard")
    out = o.shard_repeat(shards, "dataset", "shard", world=4)
    return out.select("dataset", "shard", "copy", big("slot").alias("slot"))


@query(
    "shard_to_worker",
    f"""WITH {DOC_SAMPLES_SQL}
SELECT dataset, shard, shard_rank, shard_rank % 4 AS node, (shard_rank // 4) % 2 AS worker FROM ranked""",
)
def shard_to_worker(spark, sf):
    shards = doc_shards(spark, sf).select("dataset", "shard")
    return o.shard_to_worker(shards, "dataset", "shard", world=4, workers=2)


@query(
    "batch_assign",
    """SELECT o_orderkey, ordinal // 16 AS batch_idx, ordinal % 16 AS batch_pos
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders)""",
)
def batch_assign(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    return o.batch_assign(orders, ["o_orderkey"], 16).drop("ordinal")


@query(
    "meter_running",
    """SELECT event_id, event_type, (sum(n) OVER w)::BIGINT AS count, round(sum(value * n) OVER w, 2) + 0.0 AS sum,
  round(sum(value * n) OVER w / sum(n) OVER w + 1.2345678e-9, 6) + 0.0 AS avg
FROM (SELECT *, 1 + event_id % 16 AS n FROM events)
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""",
)
def running_meter(spark, sf):
    """Metric ``value`` reported over batches of varying size, one meter per event type.

    Averages of two-decimal values often end exactly in a 5; the small offset takes them off the rounding tie.
    """
    updates = _events(spark, sf).select(
        "event_id", "event_type", "ts", F.col("value").alias("val"), (F.col("event_id") % 16 + 1).alias("n")
    )
    out = meter_running(updates, ["event_type"], ["ts", "event_id"])
    return out.select(
        "event_id",
        "event_type",
        big("count").alias("count"),
        (F.round("sum", 2) + 0.0).alias("sum"),
        r6(F.col("avg") + 1.2345678e-9).alias("avg"),
    )


@query(
    "segment_stream",
    """SELECT event_id, ordinal // 1000 AS segment_idx, ordinal % 1000 AS frame_idx,
  count(*) OVER (PARTITION BY ordinal // 1000) AS segment_len
FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS ordinal FROM events)""",
)
def segment_stream(spark, sf):
    out = o.segment_stream(_events(spark, sf).select("event_id", "ts"), ["ts", "event_id"])
    return out.select("event_id", "segment_idx", "frame_idx", "segment_len")


@query(
    "lexical_order",
    """SELECT member, row_number() OVER (ORDER BY member) - 1 AS position
FROM (SELECT source || '/' || lang || '-' || doc_id AS member FROM documents)""",
)
def lexical_order(spark, sf):
    names = table(spark, sf, "documents").select(
        F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("-"), F.col("doc_id").cast("string")).alias("member")
    )
    return o.number_rows(names, order=["member"], ordinal="position")
