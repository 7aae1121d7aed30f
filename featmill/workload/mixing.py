"""Queries for shuffling, sampling and mixing."""

from __future__ import annotations

from pyspark.sql import functions as F

from featmill.operators import mixing as x
from featmill.operators.ordinals import batch_assign
from featmill.plans.catalog import mix_weights
from featmill.plans.registry import MODEL_SIZES
from featmill.workload.base import DOC_SAMPLES_SQL, big, doc_samples, doc_shards, query, table

_SEED = 11


@query(
    "spot_check_sample",
    f"""WITH {DOC_SAMPLES_SQL}, picked AS (SELECT dataset, shard_idx, shard FROM shards ORDER BY md5('11:' || shard), shard LIMIT 5),
r AS (SELECT shard, key, row_number() OVER (PARTITION BY shard ORDER BY md5('11:' || shard || ':' || key), key) AS rank
  FROM samples JOIN picked USING (dataset, shard_idx))
SELECT shard, key FROM r WHERE rank <= 3""",
)
def spot_check_sample(spark, sf):
    docs = doc_samples(spark, sf).select("shard", "key")
    return x.spot_check_sample(docs, "shard", "key", _SEED, shards=5, per_shard=3)


@query(
    "shard_shuffle",
    f"""WITH {DOC_SAMPLES_SQL}
SELECT 0::BIGINT AS epoch, shard, row_number() OVER (ORDER BY md5('11:0:' || shard), shard) - 1 AS position FROM shards
UNION ALL
SELECT 1, shard, row_number() OVER (ORDER BY md5('11:1:' || shard), shard) - 1 FROM shards""",
)
def shard_shuffle(spark, sf):
    shards = doc_shards(spark, sf).select("shard")
    epochs = [
        x.shard_shuffle(shards, "shard", _SEED, e).withColumn("epoch", F.lit(e).cast("bigint")) for e in (0, 1)
    ]
    return epochs[0].unionByName(epochs[1])


@query(
    "buffer_shuffle",
    """WITH placed AS (SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 1000 AS buffer FROM events)
SELECT event_id, buffer * 1000 + row_number() OVER (PARTITION BY buffer ORDER BY md5('11:2:3:' || event_id), event_id) - 1
  AS position FROM placed""",
)
def buffer_shuffle(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts")
    out = x.buffer_shuffle(events, ["ts", "event_id"], "event_id", _SEED, buffer=1000, rank=2, epoch=3)
    return out.select("event_id", "position")


@query(
    "sliding_shuffle",
    """WITH placed AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS o FROM events),
due AS (SELECT event_id, o * 1048576 + floor(-ln((('0x' || substr(md5('11:2:3:' || event_id), 1, 8))::BIGINT + 0.5::DOUBLE)
  / 4294967296.0::DOUBLE) * 1048576000.0::DOUBLE)::BIGINT AS due FROM placed)
SELECT event_id, row_number() OVER (ORDER BY due, event_id) - 1 AS position FROM due""",
)
def sliding_shuffle(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts")
    out = x.sliding_shuffle(events, ["ts", "event_id"], "event_id", _SEED, buffer=1000, rank=2, epoch=3)
    return out.select("event_id", "position")


# Mix weights by event type (the mix of a run is a short list).
_WEIGHTS = {"click": 2.0, "view": 1.0, "purchase": 0.5, "signup": 1.0, "error": 0.25}
# The heaviest stream, of weight 2, has rate 1; gaps are whole numbers of ticks.
_TICKS_SQL = """floor(-ln((('0x' || substr(md5('11:' || event_type || ':' || {}), 1, 8))::BIGINT + 0.5::DOUBLE)
  / 4294967296.0::DOUBLE) / (w / 2.0::DOUBLE) * 16777216.0::DOUBLE)::DECIMAL(24,0)"""
_RACE_SQL = f"""weights(event_type, w) AS (VALUES {",".join(f"('{k}',{v}::DOUBLE)" for k, v in _WEIGHTS.items())}),
placed AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS j,
  count(*) OVER (PARTITION BY event_type) AS n FROM events),
gaps AS (SELECT *, {_TICKS_SQL.format("event_id")} AS gap, {_TICKS_SQL.format("'end'")} AS extra FROM placed JOIN weights USING (event_type)),
raced AS (SELECT *, sum(gap) OVER (PARTITION BY event_type ORDER BY j) AS t FROM gaps)"""


def _weights(spark):
    rows = ", ".join(f"('{k}', {v}D)" for k, v in _WEIGHTS.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS w(event_type, weight)")


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type", "ts")


@query(
    "mix_all_exhausted",
    f"""WITH {_RACE_SQL} SELECT event_id, event_type, row_number() OVER (ORDER BY t, event_type, j) - 1 AS mix_rank FROM raced""",
)
def mix_all_exhausted(spark, sf):
    mixed = x.mix_all_exhausted(_events(spark, sf), _weights(spark), "event_type", ["ts", "event_id"], "event_id", _SEED)
    return mixed.drop("ts")


@query(
    "mix_first_exhausted",
    f"""WITH {_RACE_SQL}, stop AS (SELECT min(t + extra) AS stop FROM raced WHERE j = n - 1)
SELECT event_id, event_type, row_number() OVER (ORDER BY t, event_type, j) - 1 AS mix_rank
FROM raced, stop WHERE t < stop""",
)
def mix_first_exhausted(spark, sf):
    mixed = x.mix_first_exhausted(_events(spark, sf), _weights(spark), "event_type", ["ts", "event_id"], "event_id", _SEED)
    return mixed.drop("ts")


@query(
    "epoch_limit",
    f"""WITH {_RACE_SQL}, lens AS (SELECT event_type, w, ceil(count(*) * 0.3::DOUBLE) AS len FROM gaps GROUP BY ALL),
bound AS (SELECT ceil(sum(w * len) / 16.0 / 4.0) * 64 AS b FROM lens),
ranked AS (SELECT event_id, row_number() OVER (ORDER BY t, event_type, j) - 1 AS mix_rank FROM raced)
SELECT event_id, mix_rank FROM ranked, bound WHERE mix_rank < b""",
)
def epoch_limit(spark, sf):
    """One epoch of a mix at three tenths of its length, batch size 16 on 4 ranks."""
    events, weights = _events(spark, sf), _weights(spark)
    mixed = x.mix_all_exhausted(events, weights, "event_type", ["ts", "event_id"], "event_id", _SEED)
    lengths = events.groupBy("event_type").agg(F.count("*").alias("n")).join(weights, "event_type")
    expected = mix_weights(lengths, 0.3).agg(F.max("expected").alias("expected"))
    return x.epoch_limit(mixed, expected, 16, 4).select("event_id", "mix_rank")


_MODELS = list(MODEL_SIZES)


@query(
    "random_targets",
    f"""WITH batches AS (SELECT DISTINCT (row_number() OVER (ORDER BY o_orderkey) - 1) // 16 AS batch_idx FROM orders),
r AS (SELECT batch_idx, model, row_number() OVER (PARTITION BY batch_idx ORDER BY md5('11:' || batch_idx || ':' || model)) AS k
  FROM batches, unnest([{",".join(f"'{m}'" for m in _MODELS)}]) m(model))
SELECT batch_idx, model FROM r WHERE k <= 2""",
)
def random_targets(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    batches = batch_assign(orders, ["o_orderkey"], 16).where("batch_pos = 0").select(big("batch_idx").alias("batch_idx"))
    return x.random_targets(batches, "batch_idx", _MODELS, _SEED)
