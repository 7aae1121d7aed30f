"""Queries for statistics, losses, meters, joins and panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from featmill.functions import tensors as t
from featmill.operators import columns as j
from featmill.operators import losses as loss
from featmill.operators import meters as m
from featmill.operators import panels as p
from featmill.operators import quality as q
from featmill.operators import stats as s
from featmill.session import materialize, scratch_path
from featmill.sources.files import read_stats, write_stats
from featmill.workload.base import (
    DOC_SAMPLES_SQL,
    MODEL_SQL,
    TOKENS,
    C,
    H,
    W,
    big,
    doc_samples,
    long_form,
    query,
    r6,
    table,
)
from featmill.workload.tensors import embeddings_by_model

_LONG = "long AS (SELECT vec_id, label, i, i // 16 AS channel, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) r(i))"


def _embeddings(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", "embedding")


def _stats_out(df, *keys):
    return df.select(*keys, big("channel").alias("channel"), "n", r6("mean").alias("mean"), r6("std").alias("std"))


@query(
    "channel_mean",
    f"WITH {_LONG} SELECT channel, count(*) AS n, round(avg(v), 6) + 0.0 AS mean FROM long GROUP BY ALL",
)
def channel_mean(spark, sf):
    stats = s.channel_stats(_embeddings(spark, sf), "embedding", C, TOKENS)
    return stats.select(big("channel").alias("channel"), "n", r6("mean").alias("mean"))


@query(
    "channel_std",
    f"""WITH {_LONG} SELECT label::BIGINT AS label, channel, count(*) AS n, round(avg(v), 6) + 0.0 AS mean,
  round(stddev_samp(v), 6) + 0.0 AS std FROM long GROUP BY ALL""",
)
def channel_std(spark, sf):
    """Statistics per model (label) and channel."""
    stats = s.channel_stats(_embeddings(spark, sf), "embedding", C, TOKENS, ["label"])
    return _stats_out(stats, big("label").alias("label"))


@query(
    "partial_moments",
    f"""WITH {_LONG} SELECT channel, count(*) AS n, round(avg(v), 6) + 0.0 AS mean,
  round(stddev_samp(v), 6) + 0.0 AS std FROM long GROUP BY ALL""",
)
def partial_moments(spark, sf):
    """Moments per shard of 100 samples, then merged."""
    df = _embeddings(spark, sf).withColumn("shard", F.expr("vec_id div 100"))
    return _stats_out(s.merge_moments(s.partial_moments(df, "embedding", C, TOKENS, ["shard"])))


@query(
    "feature_stats_store",
    f"""WITH {_LONG} SELECT 'model_' || label AS model, channel, count(*) AS n, round(avg(v), 6) + 0.0 AS mean,
  round(stddev_samp(v), 6) + 0.0 AS std FROM long GROUP BY ALL""",
)
def feature_stats_store(spark, sf):
    """Statistics stored in two goes, then loaded for a list of models."""
    df = _embeddings(spark, sf).withColumn("model", F.concat(F.lit("Model/"), F.col("label").cast("string")))
    stats = s.channel_stats(df, "embedding", C, TOKENS, ["model"])
    path = scratch_path(spark, "stats")
    low = F.col("model") < "Model/5"
    write_stats(stats.where(low), path)
    write_stats(stats.where(~low), path)
    return _stats_out(read_stats(spark, path, [f"Model/{i}" for i in range(10)]), "model")


# ---- losses -----------------------------------------------------------------------------------------

_PAIRS_SQL = f"""pairs AS (SELECT a.vec_id AS key, m.model, a.embedding AS pe, b.embedding AS te
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN {MODEL_SQL} ON a.label % 6 = m.pos),
el AS (SELECT key, model, pe[i + 1]::DOUBLE * 8 AS p, te[i + 1]::DOUBLE AS t FROM pairs, range(64) r(i)),
samples AS (SELECT key, model, count(*) AS n, sum((p - t) ** 2) AS se,
  sum(CASE WHEN abs(p - t) < 1 THEN 0.5 * (p - t) ** 2 ELSE abs(p - t) - 0.5 END) AS l1,
  1 - sum(p * t) / (greatest(sqrt(sum(p * p)), 1e-12) * greatest(sqrt(sum(t * t)), 1e-12)) AS cos
  FROM el GROUP BY ALL),
per_model AS (SELECT model, sum(se) / sum(n) AS mse, avg(cos) AS cos, sum(l1) / sum(n) AS l1
  FROM samples GROUP BY ALL)"""


def _pairs(spark, sf):
    """Each feature, scaled, as the prediction of its neighbour's; many differences exceed 1."""
    df = embeddings_by_model(spark, sf)
    pred = df.select(
        F.col("vec_id").alias("key"),
        "model",
        F.transform("embedding", lambda v: v.cast("double") * 8).alias("embedding"),
    )
    target = df.select((F.col("vec_id") - 1).alias("key"), "embedding")
    return pred, target


def _samples(spark, sf):
    pred, target = _pairs(spark, sf)
    pairs = loss.pred_target_join(pred, target, ["key"]).join(pred.select("key", "model"), "key")
    return loss.sample_losses(pairs)


@query(
    "pred_target_join",
    f"""WITH {_PAIRS_SQL} SELECT key, round(sum(p), 6) + 0.0 AS pred_sum, round(sum(t), 6) + 0.0 AS target_sum
FROM el GROUP BY key""",
)
def pred_target_join(spark, sf):
    pairs = loss.pred_target_join(*_pairs(spark, sf), ["key"])
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v)
    return pairs.select("key", r6(total("pred")).alias("pred_sum"), r6(total("target")).alias("target_sum"))


@query(
    "mse_loss",
    f"WITH {_PAIRS_SQL} SELECT key, model, n, round(se / n, 6) + 0.0 AS mse FROM samples",
)
def mse_loss(spark, sf):
    return _samples(spark, sf).select("key", "model", "n", r6(F.col("se") / F.col("n")).alias("mse"))


@query(
    "smooth_l1_loss",
    f"WITH {_PAIRS_SQL} SELECT key, model, round(l1 / n, 6) + 0.0 AS l1 FROM samples",
)
def smooth_l1_loss(spark, sf):
    return _samples(spark, sf).select("key", "model", r6(F.col("l1") / F.col("n")).alias("l1"))


@query("cosine_loss", f"WITH {_PAIRS_SQL} SELECT key, model, round(cos, 6) + 0.0 AS cos FROM samples")
def cosine_loss(spark, sf):
    return _samples(spark, sf).select("key", "model", r6("cos").alias("cos"))


_WEIGHTS = {
    "facebook/dinov2-large": 0.4,
    "facebook/sam-vit-huge": 0.1,
    "google/vit-huge-patch14-224-in21k": 0.2,
    "llava-hf/llava-1.5-7b-hf": 0.1,
    "openai/clip-vit-large-patch14": 0.1,
    "LiheYoung/depth-anything-large-hf": 0.1,
}
_WEIGHTS_SQL = " ".join(f"WHEN '{name}' THEN {weight}" for name, weight in _WEIGHTS.items())


@query(
    "distill_losses",
    f"""WITH {_PAIRS_SQL}, results AS (
SELECT model, mse, cos, l1 FROM per_model
UNION ALL SELECT 'all', avg(mse), avg(cos), avg(l1) FROM per_model
UNION ALL SELECT 'weighted', sum(mse * w), avg(cos), sum(l1 * w)
FROM (SELECT *, (CASE model {_WEIGHTS_SQL} END)::DOUBLE AS w FROM per_model))
SELECT model, round(mse, 6) + 0.0 AS mse, round(cos, 6) + 0.0 AS cos, round(l1, 6) + 0.0 AS l1 FROM results""",
)
def distill_losses(spark, sf):
    per_model = materialize(loss.model_losses(_samples(spark, sf)), "losses")
    out = per_model
    for name, weights in (("all", None), ("weighted", _WEIGHTS)):
        out = out.unionByName(loss.distill_losses(per_model, weights).withColumn("model", F.lit(name)))
    return out.select("model", *[r6(x).alias(x) for x in loss.LOSSES])


@query(
    "main_loss",
    f"""WITH {_PAIRS_SQL} SELECT model, round(mse, 6) + 0.0 AS mse,
  round(0.9::DOUBLE * cos + 0.1::DOUBLE * l1, 6) + 0.0 AS cos_l1 FROM per_model""",
)
def main_loss(spark, sf):
    losses = [F.col(x) for x in loss.LOSSES]
    mse, cos, l1 = losses
    return loss.model_losses(_samples(spark, sf)).select(
        "model",
        r6(loss.main_loss(None, mse, cos, l1)).alias("mse"),
        r6(loss.main_loss("cos_l1", mse, cos, l1)).alias("cos_l1"),
    )


# ---- meters -----------------------------------------------------------------------------------------

_UPDATES_SQL = """updates AS (SELECT CASE WHEN value > 50 THEN 'train' ELSE 'eval' END AS mode, event_type AS model,
  ['mse','cos','l1'][event_id % 3 + 1] AS loss, user_id % 4 AS worker, value AS val, 1 + event_id % 16 AS n
  FROM events),
meters AS (SELECT mode, model, loss, sum(val * n) AS s, sum(n)::BIGINT AS c FROM updates GROUP BY ALL)"""


def updates(events):
    """Metric reports made from events: value and the number of samples it is a mean of."""
    losses = F.array(*[F.lit(x) for x in loss.LOSSES])
    return events.select(
        F.when(F.col("value") > 50, "train").otherwise("eval").alias("mode"),
        F.col("event_type").alias("model"),
        F.element_at(losses, (F.col("event_id") % 3 + 1).cast("int")).alias("loss"),
        (F.col("user_id") % 4).alias("worker"),
        F.col("value").alias("val"),
        (F.col("event_id") % 16 + 1).alias("n"),
    )


def meters_out(meters, *more):
    """Averages of two-decimal values can end exactly in a 5; the small offset takes them off the rounding tie."""
    return meters.select(
        *m.METER, *more, F.round("sum", 2).alias("sum"), "count", r6(F.col("avg") + 1.2345678e-9).alias("avg")
    )


@query(
    "meter_avg",
    f"""WITH {_UPDATES_SQL} SELECT mode, model, loss, mode || '_' || model || '_' || loss || '_loss' AS name,
  round(s, 2) AS sum, c AS count, round(s / c + 1.2345678e-9, 6) + 0.0 AS avg,
  round(s / c + 1.2345678e-9, 6) + 0.0 AS average_summary, round(s, 2) AS sum_summary, c::DOUBLE AS count_summary
FROM meters""",
)
def meter_avg(spark, sf):
    meters = m.meter_avg(updates(table(spark, sf, "events")))
    for kind in ("average", "sum", "count"):
        meters = m.meter_summary(meters, kind).withColumnRenamed("value", f"{kind}_summary")
    return meters_out(
        meters,
        m.meter_name(F.col("mode"), F.col("loss"), F.col("model")).alias("name"),
        r6(F.col("average_summary") + 1.2345678e-9).alias("average_summary"),
        F.round("sum_summary", 2).alias("sum_summary"),
        "count_summary",
    )


@query(
    "meter_merge",
    f"""WITH {_UPDATES_SQL} SELECT mode, model, loss, round(s, 2) AS sum, c AS count,
  round(s / c + 1.2345678e-9, 6) + 0.0 AS avg FROM meters""",
)
def meter_merge(spark, sf):
    workers = m.meter_avg(updates(table(spark, sf, "events")), [*m.METER, "worker"])
    return meters_out(m.meter_merge(workers))


# ---- joins ------------------------------------------------------------------------------------------


@query(
    "merge_columns",
    """SELECT vec_id AS key, label::BIGINT AS label, lang, n_chars, quality::BIGINT AS quality, md5(text) AS text_md5,
  i AS pos, embedding[i + 1]::DOUBLE AS value
FROM embeddings JOIN documents ON vec_id = doc_id JOIN labels USING (doc_id), range(64) r(i)""",
)
def merge_columns(spark, sf):
    """Columns with their payloads, texts and features, side by side."""
    columns = [
        table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), big("label").alias("label"), "embedding"),
        table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "lang", "n_chars", "text"),
        table(spark, sf, "labels").select(F.col("doc_id").alias("key"), big("quality").alias("quality")),
    ]
    merged = j.merge_columns(columns, ["key"]).withColumn("text_md5", F.md5("text"))
    return long_form(merged, ["key", "label", "lang", "n_chars", "quality", "text_md5"], F.col("embedding"))


@query(
    "merge_positional",
    """SELECT a.ordinal, vec_id, doc_id FROM
(SELECT vec_id, row_number() OVER (ORDER BY label, vec_id) - 1 AS ordinal FROM embeddings) a
JOIN (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS ordinal FROM documents) b USING (ordinal)""",
)
def merge_positional(spark, sf):
    a = table(spark, sf, "embeddings").select("label", "vec_id")
    b = table(spark, sf, "documents").select("source", "doc_id")
    merged = j.merge_positional(a, b, ["label", "vec_id"], ["source", "doc_id"])
    return merged.select("ordinal", "vec_id", "doc_id")


@query(
    "merge_first_wins",
    """SELECT vec_id AS key, i AS pos, embedding[i + 1]::DOUBLE AS image,
  CASE WHEN label < 5 THEN embedding[i + 1] ELSE embedding[64 - i] END::DOUBLE AS feature,
  embedding[i + 1]::DOUBLE * 2 AS extra FROM embeddings, range(64) r(i)""",
)
def merge_first_wins(spark, sf):
    """A packed source that has the feature for some samples only, and separate columns for all."""
    e = table(spark, sf, "embeddings")
    whole = F.col("embedding").cast("array<double>")
    packed = e.select(F.col("vec_id").alias("key"), whole.alias("image"), F.when(F.col("label") < 5, whole).alias("feature"))
    separate = e.select(
        F.col("vec_id").alias("key"), F.reverse(whole).alias("image"), F.reverse(whole).alias("feature"),
        F.transform(whole, lambda v: v * 2).alias("extra"),
    )
    merged = j.merge_first_wins([packed, separate], ["key"])
    rows = merged.select("key", F.posexplode(F.arrays_zip("image", "feature", "extra")).alias("pos", "_v"))
    return rows.select("key", big("pos").alias("pos"), "_v.image", "_v.feature", "_v.extra")


@query(
    "key_alignment",
    f"""WITH {DOC_SAMPLES_SQL}, i AS (SELECT shard, key, member FROM samples JOIN shards USING (dataset, shard_idx)),
f AS (SELECT shard, CASE WHEN toxic = 1 THEN key || 'x' ELSE key END AS key
  FROM samples JOIN shards USING (dataset, shard_idx) LEFT JOIN labels USING (doc_id)
  WHERE quality IS NULL OR quality = 1),
ip AS (SELECT shard, key AS image_key, row_number() OVER (PARTITION BY shard ORDER BY key) - 1 AS pos FROM i),
fp AS (SELECT shard, key AS feature_key, row_number() OVER (PARTITION BY shard ORDER BY key || '.m') - 1 AS pos FROM f)
SELECT shard, pos, image_key, feature_key, image_key IS NOT DISTINCT FROM feature_key AS aligned
FROM ip FULL JOIN fp USING (shard, pos)""",
)
def key_alignment(spark, sf):
    """Feature shards that lack the low-quality documents and misname the toxic ones."""
    docs = doc_samples(spark, sf)
    marked = docs.join(table(spark, sf, "labels"), "doc_id", "left").where("quality is null or quality = 1")
    key = F.when(F.col("toxic") == 1, F.concat("key", F.lit("x"))).otherwise(F.col("key"))
    features = marked.select("shard", F.concat(key, F.lit(".m.safetensors")).alias("member"))
    images = docs.select("shard", F.concat("key", F.lit(".image")).alias("member"))
    return j.key_alignment(images, features)


@query(
    "resume_pending",
    f"""WITH {DOC_SAMPLES_SQL}, done AS (SELECT dataset, shard_idx, count(*) AS n FROM samples
  JOIN labels USING (doc_id) GROUP BY ALL)
SELECT dataset, shard, n_samples FROM shards LEFT JOIN done USING (dataset, shard_idx)
WHERE n IS NULL OR n < n_samples - 2""",
)
def resume_pending(spark, sf):
    """Shards count as done when at most two of their documents lack a label."""
    docs = doc_samples(spark, sf)
    labelled = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id").groupBy("shard").agg(
        F.count("*").alias("n")
    )
    planned = docs.groupBy("dataset", "shard").agg(F.count("*").alias("n_samples"))
    done = planned.join(labelled, "shard").where("n >= n_samples - 2")
    return j.resume_pending(planned, done, ["shard"]).select("dataset", "shard", "n_samples")


_PIXEL = "((i // 96) * 8 + i % 96 // 3 % 8)"


@query(
    "compare_panel",
    f"""SELECT vec_id, i AS pos, CASE i % 96 // 3 // 8 WHEN 0 THEN embedding[({_PIXEL} + i % 3 * 21) % 64 + 1]::DOUBLE
  WHEN 1 THEN embedding[({_PIXEL} + i % 3 * 5) % 64 + 1]::DOUBLE
  WHEN 2 THEN CASE WHEN label < 5 THEN embedding[64 - {_PIXEL}]::DOUBLE ELSE 0.0 END
  ELSE embedding[{_PIXEL} + 1]::DOUBLE END AS value FROM embeddings, range(768) r(i)""",
)
def compare_panel(spark, sf):
    """Input, projection, mask (missing for half of the labels) and depth, as 8 by 8 images of all 64 values."""
    e = _embeddings(spark, sf).select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))

    def colours(apart: int):
        return F.transform(F.sequence(F.lit(0), F.lit(191)), lambda i: F.get("v", (F.floor(i / 3) + i % 3 * apart) % 64))

    images = e.select("vec_id", colours(21).alias("px"))
    panels = {
        "pca": e.select("vec_id", colours(5).alias("px")),
        "mask": e.where("label < 5").select("vec_id", t.gray_to_rgb(F.reverse("v"), 64).alias("px")),
        "depth": e.select("vec_id", t.gray_to_rgb("v", 64).alias("px")),
    }
    return long_form(j.compare_panel(images, panels, "vec_id", 8, 8), ["vec_id"], F.col("px"))


@query(
    "panel_stack",
    """SELECT 'prediction' AS source, vec_id, i AS pos, embedding[i + 1]::DOUBLE * 2 AS value
FROM embeddings, range(64) r(i)
UNION ALL SELECT 'truth', vec_id, i, embedding[i + 1]::DOUBLE FROM embeddings, range(64) r(i)""",
)
def panel_stack(spark, sf):
    truth = long_form(_embeddings(spark, sf), ["vec_id"], F.col("embedding"))
    return p.panel_stack({"prediction": truth.withColumn("value", F.col("value") * 2), "truth": truth})


# ---- checks -----------------------------------------------------------------------------------------


@query(
    "feature_diff",
    """WITH e AS (SELECT *, label = 4 AND vec_id % 11 = 0 AS gone, label = 5 AND vec_id % 13 = 0 AS cut FROM embeddings),
d AS (SELECT 'm' || label AS model, vec_id // 100 AS shard, sum(0.5) FILTER (label = 3 AND vec_id % 7 = 0) AS t,
  count(*) FILTER (gone) AS missing, count(*) FILTER (cut) AS missized FROM e GROUP BY ALL),
total AS (SELECT *, coalesce(t, 0)::DOUBLE AS total, coalesce(t, 0) = 0 AND missing = 0 AND missized = 0 AS equal FROM d)
SELECT model, shard, round(total, 6) AS total, (CASE WHEN total > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS largest,
  missing, missized, equal, bool_and(equal) OVER (PARTITION BY model) AS passed FROM total""",
)
def feature_diff(spark, sf):
    """Stored features with damaged samples of one model, samples of one missing and tensors of one cut short."""
    e = _embeddings(spark, sf).select(
        "vec_id",
        F.concat(F.lit("m"), F.col("label").cast("string")).alias("model"),
        F.expr("vec_id div 100").alias("shard"),
        F.transform("embedding", lambda v: v.cast("double")).alias("embedding"),
    )
    damaged = (F.col("model") == "m3") & (F.col("vec_id") % 7 == 0)
    again = e.withColumn(
        "embedding",
        F.transform("embedding", lambda v, i: F.when(damaged & (i == 0), v + 0.5).otherwise(v)),
    )
    gone = (F.col("model") == "m4") & (F.col("vec_id") % 11 == 0)
    cut = (F.col("model") == "m5") & (F.col("vec_id") % 13 == 0)
    short = F.when(cut, F.slice("embedding", 1, C * TOKENS - 1)).otherwise(F.col("embedding"))
    stored = e.where(~gone).withColumn("embedding", short)
    diff = materialize(q.feature_diff(stored, again, ["vec_id"], ["model", "shard"]), "differences")
    failing = q.failing_models(diff).withColumn("_failed", F.lit(True))
    return diff.join(failing, "model", "left").select(
        "model",
        "shard",
        r6("total").alias("total"),
        r6("largest").alias("largest"),
        "missing",
        "missized",
        "equal",
        F.col("_failed").isNull().alias("passed"),
    )


@query(
    "minmax_scale",
    """WITH long AS (SELECT vec_id, i AS token, embedding[i * 4 + 1]::DOUBLE AS a, embedding[i * 4 + 2]::DOUBLE AS b,
  embedding[i * 4 + 3]::DOUBLE AS c, embedding[i * 4 + 4]::DOUBLE AS d FROM embeddings, range(16) r(i)),
kept AS (SELECT min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb, min(c) AS lc, max(c) AS hc, min(d) AS ld,
  max(d) AS hd FROM long WHERE a >= 0),
im AS (SELECT vec_id, min(embedding[i + 1])::DOUBLE AS lo, max(embedding[i + 1])::DOUBLE AS hi
  FROM embeddings, range(64) r(i) GROUP BY ALL)
SELECT vec_id, token, round(CASE WHEN a >= 0 THEN (a - la) / (ha - la) ELSE 0 END, 6) + 0.0 AS pc1,
  round(CASE WHEN a >= 0 THEN (b - lb) / (hb - lb) ELSE 0 END, 6) + 0.0 AS pc2,
  round(CASE WHEN a >= 0 THEN (c - lc) / (hc - lc) ELSE 0 END, 6) + 0.0 AS pc3,
  round(CASE WHEN a >= 0 THEN (d - ld) / (hd - ld) ELSE 0 END, 6) + 0.0 AS pc4,
  round((a - lo) / (hi - lo), 6) + 0.0 AS depth1, round((b - lo) / (hi - lo), 6) + 0.0 AS depth2,
  round((c - lo) / (hi - lo), 6) + 0.0 AS depth3, round((d - lo) / (hi - lo), 6) + 0.0 AS depth4
FROM long JOIN im USING (vec_id), kept""",
)
def minmax_scale(spark, sf):
    """All components over the foreground of all samples, and each sample's own values."""
    e = _embeddings(spark, sf).withColumn("depth", p.minmax_image(F.col("embedding")))
    parts = [f"pc{k + 1}" for k in range(C)]
    rows = p.token_rows(e, ["vec_id", "depth"], "embedding", C, TOKENS).select(
        "vec_id",
        "token",
        *[F.col("depth")[F.col("token") * C + k].alias(f"depth{k + 1}") for k in range(C)],
        *[F.col("vector")[k].cast("double").alias(name) for k, name in enumerate(parts)],
    )
    scaled = p.minmax_scale(rows, parts, F.col("pc1") >= 0)
    shown = [*parts, *[f"depth{k + 1}" for k in range(C)]]
    return scaled.select("vec_id", big("token").alias("token"), *[r6(c).alias(c) for c in shown])


# One rotation of Jacobi's method at a step; 60 are ten times around the six pairs of four channels.
_ROTATED = """list_transform(range(16), lambda k: CASE k % 4 WHEN p THEN co * {0}[k // 4 * 4 + p + 1] - si * {0}[k // 4 * 4 + q + 1]
  WHEN q THEN si * {0}[k // 4 * 4 + p + 1] + co * {0}[k // 4 * 4 + q + 1] ELSE {0}[k + 1] END)"""
_COVARIANCE = ", ".join(f"covar_samp(x[{i}], x[{j}])" for i in range(1, 5) for j in range(1, 5))


@query(
    "pca_rgb",
    f"""WITH RECURSIVE long AS (SELECT vec_id, i AS token, [embedding[i + 1]::DOUBLE, embedding[16 + i + 1]::DOUBLE,
  embedding[32 + i + 1]::DOUBLE, embedding[48 + i + 1]::DOUBLE] AS x FROM embeddings, range(16) r(i)),
moments AS (SELECT [avg(x[1]), avg(x[2]), avg(x[3]), avg(x[4])] AS mu, [{_COVARIANCE}] AS a FROM long),
turned AS (
  SELECT a, [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]::DOUBLE[] AS v, 0 AS step FROM moments
  UNION ALL
  SELECT list_transform(range(16), lambda k: CASE k // 4 WHEN p THEN co * b[p * 4 + k % 4 + 1] - si * b[q * 4 + k % 4 + 1]
      WHEN q THEN si * b[p * 4 + k % 4 + 1] + co * b[q * 4 + k % 4 + 1] ELSE b[k + 1] END), {_ROTATED.format("v")}, step + 1
  FROM (SELECT *, {_ROTATED.format("a")} AS b FROM (SELECT *, cos(angle) AS co, sin(angle) AS si FROM (
    SELECT *, 0.5::DOUBLE * atan2(2 * a[p * 4 + q + 1], a[q * 5 + 1] - a[p * 5 + 1]) AS angle FROM (
      SELECT *, [0, 0, 0, 1, 1, 2][step % 6 + 1] AS p, [1, 2, 3, 2, 3, 3][step % 6 + 1] AS q FROM turned WHERE step < 60))))),
axes AS (SELECT a[k * 5 + 1] AS variance, [v[k + 1], v[k + 5], v[k + 9], v[k + 13]] AS axis FROM turned, range(4) r(k)
  WHERE step = 60),
fit AS (SELECT list(CASE WHEN list_max(axis) >= -list_min(axis) THEN axis ELSE list_transform(axis, lambda y: -y) END
  ORDER BY variance DESC) AS pc FROM axes),
centred AS (SELECT vec_id, token, list_transform(x, lambda y, i: y - mu[i]) AS x FROM long, moments),
pcs AS (SELECT vec_id, token, list_inner_product(x, pc[1]) AS pc1, list_inner_product(x, pc[2]) AS pc2,
  list_inner_product(x, pc[3]) AS pc3 FROM centred, fit),
kept AS (SELECT min(pc1) AS l1, max(pc1) AS h1, min(pc2) AS l2, max(pc2) AS h2, min(pc3) AS l3, max(pc3) AS h3
  FROM pcs WHERE pc1 >= -0.2)
SELECT vec_id, token, round(pc1, 6) + 0.0 AS pc1,
  round(CASE WHEN pc1 >= -0.2 THEN (pc1 - l1) / (h1 - l1) ELSE 0 END, 6) + 0.0 AS r,
  round(CASE WHEN pc1 >= -0.2 THEN (pc2 - l2) / (h2 - l2) ELSE 0 END, 6) + 0.0 AS g,
  round(CASE WHEN pc1 >= -0.2 THEN (pc3 - l3) / (h3 - l3) ELSE 0 END, 6) + 0.0 AS b FROM pcs, kept""",
)
def pca_rgb(spark, sf):
    """Fit, project, drop the background, scale; a component's sign is that of its largest loading, so the fit is one."""
    tokens = _embeddings(spark, sf).withColumn("tokens", t.chw_to_tokens("embedding", C, H, W))
    rgb, _ = p.pca_rgb(tokens, ["vec_id"], "tokens", C, TOKENS, threshold=-0.2)
    return rgb.select("vec_id", big("token").alias("token"), *[r6(c).alias(c) for c in ("pc1", "r", "g", "b")])


# A stored fit, as one would keep it to colour later samples alike.
_FIT = p.Projection((0.01, -0.02, 0.03, 0.0), ((0.5, 0.5, 0.5, 0.5), (0.5, -0.5, 0.5, -0.5), (0.5, 0.5, -0.5, -0.5)))


@query(
    "pca_project",
    """WITH long AS (SELECT vec_id, i AS token, embedding[i + 1]::DOUBLE - 0.01 AS a, embedding[16 + i + 1]::DOUBLE + 0.02 AS b,
  embedding[32 + i + 1]::DOUBLE - 0.03 AS c, embedding[48 + i + 1]::DOUBLE AS d FROM embeddings, range(16) r(i)),
pcs AS (SELECT vec_id, token, (a + b + c + d) / 2 AS pc1, (a - b + c - d) / 2 AS pc2, (a + b - c - d) / 2 AS pc3 FROM long),
kept AS (SELECT min(pc1) AS l1, max(pc1) AS h1, min(pc2) AS l2, max(pc2) AS h2, min(pc3) AS l3, max(pc3) AS h3
  FROM pcs WHERE pc1 >= -0.2)
SELECT vec_id, token, round(pc1, 6) + 0.0 AS pc1,
  round(CASE WHEN pc1 >= -0.2 THEN (pc1 - l1) / (h1 - l1) ELSE 0 END, 6) + 0.0 AS r,
  round(CASE WHEN pc1 >= -0.2 THEN (pc2 - l2) / (h2 - l2) ELSE 0 END, 6) + 0.0 AS g,
  round(CASE WHEN pc1 >= -0.2 THEN (pc3 - l3) / (h3 - l3) ELSE 0 END, 6) + 0.0 AS b FROM pcs, kept""",
)
def pca_project(spark, sf):
    """The same with a given fit."""
    tokens = _embeddings(spark, sf).withColumn("tokens", t.chw_to_tokens("embedding", C, H, W))
    rgb, _ = p.pca_rgb(tokens, ["vec_id"], "tokens", C, TOKENS, threshold=-0.2, fit=_FIT)
    return rgb.select("vec_id", big("token").alias("token"), *[r6(c).alias(c) for c in ("pc1", "r", "g", "b")])


_COVERED = """covered AS (SELECT vec_id AS image, i // 16 AS mask, i % 16 AS pixel FROM embeddings, range(64) r(i)
  WHERE embedding[i + 1] > 0)"""
_U = "((('0x' || substr(md5('7:' || image || ':' || mask || ':{}'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


@query(
    "mask_overlay",
    f"""WITH {_COVERED}
SELECT 'fixed' AS color, image, pixel, round(count(*) * (30.0::DOUBLE / 255), 6) + 0.0 AS r,
  round(count(*) * (144.0::DOUBLE / 255), 6) + 0.0 AS g, round(count(*)::DOUBLE, 6) + 0.0 AS b FROM covered GROUP BY ALL
UNION ALL
SELECT 'random', image, pixel, round(sum({_U.format("r")}), 6) + 0.0, round(sum({_U.format("g")}), 6) + 0.0,
  round(sum({_U.format("b")}), 6) + 0.0 FROM covered GROUP BY ALL""",
)
def mask_overlay(spark, sf):
    """Every channel is a mask: its positive cells."""
    masks = _embeddings(spark, sf).select(
        F.col("vec_id").alias("image"),
        F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(49), F.lit(16)), lambda i: F.slice("embedding", i, 16))).alias(
            "mask", "cells"
        ),
    )
    out = None
    for color, seed in (("fixed", None), ("random", 7)):
        part = p.mask_overlay(masks, "image", "mask", "cells", seed).withColumn("color", F.lit(color))
        out = part if out is None else out.unionByName(part)
    return out.select("color", "image", big("pixel").alias("pixel"), *[r6(c).alias(c) for c in "rgb"])


@query(
    "mask_filter",
    """WITH masks AS (SELECT event_id, user_id AS image, value / 500 AS iou,
  json_extract_string(props, '$.k')::DOUBLE / 100 AS stability FROM events)
SELECT 'default' AS kind, * FROM masks WHERE iou > 0.5::DOUBLE AND stability > 0.6::DOUBLE
UNION ALL SELECT 'strict', * FROM masks WHERE iou > 0.3::DOUBLE AND stability > 0.9::DOUBLE""",
)
def mask_filter(spark, sf):
    masks = table(spark, sf, "events").select(
        "event_id",
        F.col("user_id").alias("image"),
        (F.col("value") / 500).alias("iou"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("stability"),
    )
    default = p.mask_filter(masks).withColumn("kind", F.lit("default"))
    return default.unionByName(p.mask_filter(masks, 0.3, 0.9).withColumn("kind", F.lit("strict")))


@query(
    "count_steps",
    f"""WITH {DOC_SAMPLES_SQL} SELECT shard, n_samples AS n FROM shards""",
)
def count_steps(spark, sf):
    """Samples of shards that hold several members of each."""
    members = doc_samples(spark, sf).select("shard", F.explode(F.array("member", F.concat("key", F.lit(".label")))).alias("member"))
    return q.count_steps(members)


@query(
    "dataset_union",
    """SELECT 'events' AS dataset, event_id::VARCHAR AS key, value AS feature FROM events
UNION ALL SELECT 'lineitem', l_orderkey::VARCHAR, l_quantity FROM lineitem""",
)
def dataset_union(spark, sf):
    parts = {
        "events": table(spark, sf, "events").select(F.col("event_id").cast("string").alias("key"), F.col("value").alias("feature")),
        "lineitem": table(spark, sf, "lineitem").select(
            F.col("l_quantity").alias("feature"), F.col("l_orderkey").cast("string").alias("key")
        ),
    }
    return p.dataset_union(parts)

