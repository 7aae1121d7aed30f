"""Queries for the tensor functions; embeddings are read as ``[4, 4, 4]`` features."""

from __future__ import annotations

from pyspark.sql import functions as F

from featmill.functions import tensors as t
from featmill.functions.naming import model_name_legit
from featmill.operators.stats import channel_stats, denormalize_features, normalize_features
from featmill.plans.catalog import model_table
from featmill.workload.base import MODEL_SQL, SIZE, TOKENS, C, H, W, big, long_form, query, r6, table


def _embeddings(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", "embedding")


def _gather_sql(n: int, index: str) -> str:
    return f"""SELECT vec_id, i AS pos, embedding[({index}) + 1]::DOUBLE AS value
FROM embeddings, range({n}) r(i)"""


# Integer pixels between 0 and 255 made from an embedding.
def _pixels(name="embedding"):
    return F.transform(
        F.col(name), lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 200 + 128))).cast("int")
    )


_PX = "greatest(0, least(255, floor(embedding[({}) + 1]::DOUBLE * 200 + 128)))"


@query("chw_to_tokens", _gather_sql(64, "(i % 4) * 16 + i // 4"))
def chw_to_tokens(spark, sf):
    return long_form(_embeddings(spark, sf), ["vec_id"], t.chw_to_tokens("embedding", C, H, W))


@query("tokens_to_chw", _gather_sql(64, "(i % 16) * 4 + i // 16"))
def tokens_to_chw(spark, sf):
    return long_form(_embeddings(spark, sf), ["vec_id"], t.tokens_to_chw("embedding", C, TOKENS))


_STATS_SQL = f"""long AS (SELECT vec_id, label, i, i // 16 AS channel, embedding[i + 1]::DOUBLE AS v
  FROM embeddings, range(64) r(i)),
stats AS (SELECT label, channel, avg(v) AS mean, stddev_samp(v) AS std, count(*) AS n FROM long GROUP BY ALL)"""


def _normalized(spark, sf, back: bool):
    """Embeddings as tokens, normalised by the statistics of their label's features."""
    df = _embeddings(spark, sf).withColumn("model", F.concat(F.lit("m"), F.col("label").cast("string")))
    stats = channel_stats(df, "embedding", C, TOKENS, ["model"])
    tokens = df.withColumn("embedding", t.chw_to_tokens("embedding", C, H, W))
    apply = denormalize_features if back else normalize_features
    return long_form(apply(tokens, stats, C, TOKENS), ["vec_id"], F.col("embedding"), exact=False)


@query(
    "feature_normalize",
    f"""WITH {_STATS_SQL}
SELECT vec_id, (i % 16) * 4 + i // 16 AS pos, round((v - mean) / std, 6) + 0.0 AS value
FROM long JOIN stats USING (label, channel)""",
)
def feature_normalize(spark, sf):
    return _normalized(spark, sf, back=False)


@query(
    "feature_denormalize",
    f"""WITH {_STATS_SQL}
SELECT vec_id, (i % 16) * 4 + i // 16 AS pos, round(v * std + mean, 6) + 0.0 AS value
FROM long JOIN stats USING (label, channel)""",
)
def feature_denormalize(spark, sf):
    return _normalized(spark, sf, back=True)


def _pool_sql(agg: str) -> str:
    return f"""SELECT vec_id, i % 4 AS pos, round({agg}(embedding[i + 1]::DOUBLE), 6) + 0.0 AS value
FROM embeddings, range(4, 60) r(i) GROUP BY ALL"""


@query("pool_mean", _pool_sql("avg"))
def pool_mean(spark, sf):
    """Embeddings read as 16 tokens of 4 channels; the last token is discarded."""
    return long_form(_embeddings(spark, sf), ["vec_id"], t.pool_mean("embedding", C, TOKENS, 1), exact=False)


@query("pool_max", _pool_sql("max"))
def pool_max(spark, sf):
    return long_form(_embeddings(spark, sf), ["vec_id"], t.pool_max("embedding", C, TOKENS, 1), exact=False)


@query("pool_cls", _gather_sql(4, "i"))
def pool_cls(spark, sf):
    return long_form(_embeddings(spark, sf), ["vec_id"], t.reduce_tokens("embedding", "cls", C, TOKENS))


@query("pool_identity", _gather_sql(64, "i"))
def pool_identity(spark, sf):
    return long_form(_embeddings(spark, sf), ["vec_id"], t.reduce_tokens("embedding", "identity", C, TOKENS))


@query("pool_spatial", _gather_sql(52, "i + 4"))
def pool_spatial(spark, sf):
    return long_form(_embeddings(spark, sf), ["vec_id"], t.reduce_tokens("embedding", None, C, TOKENS, 2))


@query(
    "resize_nearest",
    """SELECT vec_id, 'up' AS size, i AS pos,
       embedding[(i // 64) * 16 + (((i % 64) // 8) // 2) * 4 + (i % 8) // 2 + 1]::DOUBLE AS value
FROM embeddings, range(256) r(i)
UNION ALL
SELECT vec_id, 'down', i, embedding[(i // 4) * 16 + (((i % 4) // 2) * 2) * 4 + (i % 2) * 2 + 1]::DOUBLE
FROM embeddings, range(16) r(i)
UNION ALL
SELECT vec_id, 'odd', i, embedding[(i // 18) * 16 + ((((i % 18) // 6) * 4) // 3) * 4 + ((i % 6) * 4) // 6 + 1]::DOUBLE
FROM embeddings, range(72) r(i)""",
)
def resize_nearest(spark, sf):
    df = _embeddings(spark, sf)
    sizes = {"up": (8, 8), "down": (2, 2), "odd": (3, 6)}
    out = None
    for name, (h, w) in sizes.items():
        part = long_form(
            df.withColumn("size", F.lit(name)), ["vec_id", "size"], t.resize_nearest("embedding", C, H, W, h, w)
        )
        out = part if out is None else out.unionAll(part)
    return out


@query(
    "concat_models",
    """SELECT vec_id, i AS pos,
       CASE WHEN i % 6 < 4 THEN embedding[(i // 6) * 4 + i % 6 + 1]::DOUBLE
            ELSE embedding[32 + (i // 6) * 2 + i % 6 - 4 + 1]::DOUBLE END AS value
FROM embeddings, range(96) r(i)""",
)
def concat_models(spark, sf):
    """A 4-channel and a 2-channel model on the same 16 tokens, joined by key."""
    df = _embeddings(spark, sf)
    second = df.select("vec_id", F.slice("embedding", 33, 32).alias("second"))
    joined = df.join(second, "vec_id")
    return long_form(joined, ["vec_id"], t.concat_models(["embedding", "second"], [4, 2], TOKENS))


@query(
    "image_normalize",
    f"""WITH px AS (SELECT vec_id, i, ({_PX.format("(i // 3)")})::DOUBLE AS x FROM embeddings, range(192) r(i))
SELECT vec_id, i AS pos, round((x / 255 - [0.485, 0.456, 0.406][i % 3 + 1]::DOUBLE)
       / [0.229, 0.224, 0.225][i % 3 + 1]::DOUBLE, 6) + 0.0 AS value, x AS plain FROM px""",
)
def image_normalize(spark, sf):
    """All values as an 8 by 8 gray image made RGB, normalised and as plain floats."""
    df = _embeddings(spark, sf).select("vec_id", t.gray_to_rgb(_pixels(), 64).alias("px"))
    both = df.select(
        "vec_id",
        F.posexplode(F.arrays_zip(t.image_normalize("px", 64).alias("value"), t.image_to_float("px").alias("plain"))),
    )
    return both.select("vec_id", big("pos").alias("pos"), r6("col.value").alias("value"), "col.plain")


@query(
    "center_crop",
    _gather_sql(16, "(i // 4) * 16 + ((i % 4) // 2 + 1) * 4 + i % 2 + 1"),
)
def center_crop(spark, sf):
    return long_form(_embeddings(spark, sf), ["vec_id"], t.center_crop("embedding", C, H, W, 2))


@query(
    "clip_symmetric",
    """SELECT event_id, greatest(-50.0::DOUBLE, least(50.0::DOUBLE, value - 100)) AS clipped,
       value - 100 AS untouched FROM events""",
)
def clip_symmetric(spark, sf):
    x = F.col("value") - 100
    return table(spark, sf, "events").select(
        "event_id", t.clip_symmetric(x, 50.0).alias("clipped"), t.clip_symmetric(x, None).alias("untouched")
    )


@query(
    "obs_split",
    """SELECT vec_id, CASE WHEN i < 57 THEN 'visual' ELSE 'proprio' END AS part,
       CASE WHEN i < 57 THEN i ELSE i - 57 END AS pos, embedding[i + 1]::DOUBLE AS value
FROM embeddings, range(64) r(i)""",
)
def obs_split(spark, sf):
    visual, proprio = t.obs_split("embedding", 7)
    df = _embeddings(spark, sf)
    parts = [
        long_form(df.withColumn("part", F.lit(name)), ["vec_id", "part"], value)
        for name, value in (("visual", visual), ("proprio", proprio))
    ]
    return parts[0].unionAll(parts[1])


@query(
    "history_permute",
    _gather_sql(64, "((((i // 4) % 4) * 2 + (i // 2) % 2) * 2 + i % 2) * 4 + i // 16"),
)
def history_permute(spark, sf):
    return long_form(_embeddings(spark, sf), ["vec_id"], t.history_permute("embedding", 4, 2, 2, 4))


@query(
    "gray_to_rgb",
    f"SELECT vec_id, i AS pos, ({_PX.format('i // 3')})::DOUBLE AS value FROM embeddings, range(192) r(i)",
)
def gray_to_rgb(spark, sf):
    df = _embeddings(spark, sf).select("vec_id", _pixels().alias("px"))
    return long_form(df, ["vec_id"], t.gray_to_rgb("px", SIZE))


@query(
    "drop_alpha",
    f"""SELECT vec_id, i AS pos, ({_PX.format("(i // 3) * 4 + i % 3")})::DOUBLE AS value
FROM embeddings, range(48) r(i)""",
)
def drop_alpha(spark, sf):
    df = _embeddings(spark, sf).select("vec_id", _pixels().alias("px"))
    return long_form(df, ["vec_id"], t.drop_alpha("px", 16))


@query(
    "bf16_round",
    """WITH long AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) r(i)),
scaled AS (SELECT *, pow(2, floor(log2(abs(v))) - 7) AS step FROM long)
SELECT vec_id, i AS pos, CASE WHEN v = 0 THEN 0.0
  WHEN abs(v / step - trunc(v / step)) = 0.5 THEN 2 * round(v / step / 2) * step
  ELSE round(v / step) * step END AS value FROM scaled""",
)
def bf16_round(spark, sf):
    return long_form(_embeddings(spark, sf), ["vec_id"], t.bf16_round("embedding"))


@query(
    "l2_normalize",
    """WITH norms AS (SELECT vec_id, greatest(sqrt(sum(embedding[i + 1]::DOUBLE ** 2)), 1e-12) AS norm
  FROM embeddings, range(64) r(i) GROUP BY ALL)
SELECT vec_id, i AS pos, round(embedding[i + 1]::DOUBLE / norm, 6) + 0.0 AS value
FROM embeddings JOIN norms USING (vec_id), range(64) r(i)""",
)
def l2_normalize(spark, sf):
    return long_form(_embeddings(spark, sf), ["vec_id"], t.l2_normalize("embedding"), exact=False)


@query(
    "block_upscale",
    """SELECT vec_id, i AS pos, CASE WHEN i // 20 >= 16 OR i % 20 >= 16 THEN 0.0
  ELSE embedding[((i // 20) // 2) * 8 + (i % 20) // 2 + 1]::DOUBLE END AS value FROM embeddings, range(400) r(i)""",
)
def block_upscale(spark, sf):
    """All values as an 8 by 8 image, each cell twice both ways, in a 20 by 20 image."""
    return long_form(_embeddings(spark, sf), ["vec_id"], t.block_upscale("embedding", 8, 8, 1, out=20))


@query(
    "foreground_mask",
    """WITH long AS (SELECT vec_id, i AS token, embedding[i * 4 + 1]::DOUBLE AS pc1, embedding[i * 4 + 2]::DOUBLE AS pc2,
  embedding[i * 4 + 3]::DOUBLE AS pc3, embedding[i * 4 + 4]::DOUBLE AS pc4 FROM embeddings, range(16) r(i))
SELECT vec_id, token, CASE WHEN pc1 < 0.05 THEN 0.0 ELSE pc1 END AS pc1, CASE WHEN pc1 < 0.05 THEN 0.0 ELSE pc2 END AS pc2,
  CASE WHEN pc1 < 0.05 THEN 0.0 ELSE pc3 END AS pc3, CASE WHEN pc1 < 0.05 THEN 0.0 ELSE pc4 END AS pc4 FROM long""",
)
def foreground_mask(spark, sf):
    from featmill.operators.panels import apply_foreground, token_rows

    rows = token_rows(_embeddings(spark, sf), ["vec_id"], "embedding", C, TOKENS)
    components = [F.col("vector")[k].cast("double").alias(f"pc{k + 1}") for k in range(C)]
    return apply_foreground(rows.select("vec_id", big("token").alias("token"), *components), 0.05)


@query(
    "feature_rename",
    """SELECT vec_id AS key, i AS pos, embedding[i + 1]::DOUBLE AS dinov2 FROM embeddings, range(64) r(i)""",
)
def feature_rename(spark, sf):
    """Only the requested column, under its new name."""
    kept = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("dinov2"))
    return long_form(kept, ["key"], F.col("dinov2")).withColumnRenamed("value", "dinov2")


@query(
    "transform_hook",
    """SELECT vec_id, i AS pos, round(embedding[i + 1]::DOUBLE * 2 + 1, 6) + 0.0 AS value
FROM embeddings, range(64) r(i)""",
)
def transform_hook(spark, sf):
    from featmill.operators.extract import transform_hook as hook

    df = hook(
        _embeddings(spark, sf), "embedding", lambda v: F.transform(v, lambda x: x.cast("double") * 2 + 1)
    )
    return long_form(df, ["vec_id"], F.col("embedding"), exact=False)


def embeddings_by_model(spark, sf):
    """Embeddings with the model their label stands for."""
    models = model_table(spark).select("pos", "model")
    return _embeddings(spark, sf).join(models, F.col("label") % 6 == F.col("pos")).drop("pos")


@query(
    "normalize_join",
    f"""WITH e AS (SELECT vec_id, lower(replace(m.model, '/', '_')) AS model, embedding::DOUBLE[] AS v
  FROM embeddings JOIN {MODEL_SQL} ON label % 6 = m.pos),
one AS (SELECT model, c, unnest(v[c * 16 + 1:c * 16 + 16]) AS x FROM (SELECT model, v, unnest(range(4)) AS c FROM e
  WHERE NOT contains(model, 'llava'))),
stats AS (SELECT model, list(mean ORDER BY c) AS mean, list(std ORDER BY c) AS std
  FROM (SELECT model, c, avg(x) AS mean, stddev_samp(x) AS std FROM one GROUP BY model, c) GROUP BY model),
normal AS (SELECT vec_id, model, CASE WHEN mean IS NULL THEN v
  ELSE list_transform(v, lambda x, i: (x - mean[(i - 1) // 16 + 1]) / std[(i - 1) // 16 + 1]) END AS v
  FROM e LEFT JOIN stats USING (model))
SELECT vec_id, model, (i % 16) * 4 + i // 16 AS pos, round(v[i + 1], 6) + 0.0 AS value
FROM (SELECT *, unnest(range(64)) AS i FROM normal)""",
)
def normalize_join(spark, sf):
    """Normalise by model; one model has no statistics and keeps its values."""
    df = embeddings_by_model(spark, sf).withColumn("model", model_name_legit(F.col("model")))
    stats = channel_stats(df.where(~F.col("model").contains("llava")), "embedding", C, TOKENS, ["model"])
    tokens = df.withColumn("embedding", t.chw_to_tokens("embedding", C, H, W))
    normal = normalize_features(tokens, stats, C, TOKENS)
    return long_form(normal, ["vec_id", "model"], F.col("embedding"), exact=False)
