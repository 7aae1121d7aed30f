"""Queries for names, registry, mixes and work lists.

Samples reach the literal registry and mixes through ``user_id``: each user stands for a dataset.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from featmill.functions import naming as n
from featmill.operators.ordinals import number_rows, split_totals
from featmill.plans import catalog as c
from featmill.plans.registry import MODEL_SIZES, NAMED_MIXES, registry_rows
from featmill.sources.files import splits_long
from featmill.workload.base import DOC_SAMPLES_SQL, MODEL_SQL, big, doc_samples, doc_shards, query, table
from featmill.workload.tensors import embeddings_by_model


def _quoted(values) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


_REGISTRY_SQL = """registry(pos, dataset, kind, versions, episodes, steps, views) AS (VALUES {})""".format(
    ",\n".join(
        f"({i},'{name}','{kind}',{_quoted(versions)},{'NULL' if episodes is None else episodes}::BIGINT,{steps},"
        f"{_quoted(views)})"
        for i, (name, kind, versions, episodes, steps, views) in enumerate(registry_rows())
    )
)
_N_DATASETS = len(registry_rows())
_SEEN_SQL = f"""{_REGISTRY_SQL},
seen AS (SELECT e.event_id, e.user_id, e.value, r.* FROM events e JOIN registry r ON e.user_id % {_N_DATASETS} = r.pos)"""


def _mixes_sql(*names: str) -> str:
    rows = [
        f"('{mix}',{pos}::BIGINT,'{dataset}',{weight!r}::DOUBLE)"
        for mix in names
        for pos, (dataset, weight) in enumerate(NAMED_MIXES[mix])
    ]
    return "mixes(mix, pos, dataset, weight) AS (VALUES {})".format(",".join(rows))


def numbered_registry(spark):
    registry = c.dataset_registry(spark)
    order = F.create_map(*[F.lit(x) for i, row in enumerate(registry_rows()) for x in (row[0], i)])
    return registry.withColumn("pos", F.element_at(order, F.col("dataset")))


def seen(spark, sf):
    """Events with the registry entry of the dataset their user stands for."""
    events = table(spark, sf, "events").select("event_id", "user_id", "value")
    registry = numbered_registry(spark)
    return events.join(registry, F.col("user_id") % _N_DATASETS == F.col("pos"))


@query(
    "dataset_registry",
    f"""WITH {_SEEN_SQL},
observed AS (SELECT dataset, 'observed' AS kind, 'local' AS version, count(DISTINCT user_id) AS episodes,
  count(*) AS steps, 0 AS n_views FROM seen GROUP BY dataset)
SELECT dataset, coalesce(o.kind, r.kind) AS kind, CASE WHEN o.kind IS NULL THEN array_to_string(r.versions, ' ')
    ELSE o.version END AS versions,
  CASE WHEN o.kind IS NULL THEN r.episodes ELSE o.episodes END AS episodes,
  coalesce(o.steps, r.steps) AS steps, CASE WHEN o.kind IS NULL THEN len(r.views) ELSE 0 END AS n_views
FROM registry r LEFT JOIN observed o USING (dataset)""",
)
def dataset_registry(spark, sf):
    """The registry with entries observed in the data in place of the stated ones."""
    observed = seen(spark, sf).groupBy("dataset").agg(
        F.lit("observed").alias("kind"),
        F.array(F.lit("local")).alias("versions"),
        F.count_distinct("user_id").alias("episodes"),
        F.count("*").alias("steps"),
        F.array().cast("array<string>").alias("views"),
    )
    return c.dataset_registry(spark, observed).select(
        "dataset",
        "kind",
        F.concat_ws(" ", "versions").alias("versions"),
        "episodes",
        "steps",
        big(F.size("views")).alias("n_views"),
    )


@query(
    "split_filter",
    f"""WITH {DOC_SAMPLES_SQL}
SELECT 'plain' AS layout, replace(shard, '.tar', '-' || split || '.tar') AS name, n_samples FROM split_shards
WHERE split = 'train'
UNION ALL
SELECT 'packed', replace(shard, '.tar', '-' || split || '.tar') || '.0.tar', n_samples FROM split_shards
WHERE split = 'train'""",
)
def split_filter(spark, sf):
    """Shards of the train split by name, in both layouts."""
    from featmill.operators.ordinals import split_assign

    shards = split_assign(doc_shards(spark, sf), "dataset", "shard")
    named = shards.withColumn("name", n.split_shard_name(F.col("shard"), F.col("split")))
    packed = named.withColumn("name", F.concat("name", F.lit(".0.tar")))
    parts = [
        named.where(n.in_split(F.col("name"), "train")).withColumn("layout", F.lit("plain")),
        packed.where(n.in_split(F.col("name"), "train", packed=True)).withColumn("layout", F.lit("packed")),
    ]
    return parts[0].unionByName(parts[1]).select("layout", "name", "n_samples")


@query("model_name_legit", "SELECT page_id, lower(replace(url, '/', '_')) AS legit, replace(url, '/', '_') AS cased FROM pages")
def model_name_legit(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", n.model_name_legit(url).alias("legit"), n.model_name_legit(url, lower=False).alias("cased")
    )


_MOVING = "(contains(v, 'wrist') OR contains(v, 'hand'))"


@query(
    "view_select",
    f"""WITH {_SEEN_SQL},
counts AS (SELECT dataset, views, count(*) AS n FROM seen GROUP BY ALL),
chosen AS (
  SELECT dataset, 'first' AS mode, n, views, views[1:1] AS c FROM counts
  UNION ALL SELECT dataset, 'all', n, views, views FROM counts
  UNION ALL SELECT dataset, 'static', n, views, list_filter(views, lambda v: NOT {_MOVING}) FROM counts
  UNION ALL SELECT dataset, 'wrist', n, views, list_filter(views, lambda v: {_MOVING}) FROM counts
  UNION ALL SELECT dataset, 'other', n, views, views[1:1] FROM counts)
SELECT dataset, mode, n, array_to_string(CASE WHEN len(c) = 0 THEN views[1:1] ELSE c END, ' ') AS views FROM chosen""",
)
def view_select(spark, sf):
    """Camera views of the datasets that occur, with their sample counts, for every way of choosing."""
    counts = seen(spark, sf).groupBy("dataset", "views").agg(F.count("*").alias("n"))
    modes = {"first": None, "all": [], "static": "static", "wrist": "wrist", "other": "other"}
    shown = [
        F.struct(F.lit(name).alias("mode"), F.concat_ws(" ", n.view_select(F.col("views"), mode)).alias("views"))
        for name, mode in modes.items()
    ]
    return counts.select("dataset", "n", F.inline(F.array(*shown)))


@query(
    "nonempty_split",
    f"""WITH {DOC_SAMPLES_SQL}
SELECT dataset, sum(n)::BIGINT AS n FROM split_sizes WHERE split = 'test' GROUP BY ALL HAVING sum(n) > 0""",
)
def nonempty_split(spark, sf):
    wide = split_totals(doc_shards(spark, sf), "dataset", "shard", "n_samples", 5)
    return c.nonempty_split(splits_long(wide), "test")


@query(
    "dataset_eligible",
    f"""WITH {_SEEN_SQL} SELECT dataset, count(*) AS n FROM seen
WHERE NOT (contains(dataset, '_sim') OR contains(dataset, 'uiuc_d3field')
  OR contains(dataset, 'cmu_playing_with_food') OR contains(dataset, 'robot_vqa')) GROUP BY ALL""",
)
def dataset_eligible(spark, sf):
    return seen(spark, sf).where(n.dataset_eligible(F.col("dataset"))).groupBy("dataset").agg(F.count("*").alias("n"))


@query(
    "packed_models",
    f"""SELECT vec_id, model FROM embeddings JOIN {MODEL_SQL} ON label % 6 = m.pos WHERE NOT contains(model, 'llava')""",
)
def packed_models(spark, sf):
    return embeddings_by_model(spark, sf).where(n.is_packed_model(F.col("model"))).select("vec_id", "model")


@query(
    "sample_key",
    f"WITH {DOC_SAMPLES_SQL} SELECT member, split_part(member, '.', 1) AS key, lang || '.text' AS col FROM samples",
)
def sample_key(spark, sf):
    member = F.col("member")
    return doc_samples(spark, sf).select(
        "member", n.sample_key(member).alias("key"), n.member_column(member).alias("col")
    )


@query("image_folder_scan", "SELECT page_id, split_part(split_part(url, '/', -1), '.', 1) AS key FROM pages")
def image_folder_scan(spark, sf):
    """Sample keys of paths; reading a folder itself is covered by a test."""
    return table(spark, sf, "pages").select("page_id", n.path_key(F.col("url")).alias("key"))


@query(
    "frame_key",
    """SELECT printf('video%d_%06d', user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS key
FROM events
UNION ALL
SELECT printf('viola_%s_seq%06d_%06d', role, conv_id, turn) FROM conversations
UNION ALL
SELECT printf('viola_seq%06d_%06d', conv_id, turn) FROM conversations""",
)
def frame_key(spark, sf):
    frames = number_rows(
        table(spark, sf, "events").select("event_id", "ts", "user_id"), ["user_id"], ["ts", "event_id"], ordinal="frame"
    )
    video = F.concat(F.lit("video"), F.col("user_id").cast("string"))
    steps = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    viola = F.lit("viola")
    keys = [
        frames.select(n.video_frame_key(video, F.col("frame")).alias("key")),
        steps.select(n.robot_frame_key(viola, F.col("role"), F.col("conv_id"), F.col("turn")).alias("key")),
        steps.select(n.robot_frame_key(viola, F.lit(n.OWN_VIEW), F.col("conv_id"), F.col("turn")).alias("key")),
    ]
    return keys[0].unionAll(keys[1]).unionAll(keys[2])


@query(
    "shard_name",
    f"""WITH {DOC_SAMPLES_SQL}, named AS (
  SELECT DISTINCT dataset, lang, shard_idx FROM samples)
SELECT printf('%s_%s_train-%06d-train.tar', dataset, lang, shard_idx) AS name,
  printf('%s_train-%06d-train.tar', dataset, shard_idx) AS own,
  printf('%s_%s_train-%06d.tar', dataset, lang, shard_idx) AS robot,
  printf('/data/%s/images', lang) AS dir, '/data/images' AS own_dir,
  printf('%s_%s_train-%06d-val.tar', dataset, lang, shard_idx) AS renamed FROM named""",
)
def shard_name(spark, sf):
    """Names of the shards that hold documents, with the language as view."""
    shards = doc_samples(spark, sf).select("dataset", "lang", "shard_idx").distinct()
    dataset, lang, split, idx = F.col("dataset"), F.col("lang"), F.lit("train"), F.col("shard_idx")
    own, root, images = F.lit(n.OWN_VIEW), F.lit("/data"), F.lit("images")
    robot = n.shard_name(dataset, lang, split, idx, F.lit(True))
    return shards.select(
        n.shard_name(dataset, lang, split, idx, F.lit(False)).alias("name"),
        n.shard_name(dataset, own, split, idx, F.lit(False)).alias("own"),
        robot.alias("robot"),
        n.shard_dir(root, lang, images).alias("dir"),
        n.shard_dir(root, own, images).alias("own_dir"),
        n.split_shard_name(robot, F.lit("val")).alias("renamed"),
    )


@query(
    "target_columns",
    f"""WITH e AS (SELECT vec_id, embedding, model FROM embeddings JOIN {MODEL_SQL} ON label % 6 = m.pos),
targets AS (SELECT vec_id, embedding, model AS base, unnest(CASE WHEN contains(model, 'google/vit')
    OR contains(model, 'facebook/dino') OR contains(model, 'openai/clip')
    THEN [model, model || '_cls'] ELSE [model] END) AS target FROM e)
SELECT vec_id, target, base, i AS pos, embedding[i + 1]::DOUBLE AS value
FROM targets, range(64) r(i) WHERE NOT ends_with(target, '_cls') OR i < 4""",
)
def target_columns(spark, sf):
    """Every target of a sample's model with the stored tensor it reads; the class token is token 0 here."""
    df = embeddings_by_model(spark, sf).withColumn("cls", F.slice("embedding", 1, 4))
    targets = df.withColumn("target", F.explode(n.target_names(F.col("model"))))
    value = F.when(n.target_part(F.col("target")) == "cls", F.col("cls")).otherwise(F.col("embedding"))
    rows = targets.select(
        "vec_id", "target", n.target_base(F.col("target")).alias("base"), F.posexplode(value).alias("pos", "value")
    )
    return rows.select("vec_id", "target", "base", big("pos").alias("pos"), F.col("value").cast("double"))


@query(
    "shard_range",
    """WITH placed AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS shard_idx,
  count(*) OVER () AS total FROM documents)
SELECT 'rest' AS work, doc_id, shard_idx FROM placed WHERE shard_idx >= 130 // 50 AND shard_idx < ceil(total / 50.0)
UNION ALL
SELECT 'part', doc_id, shard_idx FROM placed WHERE shard_idx >= 130 // 50 AND shard_idx < ceil((130 + 75) / 50.0)""",
)
def shard_range(spark, sf):
    """Shards covering all samples from the 131st on, and those covering 75 of them."""
    docs = table(spark, sf, "documents").select("doc_id")
    placed = number_rows(docs, order=["doc_id"], ordinal="_o", size="_total").withColumn(
        "shard_idx", F.expr("_o div 50")
    )
    out = None
    for work, num in (("rest", -1), ("part", 75)):
        first, end = n.shard_range(130, num, F.col("_total"), 50)
        part = placed.where((F.col("shard_idx") >= first) & (F.col("shard_idx") < end)).select(
            F.lit(work).alias("work"), "doc_id", "shard_idx"
        )
        out = part if out is None else out.unionAll(part)
    return out


# ---- mixes ------------------------------------------------------------------------------------------


def observed_splits(spark, sf):
    """Split lengths of the datasets that occur: train, and validation as far as values above 50 go."""
    counts = seen(spark, sf).groupBy("dataset").agg(
        F.count("*").alias("train"),
        F.sum((F.col("value") > 50).cast("bigint")).alias("val"),
        F.lit(0).cast("bigint").alias("test"),
    )
    return splits_long(counts)


_SPLITS_SQL = """splits AS (SELECT dataset, count(*) AS train, (sum((value > 50)::BIGINT))::BIGINT AS val
  FROM seen GROUP BY dataset)"""


@query(
    "mix_concat",
    f"""WITH {_SEEN_SQL}, {_mixes_sql("rtx_franka")}, {_SPLITS_SQL},
one AS (SELECT dataset, min(pos) AS pos, arg_max(weight, pos) AS weight FROM mixes GROUP BY dataset)
SELECT one.*, coalesce(train, 0) AS n FROM one LEFT JOIN splits USING (dataset)""",
)
def mix_concat(spark, sf):
    """A mix with repeated entries, resolved, beside the samples seen of each dataset."""
    mix = c.mix_concat(c.mix_entries(spark, "rtx_franka"))
    counts = seen(spark, sf).groupBy("dataset").agg(F.count("*").alias("n"))
    joined = mix.join(counts, "dataset", "left")
    return joined.select("dataset", big("pos").alias("pos"), "weight", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "mix_unknown",
    f"""WITH {_SEEN_SQL}, {_mixes_sql("bridge", "rtx", "rtx_franka", "oxe_magic_soup", "oxe_full")},
present AS (SELECT DISTINCT dataset FROM seen)
SELECT mix, dataset, pos, weight, 'registry' AS missing_in FROM mixes ANTI JOIN registry USING (dataset)
UNION ALL
SELECT mix, dataset, pos, weight, 'data' FROM mixes ANTI JOIN present USING (dataset)""",
)
def mix_unknown(spark, sf):
    """Entries of the named mixes that the registry, or the data, does not have."""
    entries = None
    for mix in NAMED_MIXES:
        part = c.mix_entries(spark, mix).withColumn("mix", F.lit(mix))
        entries = part if entries is None else entries.unionByName(part)
    missing = {"registry": c.dataset_registry(spark), "data": seen(spark, sf).select("dataset").distinct()}
    out = None
    for where, known in missing.items():
        part = c.mix_unknown(entries, known).withColumn("missing_in", F.lit(where))
        out = part if out is None else out.unionByName(part)
    return out.select("mix", "dataset", big("pos").alias("pos"), "weight", "missing_in")


_PLAN_SQL = f"""{_SEEN_SQL}, {_mixes_sql("oxe_magic_soup")}, {_SPLITS_SQL},
chosen AS (SELECT dataset, CASE WHEN len(views) = 0 THEN ['__self__']
  WHEN len(list_filter(views, lambda v: NOT {_MOVING})) = 0 THEN views[1:1]
  ELSE list_filter(views, lambda v: NOT {_MOVING}) END AS views FROM registry)"""


@query(
    "mix_plan",
    f"""WITH {_PLAN_SQL}
SELECT 'train' AS split, dataset, unnest(views) AS view, pos, weight, train AS n
FROM mixes JOIN chosen USING (dataset) JOIN splits USING (dataset) WHERE train > 0
UNION ALL
SELECT 'val', dataset, unnest(views), pos, 1.0::DOUBLE, val
FROM mixes JOIN chosen USING (dataset) JOIN splits USING (dataset) WHERE val > 0""",
)
def mix_plan(spark, sf):
    registry, splits = c.dataset_registry(spark), observed_splits(spark, sf)
    mix = c.mix_concat(c.mix_entries(spark, "oxe_magic_soup"))
    plans = [c.mix_plan(mix, registry, splits, s, "static").withColumn("split", F.lit(s)) for s in ("train", "val")]
    both = plans[0].unionByName(plans[1])
    return both.select("split", "dataset", "view", big("pos").alias("pos"), "weight", "n")


@query(
    "mix_weights",
    f"""WITH {_PLAN_SQL}, plan AS (SELECT dataset, unnest(views) AS view, weight, train AS n
  FROM mixes JOIN chosen USING (dataset) JOIN splits USING (dataset) WHERE train > 0),
shares AS (SELECT *, weight * ceil(n * 0.1::DOUBLE) AS share FROM plan)
SELECT dataset, view, n, round(share / sum(share) OVER (), 6) + 0.0 AS weight,
  round(sum(share) OVER (), 6) + 0.0 AS expected FROM shares""",
)
def mix_weights(spark, sf):
    mix = c.mix_concat(c.mix_entries(spark, "oxe_magic_soup"))
    plan = c.mix_plan(mix, c.dataset_registry(spark), observed_splits(spark, sf), "train", "static")
    return c.mix_weights(plan, 0.1).select(
        "dataset",
        "view",
        "n",
        (F.round("weight", 6) + 0.0).alias("weight"),
        (F.round("expected", 6) + 0.0).alias("expected"),
    )


_LEGIT_MODELS = ",".join(f"'{m.replace('/', '_').lower()}'" for m in MODEL_SIZES if "llava" not in m)


@query(
    "extraction_worklist",
    f"""WITH {_SEEN_SQL}, lens AS (SELECT dataset, ceil(count(*) / 20.0)::BIGINT AS n_shards FROM seen GROUP BY ALL),
views AS (SELECT dataset, kind, unnest(CASE WHEN len(views) = 0 THEN ['__self__'] ELSE views END) AS view FROM registry),
crossed AS (SELECT v.dataset, kind, view, m.col, s.shard_idx FROM views v JOIN lens USING (dataset),
  unnest([{_LEGIT_MODELS}]) m(col), LATERAL (SELECT unnest(range(n_shards)) AS shard_idx) s)
SELECT dataset, view, col AS "column", shard_idx,
  dataset || CASE WHEN view = '__self__' THEN '' ELSE '_' || view END || printf('_train-%06d', shard_idx)
    || CASE WHEN kind = 'robot' THEN '' ELSE '-train' END || '.tar' AS shard FROM crossed""",
)
def extraction_worklist(spark, sf):
    """Work over the datasets that occur, in shards of 20 samples."""
    lengths = seen(spark, sf).groupBy("dataset").agg(F.ceil(F.count("*") / F.lit(20.0)).alias("n_shards"))
    return c.extraction_worklist(c.dataset_registry(spark), c.target_models(spark), lengths)
