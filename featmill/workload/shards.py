"""Queries that write shards, archives, episodes or batches and read them back, and streams over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmill.functions.naming import member_column, sample_key
from featmill.operators import extract as ex
from featmill.operators import mixing as x
from featmill.operators import quality as q
from featmill.operators.ordinals import batch_assign, number_rows, shard_assign, split_totals
from featmill.plans.registry import MODEL_SIZES
from featmill.session import scratch_path
from featmill.sources.episodes import episode_frames, nest_episodes
from featmill.sources.files import read_image_folder, read_splits, write_splits
from featmill.sources.tarshards import _filesystem, fetch_members, read_shards, write_shards
from featmill.sources.tensor_bytes import decode_features, decode_images, encode_features, encode_image
from featmill.streaming import shards as st
from featmill.workload.base import (
    DOC_SAMPLES_SQL,
    MODEL_SQL,
    TOKENS,
    C,
    H,
    W,
    big,
    doc_samples,
    doc_shards,
    long_form,
    query,
    r6,
    table,
)
from featmill.workload.scores import _UPDATES_SQL, meters_out, updates
from featmill.workload.tensors import _PX, _pixels, embeddings_by_model


def _embeddings(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", "embedding")


def _key(column):
    return F.lpad(F.col(column).cast("string"), 8, "0")


def embedding_members(spark, sf, per_shard=100) -> DataFrame:
    """Embeddings as feature members of shards."""
    e = _embeddings(spark, sf)
    placed = shard_assign(e.select("vec_id"), ["vec_id"], per_shard).join(e, "vec_id")
    return placed.select(
        F.format_string("emb_train-%06d-train.tar", "shard_idx").alias("shard"),
        F.concat(_key("vec_id"), F.lit(".dinov2.safetensors")).alias("member"),
        encode_features(F.col("embedding"), C, H, W, cls=F.slice("embedding", 1, 4)).alias("data"),
    )


def document_members(spark, sf) -> DataFrame:
    """Documents as members ``{key}.text`` and, where there is one, ``{key}.label``."""
    docs = doc_samples(spark, sf).select("doc_id", "shard", "key")
    texts = docs.join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select(
        "shard", F.concat("key", F.lit(".text")).alias("member"), F.encode("text", "UTF-8").alias("data")
    )
    labels = docs.join(table(spark, sf, "labels"), "doc_id").select(
        "shard",
        F.concat("key", F.lit(".label")).alias("member"),
        F.encode(F.concat_ws(" ", "quality", "toxic"), "UTF-8").alias("data"),
    )
    return texts.unionByName(labels)


def written_documents(spark, sf) -> str:
    path = scratch_path(spark, "documents")
    write_shards(document_members(spark, sf), path)
    return path


_MEMBERS_SQL = f"""{DOC_SAMPLES_SQL},
members AS (SELECT shard, s.key || '.text' AS member, text AS data FROM samples s JOIN shards USING (dataset, shard_idx)
  JOIN documents USING (doc_id)
  UNION ALL SELECT shard, s.key || '.label', quality || ' ' || toxic FROM samples s
  JOIN shards USING (dataset, shard_idx) JOIN labels USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY member) - 1 AS pos FROM members)"""


@query(
    "shard_scan",
    """SELECT printf('emb_train-%06d-train.tar', vec_id // 100) AS shard, lpad(vec_id::VARCHAR, 8, '0') AS key,
  'dinov2.safetensors' AS col, i AS pos, embedding[(i % 4) * 16 + i // 4 + 1]::DOUBLE AS value
FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, embedding FROM embeddings), range(64) r(i)""",
)
def shard_scan(spark, sf):
    """Features written as tar shards, scanned and decoded to tokens."""
    path = scratch_path(spark, "embeddings")
    write_shards(embedding_members(spark, sf), path)
    rows = read_shards(spark, path, "*-train.tar")
    decoded = rows.withColumn("feature", decode_features(F.col("data"), C, H, W))
    return long_form(
        decoded.select(
            "shard",
            sample_key(F.col("member")).alias("key"),
            member_column(F.col("member")).alias("col"),
            "feature.embedding",
        ),
        ["shard", "key", "col"],
        F.col("embedding"),
    )


@query(
    "shard_members",
    f"""WITH {_MEMBERS_SQL} SELECT shard, member, pos, octet_length(encode(data)) AS size, md5(data) AS digest FROM placed""",
)
def shard_members(spark, sf):
    """Members of every shard in name order with their bytes."""
    rows = read_shards(spark, written_documents(spark, sf)).select("shard", "member", "size", F.md5("data").alias("digest"))
    return number_rows(rows, ["shard"], ["member"], ordinal="pos")


@query(
    "shard_nth_member",
    f"""WITH {_MEMBERS_SQL} SELECT shard, member, pos, md5(data) AS digest FROM placed WHERE pos IN (0, 2, 5)""",
)
def shard_nth_member(spark, sf):
    """Positions come from a listing; then only the bytes of the members found are read."""
    path = written_documents(spark, sf)
    listed = read_shards(spark, path, payload=False).drop("data")
    found = fetch_members(q.nth_member(listed, [0, 2, 5]), path)
    return found.select("shard", "member", "pos", F.md5("data").alias("digest"))


@query(
    "shard_write",
    f"""WITH {_MEMBERS_SQL}
SELECT shard, count(*) AS n, TRUE AS ok, sum(octet_length(encode(data)))::BIGINT AS bytes FROM members GROUP BY ALL""",
)
def shard_write(spark, sf):
    """Shards of one language first, then all that are not there yet; nothing is written twice."""
    members = document_members(spark, sf)
    path = scratch_path(spark, "written")
    write_shards(members.where(F.col("shard") < "src2"), path)
    write_shards(members, path, existing=q.shard_integrity(q.list_shard_files(spark, path)))
    report = q.shard_integrity(q.list_shard_files(spark, path))
    sizes = read_shards(spark, path, payload=False).groupBy("shard").agg(F.sum("size").alias("bytes"))
    return report.join(sizes, "shard").select("shard", "n", "ok", "bytes")


def _write_files(df: DataFrame, root: str) -> None:
    """Fixture: one file per ``(path, data)`` row."""

    def write(rows):
        files, base = _filesystem(root)
        for row in rows:
            files.create_dir(f"{base}/{row['path']}".rsplit("/", 1)[0], recursive=True)
            with files.open_output_stream(f"{base}/{row['path']}") as out:
                out.write(bytes(row["data"]))

    df.foreachPartition(write)


@query(
    "image_folder_files",
    """SELECT printf('page_%05d', page_id) AS key, printf('class%d', page_id % 7) AS class,
  md5(html) AS digest FROM pages""",
)
def image_folder_files(spark, sf):
    """Pages written as files in class folders, then scanned with their keys."""
    pages = table(spark, sf, "pages").select(
        F.format_string("train/class%d/page_%05d.v1.JPEG", F.col("page_id") % 7, "page_id").alias("path"),
        F.encode("html", "UTF-8").alias("data"),
    )
    root = scratch_path(spark, "folder")
    _write_files(pages, root)
    return read_image_folder(spark, f"{root}/train").select(
        "key", F.element_at(F.split("path", "/"), -2).alias("class"), F.md5("content").alias("digest")
    )


@query(
    "episode_frames",
    """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS frame_idx, role AS view,
  md5(text) AS digest FROM conversations""",
)
def episode_frames_query(spark, sf):
    """Conversations as episodes: a step per turn, its text under the view that spoke."""
    steps = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.create_map("role", F.encode("text", "UTF-8")).alias("observation")
    )
    frames = episode_frames(nest_episodes(steps, "conv_id", ["turn"]), "conv_id")
    return frames.select("conv_id", big("frame_idx").alias("frame_idx"), "view", F.md5("image").alias("digest"))


@query(
    "frame_archive_scan",
    """SELECT printf('video%04d', user_id) AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1
  AS frame_idx, md5(props) AS digest FROM events""",
)
def frame_archive_scan(spark, sf):
    """An archive of frames per video, with a text file in each that the scan passes over."""
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", F.encode("props", "UTF-8").alias("data"))
    frames = number_rows(events, ["user_id"], ["ts", "event_id"], ordinal="frame")
    shard = F.format_string("video%04d.tar", "user_id")
    jpg = frames.select(shard.alias("shard"), F.format_string("frame_%06d.jpg", "frame").alias("member"), "data")
    notes = frames.where("frame = 0").select(shard.alias("shard"), F.lit("about.txt").alias("member"), "data")
    path = scratch_path(spark, "videos")
    write_shards(jpg.unionByName(notes), path)
    # Frames are numbered by the task that lists their archive, and only their bytes are read.
    listed = read_shards(spark, path, payload=False, members="*.jpg").drop("data")
    found = fetch_members(listed.withColumnRenamed("ordinal", "frame_idx"), path)
    return found.select(sample_key(F.col("shard")).alias("video"), "frame_idx", F.md5("data").alias("digest"))


@query(
    "splits_catalog",
    f"""WITH {DOC_SAMPLES_SQL}, totals AS (SELECT dataset, split, sum(n)::BIGINT AS n FROM split_sizes GROUP BY ALL)
SELECT dataset, split, coalesce(n, 0) AS n FROM (SELECT DISTINCT dataset, unnest(['train', 'val', 'test']) AS split FROM samples)
LEFT JOIN totals USING (dataset, split)""",
)
def splits_catalog(spark, sf):
    """Split lengths written as ``splits.json`` per dataset, then read."""
    root = scratch_path(spark, "splits")
    write_splits(split_totals(doc_shards(spark, sf), "dataset", "shard", "n_samples", 5), root)
    return read_splits(spark, root)


@query(
    "decode_features",
    """SELECT vec_id, 'embedding' AS part, i AS pos, embedding[(i % 4) * 16 + i // 4 + 1]::DOUBLE AS value
FROM embeddings, range(64) r(i)
UNION ALL SELECT vec_id, 'cls', i, embedding[i + 1]::DOUBLE FROM embeddings, range(4) r(i)""",
)
def decode_features_query(spark, sf):
    e = _embeddings(spark, sf)
    stored = e.select("vec_id", encode_features(F.col("embedding"), C, H, W, cls=F.slice("embedding", 1, 4)).alias("data"))
    decoded = stored.withColumn("f", decode_features(F.col("data"), C, H, W))
    parts = [
        long_form(decoded.withColumn("part", F.lit(name)), ["vec_id", "part"], F.col(f"f.{name}"))
        for name in ("embedding", "cls")
    ]
    return parts[0].unionAll(parts[1])


@query(
    "decode_images",
    f"""SELECT vec_id, 'gray' AS kind, 8::BIGINT AS h, i AS pos, ({_PX.format("i // 3")})::DOUBLE AS value FROM embeddings, range(192) r(i)
UNION ALL SELECT vec_id, 'rgba', 4, i, ({_PX.format("(i // 3) * 4 + i % 3")})::DOUBLE FROM embeddings, range(48) r(i)
UNION ALL SELECT vec_id, 'rgb', 8, i, ({_PX.format("(i // 3 + i % 3 * 21) % 64")})::DOUBLE FROM embeddings, range(192) r(i)""",
)
def decode_images_query(spark, sf):
    """Gray, RGBA and RGB images made from all values of every embedding; the colours of RGB are apart by 21 values."""
    e = _embeddings(spark, sf).select("vec_id", _pixels().alias("px"))
    rgb = F.transform(F.sequence(F.lit(0), F.lit(191)), lambda i: F.get("px", (F.floor(i / 3) + i % 3 * 21) % 64))
    stored = {
        "gray": encode_image(F.col("px"), 8, 8),
        "rgba": encode_image(F.col("px"), 4, 4, 4),
        "rgb": encode_image(rgb, 8, 8, 3),
    }
    out = None
    for kind, data in stored.items():
        image = e.select("vec_id", F.lit(kind).alias("kind"), data.alias("data")).withColumn("i", decode_images("data"))
        image = image.withColumn("h", big("i.h"))
        part = long_form(image, ["vec_id", "kind", "h"], F.col("i.px"))
        out = part if out is None else out.unionAll(part)
    return out


@query(
    "shard_key_counts",
    f"""WITH {_MEMBERS_SQL} SELECT shard, 'text' AS "column", count(*) FILTER (contains(member, 'text')) AS n FROM members GROUP BY shard
UNION ALL SELECT shard, 'label', count(*) FILTER (contains(member, 'label')) FROM members GROUP BY shard""",
)
def shard_key_counts(spark, sf):
    members = read_shards(spark, written_documents(spark, sf), payload=False)
    return q.shard_key_counts(members, ["text", "label"])


@query(
    "column_coverage",
    f"""WITH {_MEMBERS_SQL}, counts AS (SELECT shard, count(*) FILTER (ends_with(member, '.text')) AS text,
  count(*) FILTER (ends_with(member, '.label')) AS label FROM members GROUP BY shard)
SELECT *, text = label AS complete FROM counts""",
)
def column_coverage(spark, sf):
    members = read_shards(spark, written_documents(spark, sf), payload=False)
    return q.column_coverage(members, ["text", "label"])


@query(
    "shard_integrity",
    f"""WITH {_MEMBERS_SQL}, counts AS (SELECT shard, count(*) AS n FROM members GROUP BY shard)
SELECT shard, NOT ends_with(shard, '-000001.tar') AS ok, CASE WHEN ends_with(shard, '-000001.tar') THEN 0 ELSE n END AS n,
  CASE WHEN ends_with(shard, '-000001.tar') THEN 'broken' ELSE 'ok' END AS state FROM counts
UNION ALL SELECT DISTINCT dataset || '-999999.tar', FALSE, 0, 'missing' FROM samples""",
)
def shard_integrity(spark, sf):
    """Complete shards, one cut short per dataset, and one per dataset that was never written."""
    path = written_documents(spark, sf)
    broken = scratch_path(spark, "broken")
    files = spark.read.format("binaryFile").load(path).select(
        F.substring_index("path", "/", -1).alias("path"),
        F.when(F.col("path").endswith("-000001.tar"), F.substring("content", 1, 700)).otherwise(F.col("content")).alias("data"),
    )
    _write_files(files, broken)
    shards = doc_shards(spark, sf).select("dataset", "shard")
    absent = shards.select(F.concat("dataset", F.lit("-999999.tar")).alias("shard")).distinct()
    report = q.shard_integrity(q.list_shard_files(spark, broken), shards.select("shard").unionAll(absent))
    state = F.when(F.col("ok"), "ok").when(F.col("error") == "missing", "missing").otherwise("broken")
    return report.select("shard", "ok", F.when(F.col("ok"), F.col("n")).otherwise(0).alias("n"), state.alias("state"))


# ---- extraction ---------------------------------------------------------------------------------------


def _patches(df, output="embedding"):
    return ex.extract_features(df, "embedding", ex.patch_mean(C, H, W, 2), [C, H, W], output)


_PATCHES_SQL = """patches AS (SELECT vec_id, label, k, avg(embedding[(k // 4) * 16 + ((k % 4) // 2 * 2 + d // 2) * 4
  + (k % 2) * 2 + d % 2 + 1]::DOUBLE)::FLOAT::DOUBLE AS v FROM embeddings, range(16) p(k), range(4) q(d) GROUP BY ALL)"""


@query(
    "extract_features",
    f"""WITH {_PATCHES_SQL} SELECT vec_id, k AS pos, round(v, 6) + 0.0 AS value FROM patches""",
)
def extract_features(spark, sf):
    return long_form(_patches(_embeddings(spark, sf), "feature"), ["vec_id"], F.col("feature"), exact=False)


@query(
    "stored_embeddings",
    f"""SELECT vec_id, lower(replace(model, '/', '_')) || CASE WHEN u = 1 THEN '_32' ELSE '' END AS name,
  CASE WHEN u = 1 THEN 4096 WHEN contains(model, 'depth') THEN 16384 ELSE 64 END::BIGINT AS size,
  round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)) * CASE WHEN u = 1 THEN 64 WHEN contains(model, 'depth')
    THEN 256 ELSE 1 END, 4) + 0.0 AS total
FROM embeddings JOIN {MODEL_SQL} ON label % 6 = m.pos, range(2) c(u) WHERE u = 0 OR contains(model, 'facebook/sam')""",
)
def stored_embeddings(spark, sf):
    """What each sample's model stores, with the resized copies."""
    models = [m.replace("/", "_").lower() for m in MODEL_SIZES]
    e = embeddings_by_model(spark, sf).withColumn("model", F.lower(F.translate("model", "/", "_")))
    rows = ex.stored_rows(e.select("vec_id", "model", "embedding"), models, C, H, W)
    total = F.aggregate("tensor", F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return rows.select("vec_id", "name", big(F.size("tensor")).alias("size"), (F.round(total, 4) + 0.0).alias("total"))


@query(
    "decoder_hook",
    """SELECT 'embedding' AS col, lpad(vec_id::VARCHAR, 8, '0') AS key, i AS pos,
  embedding[(i % 4) * 16 + i // 4 + 1]::DOUBLE AS value FROM embeddings, range(64) r(i)
UNION ALL SELECT 'image', lpad(vec_id::VARCHAR, 8, '0'), i, ({px})::DOUBLE FROM embeddings, range(192) r(i)
UNION ALL SELECT 'other', lpad(vec_id::VARCHAR, 8, '0'), 0, length(label::VARCHAR)::DOUBLE FROM embeddings""".format(
        px=_PX.format("i // 3")
    ),
)
def decoder_hook(spark, sf):
    """Three stored columns; two have decoders, the third comes back as bytes."""
    e = _embeddings(spark, sf).withColumn("key", _key("vec_id"))
    columns = {
        "m.safetensors": encode_features(F.col("embedding"), C, H, W),
        "image": encode_image(_pixels(), 8, 8),
        "label": F.encode(F.col("label").cast("string"), "UTF-8"),
    }
    members = None
    for name, data in columns.items():
        part = e.select("key", F.lit(name).alias("column"), data.alias("data"))
        members = part if members is None else members.unionAll(part)
    decoders = {"m.safetensors": lambda d: decode_features(d, C, H, W), "image": decode_images}
    decoded = ex.decoder_hook(members, decoders)
    feature = long_form(
        decoded["m.safetensors"].withColumn("col", F.lit("embedding")), ["col", "key"], F.col("value.embedding")
    )
    image = long_form(decoded["image"].withColumn("col", F.lit("image")), ["col", "key"], F.col("value.px"))
    other = decoded[None].select(
        F.lit("other").alias("col"),
        "key",
        F.lit(0).cast("bigint").alias("pos"),
        F.octet_length("value").cast("double").alias("value"),
    )
    return feature.unionByName(image).unionByName(other)


@query(
    "collate_batches",
    """WITH placed AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS o FROM embeddings),
b AS (SELECT o // 16 AS batch_idx, o % 16 AS pos, vec_id, embedding FROM placed),
sized AS (SELECT *, count(*) OVER (PARTITION BY batch_idx) AS size FROM b)
SELECT batch_idx, pos, vec_id, size, i AS at, embedding[i + 1]::DOUBLE AS value FROM sized, range(64) r(i)""",
)
def collate_batches(spark, sf):
    """Batches of 16 stacked samples, unrolled again to be compared."""
    e = _embeddings(spark, sf)
    placed = batch_assign(e.select("vec_id"), ["vec_id"], 16).join(e, "vec_id")
    batches = ex.collate_batches(placed, "batch_idx", "batch_pos", ["vec_id", "embedding"])
    rows = batches.select("batch_idx", "size", F.posexplode(F.arrays_zip("vec_id", "embedding")).alias("pos", "row"))
    rows = rows.select("batch_idx", big("size").alias("size"), big("pos").alias("pos"), "row.vec_id", F.posexplode("row.embedding").alias("at", "value"))
    return rows.withColumns({"at": big("at"), "value": F.col("value").cast("double")})


@query(
    "feature_recheck",
    f"""WITH {_PATCHES_SQL}, e AS (SELECT vec_id, label, printf('s%04d', vec_id // 50) AS shard FROM embeddings),
picked AS (SELECT shard FROM (SELECT DISTINCT shard FROM e) ORDER BY md5('11:' || shard), shard LIMIT 5),
r AS (SELECT e.*, row_number() OVER (PARTITION BY shard ORDER BY md5('11:' || shard || ':' || vec_id), vec_id) AS rank
  FROM e JOIN picked USING (shard)),
sampled AS (SELECT * FROM r WHERE rank <= 8)
SELECT 'm' || label AS model, shard, count(*) AS n, count(*) FILTER (label = 4) AS missing, label NOT IN (3, 4) AS equal,
  label NOT IN (4, 5) AS keys_ok, label NOT IN (3, 4, 5) AS passed FROM sampled GROUP BY ALL""",
)
def feature_recheck(spark, sf):
    """Stored features against recomputed ones on a seeded sample; one model is damaged, one not stored, one misnamed."""
    e = _embeddings(spark, sf).select(
        "vec_id",
        F.concat(F.lit("m"), F.col("label").cast("string")).alias("model"),
        F.format_string("s%04d", F.expr("vec_id div 50")).alias("shard"),
        "embedding",
    )
    feature = _patches(e, "feature").drop("embedding").withColumnRenamed("feature", "embedding")
    stored = feature.withColumn(
        "embedding",
        F.when(F.col("model") == "m3", F.transform("embedding", lambda v: (v + 1).cast("float"))).otherwise(F.col("embedding")),
    ).withColumn("stored_key", F.col("vec_id") + (F.col("model") == "m5").cast("int"))
    sample = x.spot_check_sample(e, "shard", "vec_id", 11, shards=5, per_shard=8)
    again = _patches(sample, "feature").select("vec_id", "model", "shard", F.col("feature").alias("embedding"))
    chosen = stored.where("model <> 'm4'").join(sample.select("vec_id"), "vec_id", "left_semi")
    diff = q.feature_diff(chosen, again, ["vec_id"], ["model", "shard"])
    keys = again.select("model", "shard", "vec_id").join(chosen.select("vec_id", "stored_key"), "vec_id", "left")
    keys = keys.groupBy("model", "shard").agg(
        F.count("*").alias("n"), F.bool_and(F.col("vec_id").eqNullSafe(F.col("stored_key"))).alias("keys_ok")
    )
    return diff.join(keys, ["model", "shard"]).select(
        "model", "shard", "n", "missing", "equal", "keys_ok", (F.col("equal") & F.col("keys_ok")).alias("passed")
    )


# ---- streams ------------------------------------------------------------------------------------------


def _arrivals(spark, sf):
    """Embeddings as Parquet shards that have arrived in a folder."""
    e = _embeddings(spark, sf).withColumn("shard_idx", F.expr("vec_id div 100"))
    path = scratch_path(spark, "arrivals")
    e.repartition("shard_idx").write.parquet(path)
    return st.stream_shards(spark, path, e.schema, max_files=2)


@query("stream_shards", "SELECT vec_id, label::BIGINT AS label, vec_id // 100 AS shard_idx FROM embeddings")
def stream_shards(spark, sf):
    """Every arriving row lands once."""
    out = scratch_path(spark, "landed")
    st.drain(_arrivals(spark, sf).select("vec_id", big("label").alias("label"), "shard_idx"), out, scratch_path(spark, "progress"))
    return spark.read.parquet(out)


@query(
    "stream_archives",
    f"""WITH {_MEMBERS_SQL} SELECT shard, member, octet_length(encode(data)) AS size, md5(data) AS digest FROM members""",
)
def stream_archives(spark, sf):
    """Tar shards of documents that arrive in two goes; each member lands once."""
    arrived, out, progress, log = (scratch_path(spark, n) for n in ("arrived", "landed", "progress", "log"))
    members = document_members(spark, sf)
    early = F.col("shard") < "src2"
    for part in (early, ~early):
        write_shards(members.where(part), arrived)
        stream = st.stream_archives(spark, arrived, log, max_shards=500)
        st.drain(stream.select("shard", "member", "size", F.md5("data").alias("digest")), out, progress)
    return spark.read.parquet(out)


@query(
    "stream_archive_sink",
    f"""WITH {_MEMBERS_SQL} SELECT shard, member, octet_length(encode(data)) AS size, md5(data) AS digest FROM members""",
)
def stream_archive_sink(spark, sf):
    """Documents' shards that arrive in two goes, written to shards again by a stream that is run three times."""
    arrived, out, progress, log = (scratch_path(spark, n) for n in ("arrived", "shards", "progress", "log"))
    members = document_members(spark, sf)
    early = F.col("shard") < "src2"
    for part in (early, ~early, None):
        if part is not None:
            write_shards(members.where(part), arrived)
        st.drain_archives(st.stream_archives(spark, arrived, log), out, progress)
    rows = read_shards(spark, out)
    name = F.regexp_replace("shard", r"-\d{6}\.tar$", ".tar")
    return rows.select(name.alias("shard"), "member", "size", F.md5("data").alias("digest"))


@query(
    "stream_channel_stats",
    """WITH long AS (SELECT i // 16 AS channel, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) r(i))
SELECT channel, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(stddev_samp(v), 6) + 0.0 AS std FROM long GROUP BY ALL""",
)
def stream_channel_stats(spark, sf):
    out = scratch_path(spark, "statistics")
    st.drain_table(st.stream_channel_stats(_arrivals(spark, sf), "embedding", C, TOKENS), out, scratch_path(spark, "progress"))
    return st.latest(spark, out).select(
        big("channel").alias("channel"), "n", r6("mean").alias("mean"), r6("std").alias("std")
    )


@query(
    "stream_meters",
    f"""WITH {_UPDATES_SQL} SELECT mode, model, loss, round(s, 2) AS sum, c AS count,
  round(s / c + 1.2345678e-9, 6) + 0.0 AS avg FROM meters""",
)
def stream_meters(spark, sf):
    reports = updates(table(spark, sf, "events"))
    arrived = scratch_path(spark, "reports")
    reports.repartition(4, "worker").write.parquet(arrived)
    out = scratch_path(spark, "meters")
    stream = st.stream_meters(st.stream_shards(spark, arrived, reports.schema, max_files=1))
    st.drain_table(stream, out, scratch_path(spark, "progress"))
    return meters_out(st.latest(spark, out))


@query(
    "stream_extract",
    f"""WITH {_PATCHES_SQL} SELECT vec_id, vec_id // 100 AS shard_idx, k AS pos, round(v, 6) + 0.0 AS value FROM patches""",
)
def stream_extract(spark, sf):
    """Extraction run twice over what has arrived; the second run finds nothing to do."""
    stream = _arrivals(spark, sf)
    out, progress = scratch_path(spark, "extracted"), scratch_path(spark, "progress")
    work = lambda batch: _patches(batch, "feature").select("vec_id", "shard_idx", "feature")
    for _ in range(2):
        st.stream_extract(stream, work, out, progress)
    return long_form(
        spark.read.parquet(out).withColumn("shard_idx", big("shard_idx")), ["vec_id", "shard_idx"], F.col("feature"), exact=False
    )
