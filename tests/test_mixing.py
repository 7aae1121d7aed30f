from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from featmill.operators import mixing as x

WEIGHTS = {"a": 2.0, "b": 1.0, "c": 1.0}


def samples(spark, sizes):
    rows = [(d, i) for d, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "dataset string, i bigint")


def weights(spark):
    return spark.createDataFrame(list(WEIGHTS.items()), "dataset string, weight double")


def test_all_exhausted_uses_each_sample_once_in_order(spark):
    sizes = {"a": 3000, "b": 700, "c": 300}
    mixed = x.mix_all_exhausted(samples(spark, sizes), weights(spark), "dataset", ["i"], "i", seed=3)
    rows = sorted(mixed.collect(), key=lambda r: r["mix_rank"])
    assert [r["mix_rank"] for r in rows] == list(range(4000))
    for dataset, n in sizes.items():
        assert [r["i"] for r in rows if r["dataset"] == dataset] == list(range(n))
    # While all are live, draws follow the weights.
    first = Counter(r["dataset"] for r in rows[:800])
    assert abs(first["a"] - 400) < 60 and abs(first["b"] - 200) < 50 and abs(first["c"] - 200) < 50


def test_first_exhausted_stops_at_a_draw_that_finds_nothing(spark):
    sizes = {"a": 3000, "b": 700, "c": 300}
    df = samples(spark, sizes)
    full = {(r["dataset"], r["i"]): r["mix_rank"] for r in x.mix_all_exhausted(
        df, weights(spark), "dataset", ["i"], "i", seed=3).collect()}
    part = {(r["dataset"], r["i"]): r["mix_rank"] for r in x.mix_first_exhausted(
        df, weights(spark), "dataset", ["i"], "i", seed=3).collect()}
    assert part == {k: v for k, v in full.items() if v < len(part)}
    used = Counter(d for d, _ in part)
    assert any(used[d] == n for d, n in sizes.items())
    assert 900 < len(part) < 1500


def test_a_dataset_without_weight_is_left_out(spark):
    df = samples(spark, {"a": 10, "z": 10})
    assert {r["dataset"] for r in x.mix_all_exhausted(df, weights(spark), "dataset", ["i"], "i").collect()} == {"a"}


def test_seed_decides(spark):
    df, w = samples(spark, {"a": 50, "b": 50}), weights(spark)
    order = lambda seed: [
        (r["dataset"], r["i"]) for r in x.mix_all_exhausted(df, w, "dataset", ["i"], "i", seed).orderBy("mix_rank").collect()
    ]
    assert order(1) == order(1) != order(2)


def test_buffer_shuffle_stays_in_the_buffer(spark):
    out = x.buffer_shuffle(spark.range(2500), ["id"], "id", seed=1, buffer=1000).collect()
    assert sorted(r["position"] for r in out) == list(range(2500))
    assert all(r["id"] // 1000 == r["position"] // 1000 for r in out)
    assert sum(r["id"] == r["position"] for r in out) < 30


def test_sliding_shuffle_delays_like_a_buffer(spark):
    n, buffer = 40_000, 1000
    rows = x.sliding_shuffle(spark.range(n), ["id"], "id", seed=1, buffer=buffer).collect()
    assert sorted(r["position"] for r in rows) == list(range(n))
    # Away from the ends, delays less their mean: exponential, so half of the rows come before ln 2 of it, and a
    # seventh wait longer than two buffers.
    away = [r["position"] - r["id"] + buffer for r in rows if 5000 <= r["id"] < n - 10_000]
    assert abs(sum(away) / len(away) - buffer) < 60
    assert abs(sum(a < buffer * 0.6931 for a in away) / len(away) - 0.5) < 0.03
    assert abs(sum(a > 2 * buffer for a in away) / len(away) - 0.1353) < 0.02
    # Most leave their block of 1,000, which a shuffle within buffers never lets them.
    assert sum(r["id"] // buffer != r["position"] // buffer for r in rows) > n / 2


def test_any_partitioning_gives_the_same_order(spark):
    """A million samples of weights from 1e-6 to 1e6 on few and on many partitions."""
    names = [f"d{k:02d}" for k in range(13)]
    heavy = spark.createDataFrame([(d, 10.0 ** (k - 6)) for k, d in enumerate(names)], "dataset string, weight double")
    df = spark.range(1_000_000).select(F.concat(F.lit("d"), F.lpad((F.col("id") % 13).cast("string"), 2, "0")).alias("dataset"), "id")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    sums = []
    try:
        for parts in (3, 61):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            rows, w = df.repartition(parts), heavy.repartition(min(parts, 13))
            made = []
            for mix in (x.mix_all_exhausted, x.mix_first_exhausted):
                mixed = mix(rows, w, "dataset", ["id"], "id", seed=7)
                made.append(mixed.agg(F.count("*"), F.sum(F.xxhash64("dataset", "id", "mix_rank").cast("decimal(38,0)"))).first())
            shuffled = x.sliding_shuffle(rows.select("id"), ["id"], "id", seed=7, buffer=500)
            made.append(shuffled.agg(F.sum(F.xxhash64("id", "position").cast("decimal(38,0)"))).first())
            sums.append([tuple(m) for m in made])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sums[0] == sums[1] and sums[0][0][0] == 1_000_000


def test_epoch_limit_rounds_up_to_whole_steps(spark):
    mixed = spark.range(1000).withColumnRenamed("id", "mix_rank")
    expected = spark.sql("SELECT 100.5D AS expected")
    assert x.epoch_limit(mixed, expected, batch_size=16, world=2).count() == 128


def test_spot_check(spark):
    df = spark.range(5000).select(F.concat(F.lit("s"), F.expr("id div 100").cast("string")).alias("shard"), "id")
    out = x.spot_check_sample(df, "shard", "id", seed=5).collect()
    assert Counter(Counter(r["shard"] for r in out).values()) == {8: 5}
    plan = x.spot_check_sample(df, "shard", "id", seed=5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_random_targets_differ_by_batch(spark):
    out = x.random_targets(spark.range(200), "id", ["m1", "m2", "m3", "m4"], seed=1).collect()
    per_batch = Counter(r["id"] for r in out)
    assert set(per_batch.values()) == {2}
    assert min(Counter(r["model"] for r in out).values()) > 60
