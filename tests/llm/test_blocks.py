"""Operators cut into many small shards, blocks and groups give what they give whole."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from featmill.llm import neardup, repeats, vectors


def test_top_inner_products_over_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 50)
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "GROUP", 2)
    rng = np.random.default_rng(9)
    whole = rng.integers(-50, 50, (430, 5))
    whole[60:90] = whole[60]
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in enumerate(whole)], "id bigint, v array<bigint>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in vectors.top_inner_products(df, F.col("id") % 10 == 0, 4).collect()}
    want = {}
    for q in range(0, 430, 10):
        best = sorted((-int(whole[q] @ whole[k]), k) for k in range(430) if k != q)[:4]
        want |= {(q, n + 1): (k, -s) for n, (s, k) in enumerate(best)}
    assert got == want


def near_copies():
    """Three originals with copies that are alike through them only, chains, and texts of their own."""
    rng = np.random.default_rng(4)
    rows = []
    for b in range(3):
        base = [f"b{b}w{k}" for k in range(300)]
        rows.append((900 + b, " ".join(base)))
        for k in range(40):
            at = set(rng.choice(300, 4, replace=False).tolist())
            rows.append((100 * b + k, " ".join(f"e{b}_{k}_{j}" if j in at else w for j, w in enumerate(base))))
    return rows + [(2000 + k, " ".join(f"u{k}_{j}" for j in range(80))) for k in range(20)]


def test_near_duplicates_in_small_blocks(make, monkeypatch):
    docs = make(near_copies())
    usual = sorted(map(str, neardup.near_components(docs).collect()))
    for name, value in (("HELD", 2), ("PASSING", 3), ("PER_TASK", 2)):
        monkeypatch.setattr(neardup, name, value)
    assert sorted(map(str, neardup.near_components(docs).collect())) == usual
    assert len({r.split("component_id=")[1] for r in usual}) < len(usual) / 2


def test_repeats_handed_on_in_small_pieces(make, monkeypatch):
    passages = [" ".join(f"p{p}w{k}" for k in range(70)) for p in range(5)]
    rows = [(i, " ".join([f"own{i}", passages[i % 5], f"mid{i}", passages[i * 3 % 5]])) for i in range(40)]
    docs = make(rows).repartition(3)
    usual = sorted(map(str, repeats.remove_repeats(docs).collect()))
    monkeypatch.setattr(repeats, "HELD", 40)
    assert sorted(map(str, repeats.remove_repeats(docs).collect())) == usual
