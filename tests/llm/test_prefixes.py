"""The prefix trie against a plain one built from all prefixes."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from featmill.llm import prefixes
from featmill.llm.prefixes import RadixTree, prefix_trie, rebuild
from featmill.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items() if c is not None}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c >= 0 else -1)
        out[c] = own.get(c - rest, [])[:h] + own[c][h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[k] for k in children[node])
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
    return sorted(
        (
            min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(children[n]), leaves[n], saved[n],
            hashlib.sha256(",".join(str(c) for c in sorted(members[n]) if len(convs[c]) == len(n)).encode()).hexdigest(),
        )
        for n in members
    )


def got(nodes):
    none = hashlib.sha256(b"").hexdigest()
    return sorted(
        (r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends or none) for r in nodes.collect()
    )


def test_query_against_plain_trie(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain_trie(rebuilt(rows))
    found = [tuple(r) for r in QUERIES["op11_prefix_trie"](spark, sf).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def crowded(seed, n):
    """Few words, so that beginnings are shared, one of them by most; long and equal conversations."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(-7, n):
        turns = [("user", "hello")] if c % 3 else []
        turns += [(str(rng.choice(["user", "assistant"])), "x" * int(rng.integers(1, 3))) for _ in range(int(rng.integers(0, 6)))]
        turns = turns * (9 if c % 20 == 0 else 1) or [("user", "ü")]
        rows += [(c, k, role, text) for k, (role, text) in enumerate(turns)]
    return rows


@pytest.mark.parametrize("shard, n", [(64, 25), (2000, 300), (1 << 20, 300)])
def test_shards_give_the_same_trie(spark, shard, n):
    rows = crowded(5, n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    want = plain_trie(rebuilt(rows))
    assert got(prefix_trie(rebuild(df), shard)) == sorted(want)


def test_many_equal_conversations_and_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "PIECE", 7)
    rows = [(c, 0, "user", "same") for c in range(0, 2000)] + [(c, 1, "user", "end") for c in range(0, 2000)]
    assert got(prefix_trie(rebuild(spark.createDataFrame(rows, SCHEMA)))) == plain_trie(rebuilt(rows))


def test_odd_conversations(spark):
    rows = [
        (1, None, None, None), (1, 0, "", ""), (1, 0, "user", "tie"), (1, 0, "user", "tie"), (None, 0, "user", "no id"), (2, 5, "user", None),
        (3, None, "user", "x" * 100_000), (3, None, "assistant", "two nulls"), (9, 1, "user", "a"), (10, 1, "user", "b"), (-4, 1, "user", "c"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(plain_trie(rebuilt(rows)), key=str)
    assert sorted(got(prefix_trie(rebuild(df))), key=str) == want
    extra = df.selectExpr("*", *[f"'x' AS `{c}`" for c in ("family", "own", "head", "h", "key", "sizes", "node", "part", "id", "size", "n", "first")])
    assert sorted(got(prefix_trie(rebuild(extra))), key=str) == want
    assert prefix_trie(rebuild(df.where("false"))).count() == 0


def test_radix_tree_layouts():
    """Nodes grow through all four layouts, and a key may end where others go on."""
    tree = RadixTree()
    keys = [bytes([b, c]) for b in (0, 7, 255) for c in range(256)] + [b"", bytes([7]), bytes([9, 1, 2, 3])]
    for key in keys:
        tree.insert(key)
    assert sorted(tree.keys[n.value] for n in tree.nodes() if n.value is not None) == sorted(keys)
    assert [tree.keys[n.value] for n in tree.nodes() if n.value is not None] == sorted(keys)
    for n in (3, 4, 5, 16, 17, 48, 49, 256):
        tree = RadixTree()
        for b in range(n)[::-1]:
            tree.insert(bytes([b]))
        assert tree.root.next.room == next(r for r in (4, 16, 48, 256) if r >= n)
        assert [tree.root.next.get(b).value for b in range(n)] == list(range(n))[::-1]
