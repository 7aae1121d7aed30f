"""The repair of conversations against a plain one that tries all edits."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import product

import numpy as np
import pytest

from featmill.llm import repair
from featmill.llm.queries import QUERIES
from featmill.llm.repair import damaged, repair_report, repaired_turns, solve, whole

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def cheapest(symbols):
    """``(cost, audit, roles)``, the least of all edits; symbols are ``(initial, truncated, gone)``."""

    @lru_cache(None)
    def best(at, last, inserted):
        found = [(0, "", ())] if at == len(symbols) and last in ("", "a") else []
        to = "a" if last == "u" else "u"
        if inserted < 3:
            cost, audit, roles = best(at, to, inserted + 1)
            found.append((cost + 3, "I" + audit, (to, *roles)))
        if at < len(symbols):
            initial, truncated, gone = symbols[at]
            cost, audit, roles = best(at + 1, last, 0)
            found.append((cost + 4, "D" + audit, (None, *roles)))
            if not gone:
                cost, audit, roles = best(at + 1, to, 0)
                found.append((cost + 3 + 3 * truncated, "R" + audit, (to, *roles)))
                if initial == to or (initial == "s" and last == ""):
                    cost, audit, roles = best(at + 1, initial, 0)
                    found.append((cost + 3 * truncated, "K" + audit, (initial, *roles)))
        return min(found, key=lambda f: f[:2], default=(10**9, "", ()))

    return best(0, "", 0)


def plain(rows, spoil=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        own = convs[c]
        role, text = role if role is not None else " ", text if text is not None else " "
        tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20 if spoil else 9
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        own += [(turn is not None, turn or 0, tie, role, text)] * (1 + (fault == 3))
    out = {}
    for c, own in convs.items():
        own.sort()
        counts, seen, symbols, illegal = Counter(), set(), [], 0
        for k, (_, _, _, role, text) in enumerate(own):
            stripped = text.strip(BLANK)
            fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else ""
            counts[fault] += 1
            seen.add((role, text))
            symbols.append((role[:1], fault == "truncated", fault in ("blank", "duplicate")))
            illegal += k > 0 and own[k - 1][3][:1] + role[:1] not in ("su", "ua", "au")
        cost, audit, roles = cheapest(tuple(symbols))
        lines, k = [], 0
        for letter, role in zip(audit, roles, strict=True):
            name = {"u": "user", "a": "assistant"}.get(role)
            if letter == "I":
                lines.append(f"{name}:")
                continue
            if letter in "KR":
                lines.append(f"{own[k][3] if letter == 'K' else name}:{own[k][4]}")
            k += 1
        turns = [t for known, t, *_ in own if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, "\n".join(lines))
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def digested(want):
    return {c: (*v[:-1], hashlib.sha256(v[-1].encode()).hexdigest()) for c, v in want.items()}


def reported(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}


def test_query_against_all_edits(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert reported(QUERIES["op13_repair_conversations"](spark, sf)) == digested(plain(rows))


def test_every_short_sequence_of_symbols():
    for n in range(4):
        for symbols in product(range(9), repeat=n):
            plainly = tuple(("suax"[s % 4], s // 4 == 1, s == 8) for s in symbols)
            assert solve(bytes(symbols)) == cheapest(plainly)[:2]


def test_long_runs_in_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    cases = [bytes(np.repeat(rng.integers(0, 9, 6), rng.integers(1, 25, 6)).astype(np.uint8).tolist()) for _ in range(40)]
    usual = [solve(c) for c in cases]
    monkeypatch.setattr(repair, "BLOCK", 4)
    assert [solve(c) for c in cases] == usual
    assert usual == [cheapest(tuple(("suax"[s % 4], s // 4 == 1, s == 8) for s in c))[:2] for c in cases]
    cost, audit = solve(bytes([1, 2]) * 3000 + bytes([1]) * 5001)
    assert len(audit) >= 11001 and cost == 7503 and audit.startswith("K" * 6000)


def generated(seed, n):
    rng = np.random.default_rng(seed)
    ends = ["fine.", "cut off", "", " \t", "so!", "x?"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", ""]
    return [
        (int(c), int(t) * (1 + int(rng.integers(0, 2))), roles[int(rng.integers(0, 7))], f"{rng.integers(0, 3)} {ends[int(rng.integers(0, 6))]}")
        for c in range(n)
        for t in range(int(rng.integers(1, 12)))
    ]


def test_generated_conversations(spark):
    rows = generated(4, 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert reported(repair_report(damaged(df))) == digested(plain(rows))
    want = plain(rows, spoil=False)
    assert reported(repair_report(whole(df))) == digested(want)
    lines = defaultdict(list)
    for r in repaired_turns(whole(df)).orderBy("conv_id", "position").collect():
        assert r.position == len(lines[r.conv_id])
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: "\n".join(x) for c, x in lines.items()} == {c: w[-1] for c, w in want.items() if re.search("[KRI]", w[-2])}


def test_one_conversation_with_most_rows(spark):
    """Longer than an Arrow batch, the same text in a third of its rows."""
    rows = [(7, k, ("user", "assistant")[k % 2], "again." if k % 3 == 0 else f"{k}.") for k in range(12_000)] + [(1, 0, "user", "a.")]
    got = reported(repair_report(whole(spark.createDataFrame(rows, SCHEMA).repartition(6))))
    assert got[7][:5] == (0, 0, 3998, 0, 0) and set(got[7][6]) <= set("DKRI") and got[1][6] in ("KI", "D")
    assert sum(got[7][6].count(x) for x in "DKR") == 12_000


def test_odd_conversations(spark):
    rows = [(1, None, None, None), (1, None, "user", "x."), (None, 0, "user", "no id"), (None, None, "assistant", "nor turn."), (2, 3, "user", "tie."), (2, 3, "user", "tie."), (2, 3, "assistant", "other.")]
    rows += [(3, 0, "", "no role."), (4, 10**18, "user", "w " * 200_000), (4, -5, "system", "?"), (5, 1, "user", "ß" * 10)]
    # Conversations of which the damage leaves nothing.
    gone = [c for c in range(100, 400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    rows += [(c, 0, "user", "a.") for c in gone]
    df = spark.createDataFrame(rows, SCHEMA)
    want = digested(plain(rows))
    assert gone and reported(repair_report(damaged(df))) == want
    extra = df.selectExpr("*", *[f"'x' AS `{c}`" for c in ("tie", "copy", "fault", "phase", "code", "initial", "digest", "again", "blank")])
    assert reported(repair_report(damaged(extra))) == want
    assert repair_report(damaged(df.where("false"))).count() == 0
    assert repaired_turns(whole(df.where("false"))).count() == 0
