"""Queries of the subpackage over given tables, against their SQL or brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from check import connect, rows_of

from featmill.llm.queries import QUERIES, SQL, word_vocabulary


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, sf):
    df = QUERIES[name](spark, sf)
    result = connect(sf).execute(SQL[name])
    names = [d[0] for d in result.description]
    got = [tuple(r) for r in df.collect()]
    assert got and sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, got) == rows_of(names, result.fetchall())


def test_all_operators_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def held(doc_id: int, parts: int, part: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % parts == part


def test_quality_separates_held_out_labels(spark, sf, texts):
    got = {r.doc_id: r for r in QUERIES["op1_quality"](spark, sf).collect()}
    assert set(got) == set(texts)
    assert all(r.held_out == held(i, 5, 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    labels = [(got[r.doc_id].score, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if held(r.doc_id, 5, 0)]
    pairs = [(a > b) + (a == b) / 2 for a, y in labels if y == 1 for b, z in labels if z == 0]
    assert sum(pairs) / len(pairs) > 0.9


def test_fingerprints_of_edited_texts(spark, sf, texts):
    got = {r.doc_id: r for r in QUERIES["op2_fingerprints"](spark, sf).collect()}
    order = sorted(texts)

    def shingles(text):
        w = text.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    away, large = [], []
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        n = len(texts[i])
        edited = texts[i][: n - n // 2] + texts[j][: n // 2]
        r = got[i]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(texts[i]), shingles(edited), shingles(texts[j])
        away += [r.near_edited - len(a & b) / len(a | b), r.near_next - len(a & c) / len(a | c)]
        large += away[-2:] if min(len(a), len(c)) >= 200 else []
    by_text = defaultdict(set)
    for i, r in got.items():
        by_text[texts[i]].add(r.fingerprint)
    assert len(got) == len(texts) and all(len(f) == 1 for f in by_text.values())
    # Few shingles leave few bins that tell something; the mean is right for them too.
    assert max(map(abs, large)) < 0.17 and abs(sum(away) / len(away)) < 0.02


def test_tokens_are_those_of_the_library(spark, sf, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_vocabulary())
    got = {r.doc_id: r for r in QUERIES["op5_bpe"](spark, sf).collect()}
    for i, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        r = got[i]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


# The rules of the query, as they are stated.
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text: str):
    def passes(kind, match):
        digits = re.sub("[^0-9]", "", match)
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "card":
            twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            return 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in twice) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    return sorted(
        (m.start(), k, m.end()) for k, (kind, rule) in enumerate(RULES.items()) for m in re.finditer(rule, text) if passes(kind, m[0])
    )


def test_personal_data_base(spark, sf, texts):
    got = {r.doc_id: r for r in QUERIES["op6_personal_data"](spark, sf).collect()}
    kinds = list(RULES)
    for i, text in texts.items():
        want = base_spans(text)
        listed = [f"{kinds[k]}:{a}:{b}" for a, k, b in want]
        r, counts = got[i], Counter(k for _, k, _ in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in range(4))
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",")) | ({""} if not listed else set())


def test_repeated_passages_go(spark, sf, texts):
    first, windows = {}, {}
    for i in sorted(texts):
        words = texts[i].encode().split()
        windows[i] = [tuple(words[k : k + 50]) for k in range(len(words) - 49)]
        for w in windows[i]:
            first.setdefault(w, i)
    got = {r.doc_id: r for r in QUERIES["op8_substring_dedup"](spark, sf).collect()}
    for i, text in texts.items():
        words = text.encode().split()
        gone = {k + j for k, w in enumerate(windows[i]) if first[w] < i for j in range(50)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        assert (got[i].n_words, got[i].n_removed) == (len(words), len(gone))
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_near_duplicates_are_all_linked(spark, sf, texts):
    sets = {}
    for i, text in texts.items():
        w = text.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i in sets:
        for s in sets[i]:
            holders[s].append(i)
    pairs = {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.doc_id: r for r in QUERIES["op9_near_dedup"](spark, sf).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {
        i: (len(sets[i]), root(i), root(i) == i) for i in sets
    }


def test_languages_of_held_out_documents(spark, sf, texts):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = {r.doc_id: r for r in QUERIES["op10_language_id"](spark, sf).collect()}
    assert set(got) == set(texts)
    assert all(r.held_out == held(i, 3, 1) and 0 <= r.score <= 1 for i, r in got.items())
    out = [r for r in got.values() if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in out) / len(out) > 0.97


def test_quality_against_a_plain_learner(spark, sf, texts):
    """Follow-the-regularised-leader with dictionaries, one slot at a time."""
    import regex
    import xxhash
    from pyspark.sql import functions as F

    from featmill.llm import quality

    def plain_features(text):
        tokens = regex.findall(r"[\p{L}\p{N}]+|[^ \t\n\x0b\f\r\p{L}\p{N}]+", text)
        h = [xxhash.xxh64_intdigest(t.encode(), 42) for t in tokens]
        most = (1 << 64) - 1
        slots = [x >> 46 for x in h]
        slots += [1 if a == b else ((((a * int(quality._PAIR)) & most) ^ (b >> 7)) * int(quality._PAIR) & most) >> 46 for a, b in zip(h, h[1:])]
        found = Counter(slots)
        return [(0, 1.0), *[(s, (n / len(slots)) ** 0.5) for s, n in sorted(found.items())]]

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if not held(r.doc_id, 5, 0)}
    ids = spark.createDataFrame([(i,) for i in texts if i in labels], "doc_id bigint").withColumn("h", F.xxhash64("doc_id"))
    order = [r.doc_id for r in sorted(ids.collect(), key=lambda r: (r.h, r.doc_id))]
    assert len(order) < 2 * quality.SHARD  # one shard
    share = sum(labels[i] for i in order) / len(order)
    z, n = defaultdict(float), defaultdict(float)

    def weight(s):
        if abs(z[s]) <= quality.L1:
            return 0.0
        return -(z[s] - (1 if z[s] > 0 else -1) * quality.L1) / ((quality.BETA + n[s] ** 0.5) / quality.ALPHA + quality.L2)

    def probability(row):
        return 1 / (1 + math.exp(-sum(weight(s) * x for s, x in row)))

    rows = {i: plain_features(texts[i]) for i in texts}
    for _ in range(quality.PASSES):
        for i in order:
            c = 0.5 / share if labels[i] else 0.5 / (1 - share)
            away = c * (probability(rows[i]) - labels[i])
            # Slot 0 may be met twice: its weight counts as it was before the row.
            before = [(s, x, weight(s), n[s]) for s, x in rows[i]]
            for s, x, w, old in before:
                g = away * x
                z[s] += g - ((old + g * g) ** 0.5 - old**0.5) / quality.ALPHA * w
                n[s] += g * g
    got = {r.doc_id: r.score for r in QUERIES["op1_quality"](spark, sf).collect()}
    assert max(abs(got[i] - probability(rows[i])) for i in texts) < 1e-3


def test_languages_against_plain_rank_distances(spark, sf, texts):
    """Counters of n-grams, ranks and out-of-place distances, one document at a time."""
    from featmill.llm.language import PROFILE

    def ngrams(text):
        found = Counter()
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        for k, w in enumerate(words):
            padded = f"\x01{w}\x01"
            found.update(w)
            found.update(padded[i : i + 2] for i in range(len(padded) - 1))
            found.update(padded[i : i + 3] for i in range(len(padded) - 2))
        return found

    def code(gram):
        value = 0
        for c in gram:
            value = value << 21 | ord(c)
        return value

    def ranked(counts):
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:PROFILE]]

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    totals = defaultdict(Counter)
    for r in rows:
        if r.lang is not None and not held(r.doc_id, 3, 1):
            totals[r.lang].update(ngrams(texts[r.doc_id]))
    profiles = {lang: {g: k for k, g in enumerate(ranked(c))} for lang, c in totals.items() if c}
    got = {r.doc_id: r for r in QUERIES["op10_language_id"](spark, sf).collect()}
    for i, text in texts.items():
        own = ranked(ngrams(text))
        if not own:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        away, lang = min((sum(abs(p[g] - k) if g in p else PROFILE for k, g in enumerate(own)), lang) for lang, p in profiles.items())
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(1 - away / (PROFILE * len(own)), abs=1e-12)
