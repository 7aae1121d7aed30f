"""Queries of the operators of this subpackage over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE
  len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss,
  CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY source),
t AS (SELECT *, sum(ss) OVER () AS total FROM s),
-- Sources that reach their cap come first in the order of size by weight.
r AS (SELECT *, coalesce(sum(2 * ss) OVER (ORDER BY ss::DOUBLE / w, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
      sum(w) OVER (ORDER BY ss::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl
      FROM t),
lv AS (SELECT *, (150 * total - 100 * capped)::DOUBLE / (100.0::DOUBLE * wl) AS level FROM r),
-- The level is that of the first source that does not reach its cap.
pick AS (SELECT level FROM lv WHERE level * w < 2 * ss ORDER BY ss::DOUBLE / w, source NULLS LAST LIMIT 1),
g AS (SELECT s.*, least((2 * ss)::DOUBLE, coalesce((SELECT level FROM pick), 1e300) * w) AS target FROM s),
c AS (SELECT d.*, ss, target,
  sum(size) OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR), doc_id ROWS UNBOUNDED PRECEDING) AS cum,
  row_number() OVER (ORDER BY d.source NULLS LAST, md5(doc_id::VARCHAR), doc_id) AS o
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT doc_id, size, o, copy, (copy * ss + cum)::DOUBLE / target AS time
  FROM c, (VALUES (0), (1)) v(copy) WHERE size > 0 AND target > 0),
u AS (SELECT *, sum(size) OVER (ORDER BY time, o, copy ROWS UNBOUNDED PRECEDING) AS used FROM e),
k AS (SELECT o, sum(size) AS taken FROM u WHERE used * 100 <= 150 * (SELECT sum(size) FROM d) GROUP BY o)
SELECT doc_id, size, ss AS source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM c LEFT JOIN k USING (o)
"""


@query("op7_mix_sources", MIX_SQL)
def op7_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the words the mix takes of each."""
    from featmill.llm.mixing import document_sizes, mix_plan

    plan = mix_plan(document_sizes(documents(spark, sf)))
    return plan.select(
        "doc_id", "size", "source_size", "target", (F.col("taken_copies") * F.col("size")).alias("taken")
    )


@query("op2_fingerprints")
def op2_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of texts and of their edited forms, and how alike they are."""
    from featmill.llm.fingerprints import fingerprint_text, likeness, next_documents, replace_end

    rows = next_documents(documents(spark, sf), replace_end)
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint_text("fp").alias("fingerprint"), fingerprint_text("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
    )


LICENSE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT n, label, is_base, words, len(words) - 2 AS runs FROM (VALUES {templates}) v(n, label, is_base, words)),
tp AS (SELECT n, label, is_base, runs, i AS t, array_to_string(words[i + 1:i + 3], ' ') AS gram
  FROM t, unnest(range(runs)) u(i)),
g AS (SELECT doc_id, i AS p, array_to_string(w[i + 1:i + 3], ' ') AS gram
  FROM d, unnest(range(greatest(len(w) - 2, 0))) u(i)),
h AS (SELECT doc_id, n, label, is_base, runs, p - t AS diagonal, list(t) AS ts, min(t) AS lo, max(t) AS hi
  FROM g JOIN tp USING (gram) GROUP BY doc_id, n, label, is_base, runs, p - t),
-- Diagonals merge over a gap less than the notice is long, and at most 4; places of a base phrase stay apart.
m AS (SELECT *, CASE WHEN is_base OR coalesce(diagonal - lag(diagonal) OVER x > least(4, runs + 1), true) THEN 1 ELSE 0 END AS fresh
  FROM h WINDOW x AS (PARTITION BY doc_id, n ORDER BY diagonal)),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, n ORDER BY diagonal) AS cluster FROM m),
s AS (SELECT doc_id, n, label, is_base, runs, min(diagonal + lo) AS a, max(diagonal + hi + 2) AS z,
  len(list_distinct(flatten(list(ts)))) AS found FROM c GROUP BY doc_id, n, label, is_base, runs, cluster),
f AS (SELECT *, found::DOUBLE / runs AS cover FROM s
  WHERE CASE WHEN is_base THEN found = runs ELSE found::DOUBLE / runs >= 0.6::DOUBLE AND z - a + 1 <= (runs + 2) * 1.5 END),
-- Of notices that overlap, those of the highest coverage stay.
k AS (SELECT * FROM f WHERE is_base OR NOT EXISTS (SELECT 1 FROM f o WHERE o.doc_id = f.doc_id AND NOT o.is_base
  AND o.n <> f.n AND o.a <= f.z AND o.z >= f.a AND o.cover > f.cover))
SELECT d.doc_id, len(w)::BIGINT AS n_words, count(k.doc_id) FILTER (is_base)::BIGINT AS n_base,
  (min(a) FILTER (is_base))::BIGINT AS first_word, (max(a) FILTER (is_base))::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
  coalesce(max(cover), 0.0::DOUBLE) AS score
FROM d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id, w
"""


def _license_sql() -> str:
    from featmill.llm.licenses import BASE, NOTICES

    rows = [(True, *x) for x in BASE] + [(False, *x) for x in NOTICES]
    values = ", ".join(f"({n}, '{label}', {str(b).lower()}, {words.split()})" for n, (b, label, words) in enumerate(rows))
    return LICENSE_SQL.replace("{templates}", values)


@query("op4_license_scan", _license_sql())
def op4_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """License phrases and notices in each document."""
    from featmill.llm.licenses import license_summary, scan_licenses

    return license_summary(scan_licenses(documents(spark, sf)))


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Language of each document, learned from two thirds of them."""
    from featmill.llm.language import held_out, learn_profiles, predict_language

    docs = documents(spark, sf).withColumn("held_out", held_out("doc_id", 3, 1))
    profiles = learn_profiles(docs.where(~F.col("held_out")))
    return predict_language(docs, profiles, ["doc_id", "held_out"])


@query("op1_quality")
def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of each document, learned from four fifths of the labelled ones."""
    from featmill.llm import quality
    from featmill.llm.language import held_out

    docs = documents(spark, sf).withColumn("held_out", held_out("doc_id", 5, 0))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    weights = quality.train(docs.where(~F.col("held_out")), labels.where(~held_out("doc_id", 5, 0)), "quality")
    scored = quality.score(docs, weights, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


TOP_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op3_top_inner_products", TOP_SQL)
def op3_top_inner_products(spark: SparkSession, sf: str) -> DataFrame:
    """Ten best inner products of every hundredth vector with all others."""
    from featmill.llm.vectors import floor_components, top_inner_products

    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = rows.select(F.col("vec_id").alias("id"), floor_components("embedding").alias("v"))
    return top_inner_products(rows, F.col("id") % 100 == 0)


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op5_bpe")
def op5_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of each document and what they decode to."""
    from featmill.llm.bpe import token_digests, tokenize

    return token_digests(tokenize(documents(spark, sf), word_vocabulary(), ["doc_id"]), ["doc_id"])


@query("op8_substring_dedup")
def op8_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of each document without passages of smaller ids."""
    from featmill.llm.repeats import remove_repeats

    found = remove_repeats(documents(spark, sf))
    lost = F.aggregate("removed", F.lit(0).cast("bigint"), lambda acc, x: acc + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", lost.alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


@query("op9_near_dedup")
def op9_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Components of near-duplicate documents."""
    from featmill.llm.neardup import near_components

    return near_components(documents(spark, sf))


@query("op6_personal_data")
def op6_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in each document."""
    from featmill.llm.pii import find_personal_data, personal_data_summary

    return personal_data_summary(find_personal_data(documents(spark, sf)))


# crc32 of a short ASCII text, byte by byte over a table of 256 entries that a rule gives.
CRC_TABLE = """crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""
CRC = """xor(list_reduce([4294967295] || list_transform(string_split({}, ''), lambda x: ascii(x)::BIGINT),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""

TRIE_SQL = f"""
WITH {CRC_TABLE},
turns AS (SELECT conv_id, turn, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
  octet_length(encode(coalesce(text, ''))) AS n FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(struct_pack(id := id, n := n) ORDER BY turn NULLS FIRST, id) AS turns FROM turns GROUP BY conv_id),
heads AS (SELECT conv_id, turns, ({CRC.format("conv_id::VARCHAR")} % 9)::INTEGER AS h FROM own, crc),
whole AS (SELECT o.conv_id, CASE WHEN b.turns IS NULL THEN o.turns[h + 1:] ELSE b.turns[1:h] || o.turns[h + 1:] END AS turns
  FROM heads o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
ways AS (SELECT conv_id, d, array_to_string(list_transform(turns[1:d], lambda x: x.id), '') AS node,
  coalesce(turns[d].n, 0) AS n, len(turns) = d AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM whole)),
nodes AS (SELECT node, d, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs,
  coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM ways GROUP BY node, d),
kids AS (SELECT left(node, 32 * (d - 1)::INTEGER) AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
known AS (SELECT *, coalesce(n_children, 0) AS children FROM nodes LEFT JOIN kids USING (node)),
below AS (SELECT left(node, 32 * a::INTEGER) AS node, count(*) FILTER (children = 0) AS n_leaves, sum((n_convs - 1) * n) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM known) GROUP BY ALL)
SELECT k.conv_id, k.d AS depth, up.conv_id AS parent_conv_id, k.n_convs, k.children AS n_children, n_leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, sha256(k.ids) AS ends_sha256
FROM known k JOIN below USING (node) LEFT JOIN known up ON k.d > 0 AND up.node = left(k.node, 32 * (k.d - 1)::INTEGER)
"""


@query("op11_prefix_trie", TRIE_SQL)
def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations."""
    from featmill.llm.prefixes import prefix_trie, rebuild

    nodes = prefix_trie(rebuild(spark.read.parquet(f"{sf}/conversations.parquet")))
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def _repair_sql() -> str:
    """Edits by recursion from the end: of each of four states the cheapest, ASCII-least rest and the text it leaves.

    States: 0 nothing yet, 1 after a system turn, 2 after a user's, 3 after the assistant's.
    """
    def row(cost: str, letter: str, to: int, line: str | None = None) -> str:
        left = f"v[{to + 1}].r" if line is None else f"[{line}] || v[{to + 1}].r"
        return f"{{'c': v[{to + 1}].c + {cost}, 'a': '{letter}' || v[{to + 1}].a, 'r': {left}}}"

    never = "{'c': 1000000000, 'a': '', 'r': []::VARCHAR[]}"
    after, kept = (2, 2, 3, 2), ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    names = {2: "user", 3: "assistant"}
    best = []
    for state in range(4):
        keep = " ".join(f"WHEN initial = '{i}' THEN {row('late', 'K', to, 'line')}" for i, to in kept[state].items())
        again = row("3 + late", "R", after[state], f"'{names[after[state]]}:' || text")
        best.append(
            f"list_sort([{row('4', 'D', state)}, CASE WHEN gone THEN {never} {keep} ELSE {never} END,"
            f" CASE WHEN gone THEN {never} ELSE {again} END])[1]"
        )

    def inserted(state: int, times: int) -> str:
        letters, lines = "I" * times, []
        for _ in range(times):
            state = after[state]
            lines.append(f"'{names[state]}:'")
        return f"{{'c': b[{state + 1}].c + {3 * times}, 'a': '{letters}' || b[{state + 1}].a, 'r': [{', '.join(lines)}]::VARCHAR[] || b[{state + 1}].r}}"

    ahead = [f"list_sort([{', '.join(inserted(state, n) for n in range(3))}])[1]" for state in range(4)]
    ends = ["{'c': 0, 'a': '', 'r': []::VARCHAR[]}", "{'c': 6, 'a': 'II', 'r': ['user:', 'assistant:']}",
            "{'c': 3, 'a': 'I', 'r': ['assistant:']}", "{'c': 0, 'a': '', 'r': []::VARCHAR[]}"]
    blank = r"'[^\x20\x09-\x0D]'"
    return f"""
WITH RECURSIVE {CRC_TABLE},
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hashed AS (SELECT *, md5(length(role)::VARCHAR || ':' || role || text) AS tie, {CRC.format("name")} % 20 AS fault FROM given, crc),
spoilt AS (SELECT conv_id, turn, tie, copy, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
  CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, (VALUES (0), (1)) c(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)),
placed AS (SELECT *, row_number() OVER w AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, tie, copy) > 1
  AS again, left(role, 1) AS initial, lag(left(role, 1)) OVER w AS before FROM spoilt
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tie, copy)),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, {blank}) THEN 'blank' WHEN again THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
sizes AS (SELECT conv_id, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
way AS (
  SELECT conv_id, n AS k, [{", ".join(ends)}] AS v FROM sizes
  UNION ALL
  SELECT conv_id, k, [{", ".join(ahead)}] FROM (SELECT conv_id, k, [{", ".join(best)}] AS b FROM (
    SELECT w.conv_id, w.k - 1 AS k, w.v, j.initial, j.text, j.role || ':' || j.text AS line, j.fault IN ('blank', 'duplicate') AS gone,
      CASE WHEN j.fault = 'truncated' THEN 3 ELSE 0 END AS late
    FROM way w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.k = w.k)))
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v[1].c, 0)::BIGINT AS cost,
  coalesce(v[1].a, '') AS audit, sha256(coalesce(array_to_string(v[1].r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN way w ON w.k = 0 AND w.conv_id IS NOT DISTINCT FROM g.conv_id
"""


@query("op13_repair_conversations", _repair_sql())
def op13_repair_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Faults and cheapest repair of each damaged conversation."""
    from featmill.llm.repair import damaged, repair_report

    return repair_report(damaged(spark.read.parquet(f"{sf}/conversations.parquet")))


@query("op12_secret_scan")
def op12_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets in each document."""
    import public_tokenizers

    from featmill.llm.secretscan import find_secrets, secrets_summary

    found = find_secrets(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])
    return secrets_summary(found, ["doc_id"])
