"""Personal data by weak supervision (DataFrame functions only).

Candidates are found by patterns, in one pass over the texts. Candidates of the four base kinds that pass their checks
are spans. All other candidates, and the base ones with them, are voted on by labelers: a regex labeler looks at the
form, a checksum labeler at the digits, a gazetteer labeler at known prefixes and at words that name something else, a
context labeler at the words before. A labeler says yes, no or nothing.

Expectation-maximisation estimates how reliable each labeler is from how often every combination of votes occurs, and
gives each combination its probability of being personal data. With these as soft labels a logistic regression on the
candidate's form and votes is trained; it is the final span classifier, and finds further spans of the kinds
``secret``, ``national`` (phone numbers without country) and ``ssn`` beside the base ones. Spark counts the combinations;
the driver gets one row for each that can occur, a number fixed by the labelers and features.

Possessive patterns keep Java's matcher from recursing and from trying a long run again at each of its characters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featmill.llm.common import materialize, text_of

# Kinds in the order of their spans; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "secret", "national", "ssn")
BASE = 4
_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
# What a candidate looks like; a match may start only where a run starts or where the last match has ended.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,}+",
    "national": r"(?<![0-9+.(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# Gazetteers: prefixes of keys; words before a candidate that announce personal data or something else.
KEY_PREFIX = r"^(?:AKIA|ASIA|AGPA|AIDA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abpr]-|sk-|pk_|rk_|AIza|ya29)"
ANNOUNCED = {
    "secret": r"(?i)(?:password|passwd|pwd|passphrase|secret|token|api[_ -]?key|access[_ -]?key|auth|bearer|credential)\W{0,4}$",
    "national": r"(?i)(?:phone|tel|telephone|mobile|cell|call|fax)\W{0,4}$",
    "ssn": r"(?i)(?:ssn|social security(?: number| no)?)\W{0,4}$",
}
OTHERWISE = r"(?i)(?:isbn|issn|doi|sha1|sha256|md5|commit|revision|version|checksum|uuid|build|order|invoice|page|part)\W{0,4}$"
CONTEXT, ACCEPT = 32, 0.5
LABELERS = ("regex", "checksum", "gazetteer", "context")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    one = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    twice = F.transform(one, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(twice, F.lit(0), lambda a, d: a + d) % 10 == 0


def base_check(kind: Column, match: Column) -> Column:
    """Whether a match of a base kind counts; false for other kinds."""
    digits = _digits(match)
    n = F.length(digits)
    parts = F.forall(
        F.split(match, r"\."),
        lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(9)).try_cast("int"), F.lit(0)) <= 255),
    )
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", parts)
        .when(kind == "card", n.between(14, 19) & luhn(F.left(digits, F.lit(19))))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(False)
    )


def candidates(docs: DataFrame) -> DataFrame:
    """``(doc_id, _hash, rows, kind, place, start, end, match, before)``: every match of every pattern.

    ``start`` and ``end`` count code points, end exclusive; ``place`` is the kind's place in ``KINDS``; ``before`` ends
    where the match begins. Each document has one row with a null kind as well. Rows with equal ids and texts have been
    merged; ``rows`` says how many there were.
    """
    texts = docs.select("doc_id", text_of("text").alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("_hash"), "text", F.contains("text", F.lit("@")).alias("_at"), F.col("text").rlike("[0-9]").alias("_digit"))
    none = F.array().cast("array<struct<place:int,seq:int,gap:int,before:string,match:string>>")

    def found(place: int, kind: str) -> Column:
        pattern = PATTERNS[kind]
        zipped = F.arrays_zip(
            F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("match")
        )
        rows = F.transform(
            zipped,
            lambda z, i: F.struct(
                F.lit(place).alias("place"), i.alias("seq"), F.length(z["gap"]).alias("gap"),
                F.right(z["gap"], F.lit(CONTEXT)).alias("before"), z["match"].alias("match"),
            ),
        )
        return F.when(F.col("_at" if kind == "email" else "_digit"), F.filter(rows, lambda r: r["match"].isNotNull())).otherwise(none)

    every = F.concat(
        F.array(F.lit(None).cast("struct<place:int,seq:int,gap:int,before:string,match:string>")),
        *[found(place, kind) for place, kind in enumerate(KINDS)],
    )
    rows = texts.select("doc_id", "_hash", F.explode(every).alias("_c")).select("doc_id", "_hash", "_c.*")
    merged = rows.repartition("doc_id", "_hash").groupBy("doc_id", "_hash", "place", "seq").agg(
        F.count("*").alias("rows"), F.first("gap").alias("gap"), F.first("before").alias("before"), F.first("match").alias("match")
    )
    along = Window.partitionBy("doc_id", "_hash", "place").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ended = F.sum(F.col("gap").cast("bigint") + F.length("match")).over(along)
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return merged.select(
        "doc_id", "_hash", "rows", F.get(kinds, F.col("place")).alias("kind"), "place",
        (ended - F.length("match")).alias("start"), ended.alias("end"), "match", "before",
    )


def votes(found: DataFrame) -> DataFrame:
    """Add ``base`` and a vote of each labeler, 1, 0 or -1, and the classifier's features to candidates."""
    kind, match, before = F.col("kind"), F.col("match"), F.col("before")
    digits, n = _digits(match), F.length(match)
    yes, no, nothing = F.lit(1), F.lit(-1), F.lit(0)
    share = F.length(digits) / n
    has_letters = match.rlike("[A-Za-z]")
    hexadecimal = match.rlike("^[0-9a-f]{16,}$") | match.rlike("^[0-9A-F]{16,}$")
    regex = (
        F.when(kind.isin(*KINDS[:BASE]), F.when(F.col("base"), yes).otherwise(no))
        .when(kind == "secret", F.when((hexadecimal | match.rlike(r"^[A-Z0-9]{20}$")) & has_letters, yes).when(share < 0.1, no).otherwise(nothing))
        .when(kind == "national", F.when(digits.rlike("^[2-9][0-9]{2}[2-9]"), yes).otherwise(no))
        .otherwise(F.when(digits.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)"), yes).otherwise(no))
    )
    checksum = (
        F.when(kind == "card", F.when(F.col("base"), yes).otherwise(no))
        .when(kind == "ip", F.when(F.col("base"), yes).otherwise(no))
        .when(kind == "secret", F.when(F.size(F.array_distinct(F.split(match, ""))) >= 10, yes).otherwise(no))
        .otherwise(nothing)
    )
    other = before.rlike(OTHERWISE)
    gazetteer = F.when((kind == "secret") & match.rlike(KEY_PREFIX), yes).when(other, no).otherwise(nothing)
    said = F.lit(False)
    for name, pattern in ANNOUNCED.items():
        said = said | ((kind == name) & before.rlike(pattern))
    context = F.when(said, yes).when(other, no).otherwise(nothing)
    found = found.withColumns({"regex": regex, "checksum": checksum, "gazetteer": gazetteer, "context": context})
    return found.withColumns(
        {
            "size": F.when(n < 12, 0).when(n < 18, 1).when(n < 24, 2).when(n < 48, 3).otherwise(4),
            "share": F.floor(share * 4).cast("int"),
            "upper": match.rlike("[A-Z]").cast("int"),
        }
    )


@dataclass(frozen=True)
class SpanClassifier:
    """Weights of a logistic regression on ``place``, votes and form; ``reliability`` of each labeler."""

    weights: dict[str, float]
    reliability: dict[str, float]

    def probability(self) -> Column:
        total = F.lit(self.weights.get("bias", 0.0))
        names = sorted({key.split("=")[0] for key in self.weights if "=" in key})
        for name in names:
            case = None
            for key, w in sorted(self.weights.items()):
                if key.split("=")[0] == name:
                    hit = F.col(name) == int(key.split("=")[1])
                    case = F.when(hit, w) if case is None else case.when(hit, w)
            total = total + case.otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


FEATURES = ("place", *LABELERS, "size", "share", "upper")
_PRIOR, _START, _ROUNDS, _STEPS, _RIDGE = 0.5, 0.85, 30, 400, 1e-3


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each combination of votes, and each labeler's chance of being right where it votes.

    A hundred pseudo-counts keep labelers that hardly vote near their start.
    """
    right = np.full(patterns.shape[1], _START)
    prior, posterior = _PRIOR, np.full(len(patterns), _PRIOR)
    for _ in range(_ROUNDS):
        log_odds = np.log(prior / (1 - prior)) + (patterns * np.log(right / (1 - right))).sum(axis=1)
        posterior = 1.0 / (1.0 + np.exp(-np.clip(log_odds, -30, 30)))
        agree = ((patterns == 1) * posterior[:, None] + (patterns == -1) * (1 - posterior[:, None])) * counts[:, None]
        voted = (patterns != 0) * counts[:, None]
        right = np.clip((agree.sum(axis=0) + 100 * _START) / (voted.sum(axis=0) + 100), 0.55, 0.99)
        prior = float(np.clip((posterior * counts).sum() / max(1, counts.sum()), 0.05, 0.95))
    return posterior, right


def train(voted: DataFrame) -> SpanClassifier:
    """The classifier for candidates with votes; without any it accepts none."""
    rows = voted.where(F.col("kind").isNotNull()).groupBy(*FEATURES).agg(F.sum("rows").alias("n")).collect()
    rows = sorted(rows, key=lambda r: tuple(r[f] for f in FEATURES))
    if not rows:
        return SpanClassifier({"bias": -10.0}, {})
    counts = np.array([r["n"] for r in rows], float)
    patterns = np.array([[r[f] for f in LABELERS] for r in rows])
    posterior, right = expectation_maximisation(patterns, counts)
    columns = sorted({f"{f}={r[f]}" for r in rows for f in FEATURES})
    place = {c: k for k, c in enumerate(columns)}
    x = np.zeros((len(rows), len(columns) + 1))
    x[:, -1] = 1.0
    for k, r in enumerate(rows):
        for f in FEATURES:
            x[k, place[f"{f}={r[f]}"]] = 1.0
    w, share = np.zeros(x.shape[1]), np.log1p(counts) / np.log1p(counts).sum()
    for _ in range(_STEPS):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - posterior)) + _RIDGE * w
        curve = (x * (share * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + _RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if math.sqrt(float(step @ step)) < 1e-9:
            break
    # Rounded, so that sums in another order give the same decisions.
    weights = {c: round(float(w[k]), 6) for c, k in place.items()} | {"bias": round(float(w[-1]), 6)}
    return SpanClassifier(weights, dict(zip(LABELERS, map(float, right), strict=True)))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``(doc_id, _hash, rows, spans)``: one row for each distinct (id, text) of ``docs``, which occurs ``rows`` times.

    ``spans`` is an array of ``(start, place, end, base)`` in order, ``place`` being the kind's place in ``KINDS``. Base
    spans are those of the patterns and checks; further spans never overlap base ones. A null text is an empty one.
    Other columns than ``doc_id`` and ``text`` are not read.
    """
    found = candidates(docs)
    voted = materialize(votes(found.withColumn("base", base_check(F.col("kind"), F.col("match")))), "candidates")
    judged = voted.withColumn("_p", train(voted).probability())
    # Of what overlaps a base span only that is kept; of further candidates that overlap each other, the earlier one.
    ahead = Window.partitionBy("doc_id", "_hash").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("doc_id", "_hash").orderBy("start", "place").rowsBetween(1, Window.unboundedFollowing)
    more = (~F.col("base")) & (F.col("place") >= BASE) & (F.col("_p") >= ACCEPT)
    kept = judged.withColumn("_keep", F.col("base") | more)
    kept = kept.withColumns(
        {
            "_ended": F.max(F.when(F.col("_keep") & (F.col("base") | (F.col("place") >= BASE)), F.col("end"))).over(ahead),
            "_begins": F.min(F.when(F.col("base"), F.col("start"))).over(after),
        }
    )
    free = (F.coalesce(F.col("_ended"), F.lit(-1)) <= F.col("start")) & F.coalesce(F.col("_begins") >= F.col("end"), F.lit(True))
    span = F.when(F.col("base") | (F.col("_keep") & free), F.struct("start", "place", "end", "base"))
    return kept.groupBy("doc_id", "_hash").agg(
        F.max(F.when(F.col("kind").isNull(), F.col("rows"))).alias("rows"), F.sort_array(F.collect_list(span)).alias("spans")
    )


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, by start and then kind."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(kinds, s["place"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def personal_data_summary(found: DataFrame) -> DataFrame:
    """Counts and digests, as many rows for each text as there were."""
    base = F.filter("spans", lambda s: s["base"])

    def number(place: int) -> Column:
        own = F.filter("spans", lambda s: s["base"] & (s["place"] == place))
        return F.size(own).cast("bigint").alias(f"n_{KINDS[place]}")

    counts = [number(place) for place in range(BASE)]
    out = found.select(
        "doc_id", *counts, F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("_copy"),
    )
    return out.drop("_copy")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in brackets; all columns stay, n_chars follows the text.

    Overlapping spans are replaced together, under the first one's kind. Rows keep their number.
    """
    found = find_personal_data(docs).where(F.size("spans") > 0).select(
        F.col("doc_id").alias("_id"), "_hash", F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["place"])).alias("_spans")
    )
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    match = F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text_of(F.col("_doc.text"))) == F.col("_hash"))
    met = whole.join(found, match, "left").select("_doc", "_spans", F.col("_doc.text").alias("text"))
    before = F.concat(
        F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end"), F.lit(0).alias("place"))),
        F.slice("_spans", 1, F.size("_spans") - 1),
    )
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def piece(s: Column, b: Column) -> Column:
        # The text between two spans and the label of the second; overlapping ones have no text between and no label.
        between = F.substring("text", (b["end"] + 1).cast("int"), (s["start"] - b["end"]).cast("int"))
        label = F.get(kinds, s["place"])
        return F.when(s["start"] >= b["end"], F.concat(between, label)).otherwise("")

    met = met.withColumn("_spans", _running_ends("_spans"))
    pieces = F.zip_with("_spans", before, piece)
    rest = F.substring("text", (F.element_at("_spans", -1)["end"] + 1).cast("int"), F.length("text"))
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), rest))
    new = met.select("_doc", "_spans", text.alias("_new"))
    length = F.when(F.col("_spans").isNull(), F.col("_doc.n_chars")).otherwise(F.length("_new")) if "n_chars" in docs.columns else None
    changed = {"text": F.col("_new"), "n_chars": length}
    return new.select(
        *[
            (changed[f.name].cast(f.dataType) if f.name in changed else F.col(f"_doc.`{f.name}`")).alias(f.name)
            for f in docs.schema
        ]
    )


def _running_ends(spans: str) -> Column:
    """Spans, each ending no earlier than those before it."""
    return F.transform(
        spans,
        lambda s, i: F.struct(
            s["start"].alias("start"), F.array_max(F.transform(F.slice(spans, F.lit(1), i + 1), lambda x: x["end"])).alias("end"),
            s["place"].alias("place"),
        ),
    )
