"""Document fingerprints by one-permutation MinHash (DataFrame functions only).

A text's words are cut into shingles of five, each shingle is hashed once, and the hash's top bits choose one of 256
bins. A bin keeps its smallest hash. An empty bin takes the value of a filled one by optimal densification: it
probes bins drawn by a hash of its own number, the same for all documents, until one is filled. After eight probes the
rest of the sequence is a pseudo-random order of all bins, of which the first filled one is taken at once. The bin's
number is mixed into its value, so that bins filled from one source have bits of their own. Of each bin the low 4 bits
are packed, 16 bins to a long. Two unrelated bins agree with chance 1/16, so the share of equal bins is corrected by
that chance.

Finding each bin's smallest hash needs no lookup: the hashes and one largest value per bin are sorted together, and
the first element of each bin is its smallest hash or the mark that the bin is empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmill.functions.tensors import bind
from featmill.llm.common import blank_words, materialize, rows_once, shingle_hashes, text_of
from featmill.operators.ordinals import number_rows

SHINGLE, BIN_BITS, LOW_BITS, PROBES = 5, 8, 4, 8
BINS, PER_LONG = 1 << BIN_BITS, 64 // LOW_BITS
_SHIFT = 64 - BIN_BITS
_LOW = (1 << _SHIFT) - 1


def _bin(value: Column) -> Column:
    return F.shiftright(value, _SHIFT)


def _is_filled(value: Column) -> Column:
    return value.bitwiseAND(F.lit(_LOW)) != F.lit(_LOW)


def add_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``, the packed fingerprint ``array<bigint>`` of column ``text``; null for a text without words."""
    keep = [F.col(f"`{c}`") for c in df.columns]
    marks = F.transform(
        F.sequence(F.lit(-(BINS >> 1)).cast("bigint"), F.lit((BINS >> 1) - 1).cast("bigint")),
        lambda b: F.shiftleft(b, _SHIFT).bitwiseOR(F.lit(_LOW)),
    )
    # A lambda evaluates what it refers to once per element: that must be a column, or be bound.
    df = df.select(*keep, blank_words(text_of(text)).alias("_words"))
    df = df.select(*keep, F.sort_array(F.concat(shingle_hashes(F.col("_words"), SHINGLE), marks)).alias("_sorted"))
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice("_sorted", 1, F.size("_sorted") - 1))
    firsts = F.zip_with("_sorted", before, lambda a, b: F.when(b.isNull() | (_bin(a) != _bin(b)), a))
    df = df.select(*keep, F.array_compact(firsts).alias("_least"))

    def kept(value: Column) -> Column:
        return F.when(_is_filled(value), value)

    def densified(value: Column, i: Column, filled: Column) -> Column:
        probes = [
            kept(F.get(F.col("_least"), F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int"))) for t in range(PROBES)
        ]
        rest = F.transform(filled, lambda f: F.struct(F.xxhash64(i, _bin(f)).alias("rank"), f.alias("value")))
        return F.xxhash64(F.coalesce(kept(value), *probes, F.array_min(rest)["value"]), i)

    def pack(dense: Column) -> Column:
        low = F.lit((1 << LOW_BITS) - 1).cast("bigint")
        return F.transform(
            F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)),
            lambda j: F.aggregate(
                F.slice(dense, j * PER_LONG + 1, PER_LONG),
                F.lit(0).cast("bigint"),
                lambda acc, v: F.shiftleft(acc, LOW_BITS).bitwiseOR(v.bitwiseAND(low)),
            ),
        )

    dense = bind(
        F.filter("_least", _is_filled),
        lambda filled: F.transform(F.col("_least"), lambda v, i: densified(v, i, filled)),
    )
    return df.select(*keep, F.when(F.exists("_least", _is_filled), bind(dense, pack)).alias(out))


def fingerprint_text(packed: Column | str) -> Column:
    """Lowercase hex of a packed fingerprint; the empty string where there is none."""
    packed = F.col(packed) if isinstance(packed, str) else packed
    digits = F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0"))
    return F.coalesce(F.lower(F.array_join(digits, "")), F.lit(""))


def likeness(a: Column | str, b: Column | str) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1.

    The share of equal bins, corrected for bins equal by chance. Two texts without words have 1, a text without words
    and one with words 0.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    ones = F.lit(0x1111111111111111).cast("bigint")

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for step in (1, 2):
            d = d.bitwiseOR(F.shiftrightunsigned(d, step))
        return F.bit_count(d.bitwiseAND(ones))

    different = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, n: acc + n)
    chance = 1.0 / (1 << LOW_BITS)
    share = 1.0 - different / F.lit(float(BINS))
    same = F.greatest(F.lit(0.0), (share - chance) / (1.0 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def next_documents(docs: DataFrame, edit: Callable[[Column, Column], Column]) -> DataFrame:
    """Fingerprints of each text, of its edited form and of the next document's text.

    ``docs`` has ``doc_id`` and ``text`` (null: empty). The next document is the one with the next larger id; the last
    is followed by the first. Rows with equal ids follow each other in the order of a hash of their texts; a null id
    comes first. ``edit(text, next_text)`` gives the edited text. Returns ``doc_id, n_chars, text, edited, fp,
    edited_fp, next_fp``, one row for each of ``docs``; a single document is its own next.

    Only ids and hashes are put in order. Texts are shuffled once by key, and once more on their way to the document
    before.
    """
    # No key is null, so that the texts grouped by key and joined on it twice are dealt out once.
    key = ["_known", "_id", "_hash", "_chars"]
    texts = docs.select("doc_id", text_of("text").alias("text"))
    texts = texts.select(
        F.col("doc_id").isNotNull().alias("_known"), F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("_id"),
        F.xxhash64("text").alias("_hash"), F.length("text").alias("_chars"), "text",
    )
    placed = materialize(number_rows(texts.drop("text"), order=key, global_ordinal="_o", ties=True), "places")
    count = placed.count()
    before = placed.select(
        ((F.col("_o") + F.lit(count - 1)) % F.lit(max(count, 1))).alias("_o"), *[F.col(k).alias(f"_next{k}") for k in key]
    )
    links = materialize(placed.join(before, "_o"), "links")

    whole = rows_once(add_fingerprint(texts, "text", "_fp").select(*key, F.struct("text", "_fp").alias("_v")), key, "_v")
    right = whole.select(*[F.col(k).alias(f"_r{k}") for k in key], "_v")

    def joined(rows: DataFrame, prefix: str) -> DataFrame:
        match = reduce(Column.__and__, [F.col(f"{prefix}{k}") == F.col(f"_r{k}") for k in key])
        return rows.join(right, match).drop(*[f"_r{k}" for k in key])

    sent = joined(links, "_next").select(
        *key, "_o", F.left(F.col("_v.text"), F.expr("_chars div 2")).alias("_begin"), F.col("_v._fp").alias("next_fp")
    )
    both = joined(sent, "").select(
        F.when(F.col("_known"), F.col("_id")).alias("doc_id"), F.col("_chars").cast("bigint").alias("n_chars"),
        F.col("_v.text").alias("text"), edit(F.col("_v.text"), F.col("_begin")).alias("edited"),
        F.col("_v._fp").alias("fp"), "next_fp",
    )
    return add_fingerprint(both, "edited", "edited_fp")


def replace_end(text: Column, begin: Column) -> Column:
    """``text`` with its last floor(n/2) code points replaced by ``begin``."""
    n = F.length(text)
    return F.concat(F.left(text, n - F.floor(n / 2).cast("int")), begin)
