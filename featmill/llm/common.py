"""Words, row keys and scratch tables shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featmill.session import materialize, scratch_path  # noqa: F401  used by the operators

# White space of the word rule: space and U+0009 to U+000D (fixed values).
BLANK = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names`` with as many underscores before them as keep them apart from ``columns``, whatever their case."""
    taken, mark = {c.lower() for c in columns}, ""
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def text_of(text: Column | str) -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def blank_words(text: Column) -> Column:
    """Maximal runs of ``[^\\x20\\x09-\\x0D]``; an empty array for a text without words."""
    inner = F.trim(text, F.lit(BLANK))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK_RUN))


def shingle_hashes(words: Column, k: int) -> Column:
    """64-bit hash of each run of ``k`` words; of all words where there are fewer; none without words.

    ``words`` must be a column of its own, not an expression: the lambda refers to it once per element.
    """
    n = F.size(words)
    runs = F.transform(
        F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    )
    none = F.array().cast("array<bigint>")
    return F.when(n >= k, runs).when(n > 0, F.array(F.xxhash64(words))).otherwise(none)


def rows_once(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per key; rows with equal keys hold equal values, so any of them stands for all."""
    return df.groupBy(*keys).agg(F.first(value).alias(value))


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers of which ``repartition(n, number)`` deals one to each partition."""
    dealt = spark.range(64 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("part"))
    rows = dealt.groupBy("part").agg(F.min("id").alias("id")).collect()
    if len(rows) < n:
        raise RuntimeError(f"no key found for some of {n} partitions")
    return [r["id"] for r in sorted(rows, key=lambda r: r["part"])]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word, the same as Spark's ``xxhash64`` gives."""
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2^64, of every run of ``width`` numbers."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    # By an odd base, powers have inverses, and every run is a difference of two running sums.
    inverse = pow(base, -1, 1 << 64)
    falling = np.full(len(h), inverse, np.uint64)
    falling[0] = 1
    falling = np.cumprod(falling, dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * falling, dtype=np.uint64)))
    rising = np.full(len(h) - width + 1, base, np.uint64)
    rising[0] = 1
    return (sums[width:] - sums[:-width]) * np.cumprod(rising, dtype=np.uint64)
