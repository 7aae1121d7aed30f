"""Language ID by rank-order profiles.

A profile lists the most frequent letter n-grams (1 to 3 letters, words padded by a mark) in order. A document's own
profile is compared to each language's by the out-of-place distance: the sum, over the document's n-grams, of the
difference of the two ranks, or of the largest possible one where the language's profile lacks the n-gram.

Profiles are learned from counts over all learning documents: tasks count the n-grams of their documents with numpy
and hand on one row per language and n-gram; Spark adds them up and ranks them. Only the profiles, a few hundred rows
per language, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featmill.llm.common import fresh

# Rows of a profile; letters counted at a time; distinct n-grams a task holds before it hands them on;
# rows it hands back at a time.
PROFILE, CHUNK, HELD, ROWS = 300, 1 << 20, 1 << 19, 512
_MARK = 1
_BITS = 21


def _letter_table() -> np.ndarray:
    """True at the code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str, letters: np.ndarray) -> np.ndarray:
    """Lower-cased letters as code points, words separated, preceded and followed by one mark."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    points = np.where(letters[points], points, _MARK).astype(np.int64)
    points = np.concatenate(([_MARK], points, [_MARK]))
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != _MARK) | (points[:-1] != _MARK)
    return points[keep]


def _merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(codes, return_inverse=True)
    return found, np.bincount(place, counts).astype(np.int64)


def ngram_counts(text: str | None, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the whole text as sorted integers, and how often each occurs."""
    none = np.zeros(0, np.int64)
    s = _codes(text or "", letters)
    if len(s) < 3:
        return none, none
    codes, counts = none, none
    for start in range(0, len(s), CHUNK):
        part = s[start : start + CHUNK + 2]
        one = part[:CHUNK]
        two = (part[:-1] << _BITS | part[1:])[:CHUNK]
        three = (part[:-2] << 2 * _BITS | part[1:-1] << _BITS | part[2:])[part[1:-1] != _MARK]
        found, n = np.unique(np.concatenate((one[one != _MARK], two, three)), return_counts=True)
        codes, counts = (
            _merged(np.concatenate((codes, found)), np.concatenate((counts, n))) if len(codes) else (found, n)
        )
    return codes, counts


def _ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order; ties by code."""
    return codes[np.lexsort((codes, -counts))[:size]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, gram, n)`` of rows ``(lang, text)``; a language may come several times.

    Texts are taken one by one, and no more than about twice ``HELD`` n-grams are kept at a time.
    """
    letters, held = _letter_table(), {}

    def hand_on() -> Iterator[pa.RecordBatch]:
        for lang, [(codes, counts)] in held.items():
            names = pa.repeat(pa.scalar(lang, pa.string()), len(codes))
            yield pa.RecordBatch.from_arrays([names, pa.array(codes), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])
        held.clear()

    def merge() -> int:
        for lang, parts in held.items():
            held[lang] = [_merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
        return sum(len(codes) for [(codes, _)] in held.values())

    waiting = 0
    for batch in batches:
        for lang, text in zip(*batch.columns, strict=True):
            part = ngram_counts(text.as_py(), letters)
            held.setdefault(lang.as_py(), []).append(part)
            waiting += len(part[0]) + 1
            if waiting > HELD:
                waiting = 0
                if merge() > HELD:
                    yield from hand_on()
    merge()
    yield from hand_on()


def learn_profiles(docs: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """``{lang: n-grams by falling frequency}`` from ``docs(text, lang)``.

    Rows with a null language or text teach nothing; a language without letters in any text has no profile.
    """
    known = docs.select("lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = known.mapInArrow(_counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size)
    found = top.select("lang", "rank", "gram").toPandas().sort_values(["lang", "rank"])
    return {lang: group["gram"].to_numpy(np.int64) for lang, group in found.groupby("lang")}


def predict_language(
    docs: DataFrame,
    profiles: dict[str, np.ndarray],
    keep: list[str],
    size: int = PROFILE,
    names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """The columns ``keep`` with the predicted language and its score, under ``names``, for each row of ``docs(text)``.

    The score is 1 minus the distance to the nearest profile over the largest possible distance. A text that is null
    or has no letter, and any text where there are no profiles, is ``und`` with score 0. Equal distances go to the
    smaller name.
    """
    langs = sorted(profiles)
    [whole] = fresh([*keep, *names], "text")
    tables = []
    for name in langs:
        order = np.argsort(profiles[name], kind="stable")
        tables.append((profiles[name][order], order.astype(np.int64)))

    def nearest(text: str | None, letters: np.ndarray) -> tuple[str, float]:
        codes, counts = ngram_counts(text, letters)
        if not len(codes) or not langs:
            return "und", 0.0
        own = _ranked(codes, counts, size)
        ranks = np.arange(len(own))
        best = None
        for name, (grams, places) in zip(langs, tables, strict=True):
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            away = np.where(grams[at] == own, np.abs(places[at] - ranks), size).sum()
            if best is None or away < best[0]:
                best = (away, name)
        return best[1], float(1.0 - best[0] / (size * len(own)))

    # A text that is kept is sent once.
    there = keep.index("text") if "text" in keep else len(keep)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letter_table()
        for batch in batches:
            # Handed back a few at a time: texts may be among the columns.
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                found = [nearest(t.as_py(), letters) for t in part.column(there)]
                made = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=[*keep, *names])

    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    rows = kept if there < len(keep) else docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(whole))
    schema = T.StructType([*kept.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return rows.mapInArrow(predict, schema)


def held_out(doc_id: Column | str, parts: int, part: int) -> Column:
    """Whether crc32 of the id's text leaves ``part`` modulo ``parts``; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(True))
