from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of ``(doc_id, text)`` or ``(doc_id, text, lang, source)`` rows."""

    def build(rows, extra: str | None = None):
        full = [(r[0], r[1], *(r[2:] or ("en", "src0")), len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            df = df.selectExpr("*", *[f"'x' AS `{c}`" for c in extra.split(",")])
        return df

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    words = [f"w{k}" for k in range(3000)]
    one = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    return [
        (1, one, "en", "a"),
        (1, one, "en", "a"),
        (2, one, "en", "b"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, " \t\n ", "de", "b"),
        (6, " ".join(words), "en", None),
        (7, "lone", "fr", "c"),
        (None, "no id here at all but words", "en", "a"),
        (8, "1234 !!! ???", "es", "c"),
    ]


# Names that the operators use for columns of their own.
CLASHING = "size,_row,_key,target,score,key,id,ids,rank,_words,_hash,start,kind,base,component,n"


@pytest.fixture(scope="session")
def clashing():
    return CLASHING
