"""From raw documents to token ids: five stages, each over all rows that the one before has kept.

1. ``language_id`` learns rank-order profiles from the documents' own ``lang`` and removes those without letters and
   those unlike every profile.
2. ``near_dedup`` keeps one document of each component of near copies (words shingled by five, similarity 0.8).
3. ``personal_data`` replaces personal data and secrets by the name of their kind.
4. ``mix`` repeats and leaves out documents so that sources reach their target weights within the budget.
5. ``tokens`` encodes the texts and decodes the ids again.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import featmill
from featmill.llm import bpe, language, mixing, neardup, pii
from featmill.llm.common import fresh, materialize
from featmill.llm.queries import word_vocabulary

cloudpickle.register_pickle_by_value(featmill)

# A document less like its nearest profile than this is rejected; the share that near copies have in common, in
# hundredths.
LEAST_LIKE, SIMILARITY = 0.1, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; a null or letterless text is in none.

    Where no document has both a language and letters, nothing can be learned, and every text with a letter stays. A text
    in letters that no profile has is unlike every profile and goes.
    """
    profiles = language.learn_profiles(docs)
    if not profiles:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    predicted, like = fresh(docs.columns, "lang_pred", "like")
    judged = language.predict_language(docs, profiles, docs.columns, names=(predicted, like))
    return judged.where((F.col(predicted) != "und") & (F.col(like) >= LEAST_LIKE)).drop(predicted, like)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: that of the smallest id."""
    return neardup.near_deduplicated(docs, SIMILARITY)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; ``n_chars`` follows the text."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document: ``doc_id, lang, source, n_tokens, ids, decoded``."""
    encoded = bpe.tokenize(docs, word_vocabulary(), ["doc_id", "lang", "source"])
    return encoded.withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mix", mix),
    ("tokens", tokens),
]

# SQL has no MinHash, no expectation-maximisation and no BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents`` in turn, each one's rows written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
