"""A training corpus from raw documents: good texts, one of each kind, without personal data, mixed, packed.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, the stage before's result
as written and read again. Empty tables pass through, null texts count as empty, and all but the
last stage return the columns they are given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeshare.llm import jaccard, mixing, packing, pseudonyms, quality
from placeshare.llm.common import stored, table
from placeshare.llm.queries import KEY, TOKENIZER


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on all labels, gives 0.5 or more."""
    score = "score"
    while score in docs.columns:
        score = f"_{score}"
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality.with_score(docs, model, score).where(F.col(score) >= 0.5).drop(score)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return jaccard.one_of_each(docs, size=5, threshold="0.8")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms; every document stays."""
    return pseudonyms.pseudonymised(docs, KEY)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by source."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens: one row per piece of a document."""
    return packing.packed(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", good_texts), ("near duplicates", one_of_each), ("personal data", without_personal_data),
    ("mixing", mixed), ("packing", packed),
]

#: fitted models, pseudonyms and random rounding have no SQL; the tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
