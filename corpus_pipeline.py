"""The corpus pipeline: documents to token ids, in five stages.

Every stage is a function of (spark, docs, sf_dir) that works on all documents
its predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe, decontam, langid, linededup, neardedup
from shelfmark.llm.common import stored, table

#: How far a document's best language has to stand out, from none being likelier (0) to certainty (1). Of the 10,000
#: documents of sf0.1 one in 700 stands out less, most of them lists of numbers and keys or one abbreviation.
LEAST_SHARE = 0.4
SHINGLE, PERCENT = 5, 80
#: Smaller caches than by default: the workers' memory is shared with the other stages.
CACHES = (50_000, 100_000)
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that stands out, go."""
    model = langid.train(docs)
    return langid.in_known_language(docs, model, langid.least_score(model, LEAST_SHARE))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of any length that repeat an earlier line go, and documents of which no line is left."""
    left = linededup.without_duplicates(docs, least=linededup.MIN_EXACT)
    return left.withColumn("n_chars", F.length("text").cast("bigint"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return neardedup.one_of_each(docs, SHINGLE, PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): the ids of what is left, and a digest of what they decode to."""
    coded = bpe.round_trip(docs, VOCABULARY, caches=CACHES)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("bpe", tokenize),
]

#: The stages learn models and walk indexes, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
