"""Registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import audit, bpe, chat, decontam, langid, linededup, lm, neardedup, quality, sharding, spelling, tokenbin, toxicity
from shelfmark.llm.common import residue, scratch, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _held_out(n: int) -> Column:
    """Rows that nothing is learned from (a row without an id is not held out)."""
    return F.coalesce(residue(F.col("doc_id"), n) == 2, F.lit(False))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("rejected_by")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = _held_out(4)
    model = langid.train(docs, learn=~held_out)
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = _held_out(7)
    model = lm.build(docs.filter(~held_out), order=3, min_count=1)
    return lm.score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("tk")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows as the log that writing them leaves (deltas, edits, regenerations), folded and rendered."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("\\### Assistant: </turn> ok").alias("text"))
    return chat.digests(chat.format_log(chat.as_log(rows.unionByName(extra))))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = _held_out(4)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=~held_out)
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.read_digests(spark, tokenbin.written(table(spark, sf_dir, "documents"), WORD_BPE, end_id=1))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(table(spark, sf_dir, "documents")).drop("tk")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardedup.classes(table(spark, sf_dir, "documents"), size=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", neardedup.is_kept().alias("kept"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE)
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       bpe.ids_digest(F.col("ids")).alias("ids_sha256"),
                       F.sha2(F.coalesce("decoded", F.lit("")), 256).alias("decoded_sha256"))


SHARDS = 8


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written into shards, and their digests read back from there."""
    path = scratch(spark, "shards")
    schema = sharding.write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS, path)
    rows = sharding.with_shard(sharding.read_shards(spark, path, schema), SHARDS + 1, name="grown_shard")
    text = F.col("text")
    return rows.select("doc_id", sharding.text_size(text).alias("size"), sharding.text_crc(text).alias("text_crc32"),
                       F.lit(sharding.LAW).alias("law"), "shard", "slot", "grown_shard")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def typos(doc_id: str):
    """The contract's misspellings: a code point is gone from one in 97 (document, word) pairs."""
    start = zlib.crc32(f"{doc_id}:".encode())

    def word_of(run: str) -> str:
        h = zlib.crc32(run.encode(), start)
        at = h % len(run)
        return run if h % 97 else run[:at] + run[at + 1:]

    return word_of


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.groups(table(spark, sf_dir, "documents"), change=typos)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_toxicity": op6_toxicity,
    "op7_token_ids": op7_token_ids,
    "op8_line_dedup": op8_line_dedup,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_bpe": op10_bpe,
    "op11_sharding": op11_sharding,
    "op12_filter_audit": op12_filter_audit,
    "op13_spelling_variants": op13_spelling_variants,
}

#: DuckDB SQL of the queries that SQL can express over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality.SQL,
    "op5_chat_formatting": chat.SQL,
    "op11_sharding": sharding.sql(SHARDS),
    "op12_filter_audit": audit.SQL,
    "op13_spelling_variants": spelling.sql(),
}
