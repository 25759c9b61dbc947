"""Keeping a lookup up to date: new responses merged bucket by bucket.

A response store holds every provider's latest response for every key (hit or
miss, parsed, with what decides which response is the latest) in folders by a
hash of the key. New responses are parsed and reduced to the latest for each
key, and only the buckets that they fall into are read, merged by the same rule
and exchanged; the other folders' files stay as they are. Merging the same
responses again changes nothing, so a failed merge is simply repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .providers import META_DDL, Provider
from .resolve import priority_pick

STORE_DDL = (f"isbn STRING, provider STRING, rank INT, fetched STRUCT<at: TIMESTAMP, status: INT, body: BIGINT>, hit BOOLEAN, "
             f"meta STRUCT<{', '.join(f.replace(' ', ': ', 1) for f in META_DDL.split(', '))}>, bucket INT")


def latest_of(rows: DataFrame) -> DataFrame:
    """The latest response for each key and provider (all columns of the store)."""
    best = rows.groupBy("bucket", "isbn", "provider", "rank").agg(F.max_by(F.struct("fetched", "hit", "meta"), F.col("fetched")).alias("r"))
    return best.select("isbn", "provider", "rank", "r.fetched", "r.hit", "r.meta", "bucket")


def parsed_responses(providers: list[Provider], buckets: int) -> DataFrame:
    """The providers' snapshots parsed and reduced, with the bucket of each key."""
    rows = None
    for p in providers:
        own = p.parse(p.snapshot).select("isbn", F.lit(p.name).alias("provider"), F.lit(p.priority).alias("rank"), "fetched", "hit", "meta",
                                         F.pmod(F.xxhash64("isbn"), F.lit(buckets)).cast("int").alias("bucket"))
        rows = own if rows is None else rows.unionByName(own)
    return latest_of(rows)


def _write(rows: DataFrame, path: str, mode: str) -> None:
    (rows.repartition("bucket").sortWithinPartitions("bucket", "isbn").write.mode(mode)
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))


def save_responses(providers: list[Provider], path: str, buckets: int) -> None:
    """A new store from whole snapshots; ``buckets`` stays what it is for all merges."""
    _write(parsed_responses(providers, buckets), path, "errorifexists")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORE_DDL).parquet(path)


def merge_responses(spark: SparkSession, providers: list[Provider], path: str, buckets: int) -> list[int]:
    """Merge new responses (the providers' snapshots) into a store; the buckets that were rewritten."""
    fresh = scratch_path(spark, "responses", unique=True)
    parsed_responses(providers, buckets).write.parquet(fresh)
    new = spark.read.schema(STORE_DDL).parquet(fresh)
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())   # at most ``buckets`` numbers
    if touched:
        old = read_responses(spark, path).where(F.col("bucket").isin(touched))          # prunes the other folders
        # Dealt by bucket first, so the merge needs no further exchange.
        _write(latest_of(old.unionByName(new).repartition("bucket")), path, "overwrite")
    return touched


def lookup_from_responses(spark: SparkSession, path: str) -> DataFrame:
    """``(isbn, provider, meta)`` as ``lookup_table`` makes it from whole snapshots."""
    return priority_pick(read_responses(spark, path).where("hit").select("isbn", "rank", "provider", "meta"))
