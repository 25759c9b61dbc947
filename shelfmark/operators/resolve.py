"""Resolve valid keys against the provider chain.

Plan shape:

1. ``key_counts``: distinct keys with their multiplicity ``n``; a hash
   aggregate with a map-side partial step, so a key holding a third of all
   rows is collapsed per task before the shuffle. ``counted`` writes them
   (a narrow table) and sees whether there is a hot key at all.
2. ``resolve_keys``: the distinct keys left-joined to each provider's latest
   hit. Both sides are hash-partitioned by ``isbn`` (aggregate outputs), so
   the chain of sort-merge joins adds no exchange; small snapshots become
   broadcasts through Spark's size-checked auto-broadcast.
3. ``attach``: every input row gets its key's result (duplicates keep one
   row each). This is the only shuffle of the full input. If there are hot
   keys, they are split over several salts so no task receives a whole hot
   group. The salt comes from the row's place in a written table, so rows
   with equal values spread too, and a repeated task gives every row the same
   salt again. Without hot keys the rows are not written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..session import scratch_path
from .keyfilter import key_filter
from .providers import Provider

# Rows of one key that one join task may receive before the key is split.
DEFAULT_ROWS_PER_SPLIT = 500_000
# The split set is broadcast (~30 bytes an entry): keys are split from so many
# rows on that no more than this many of them can exist.
MAX_SPLIT_KEYS = 100_000
# Identity of a row of a written table (hash of its file and row number).
ROW = "_row"


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """A written (Parquet) table with the identity ``ROW`` of every row."""
    df = spark.read.parquet(path)
    return df.select(*df.columns, F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(ROW))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` written into the shared folder once and read with ``ROW``.

    Whatever made them (a scan with its classification, say) is not run
    again by the key counts and the join back.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "rows", unique=True)
    rows.write.parquet(path)
    return read_numbered(spark, path)


def key_counts(valid: DataFrame) -> DataFrame:
    """Distinct keys and how many input rows carry each (partial aggregate)."""
    return valid.groupBy("isbn").agg(F.count(F.lit(1)).alias("n"))


def _ordered(providers: list[Provider]) -> list[Provider]:
    return sorted(providers, key=lambda p: p.priority)


def resolve_keys(keys: DataFrame, providers: list[Provider]) -> DataFrame:
    """J1-J4 on distinct keys: ``keys`` columns + provider, meta, error.

    The first provider (by priority) whose latest response is a hit wins as
    a whole record; no field-level merge. No hit: the constant error.
    """
    out = keys
    names, metas = [], []
    for i, p in enumerate(_ordered(providers)):
        hits = p.hits().select("isbn", F.col("meta").alias(f"_m{i}"))
        out = out.join(hits, "isbn", "left")
        names.append(F.when(F.col(f"_m{i}").isNotNull(), F.lit(p.name)))
        metas.append(F.col(f"_m{i}"))
    provider = F.coalesce(*names) if len(names) > 1 else names[0]
    meta = F.coalesce(*metas) if len(metas) > 1 else metas[0]
    return out.select(
        *keys.columns,
        provider.alias("provider"),
        meta.alias("meta"),
        F.when(provider.isNull(), F.lit(fixed.MSG_UNRESOLVED)).alias("error"),
    )


def resolve_keys_in_turn(keys: DataFrame, providers: list[Provider]) -> DataFrame:
    """``resolve_keys``, one provider after the other: each is asked only for the keys that those before it miss.

    What a provider answers is written (compact, one row a key). A Bloom
    filter of the keys still open is applied to the next provider's snapshot
    before its responses are parsed, the exact join behind it; so where the
    first provider answers nine keys of ten, the second parses about a tenth.
    Above MAX_KEYS open keys there is no filter, and all are parsed.
    """
    spark = keys.sparkSession
    left, parts, asked, n = keys, [], None, 0
    ordered = _ordered(providers)
    for i, p in enumerate(ordered):
        found = left.join(p.hits(asked, n).withColumnRenamed("meta", "_m"), "isbn", "left")
        found = found.select(*keys.columns, F.when(F.col("_m").isNotNull(), F.lit(p.name)).alias("provider"), F.col("_m").alias("meta"))
        if i + 1 < len(ordered):
            path, seen = scratch_path(spark, "turn", unique=True), Observation()
            found.observe(seen, F.count_if(F.col("provider").isNull()).alias("open")).write.parquet(path)
            found, n = spark.read.schema(found.schema).parquet(path), seen.get["open"] or 0
            left = found.where(F.col("provider").isNull()).select(*keys.columns)
            asked = key_filter(left, n)
            found = found.where(F.col("provider").isNotNull())
        parts.append(found)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("error", F.when(F.col("provider").isNull(), F.lit(fixed.MSG_UNRESOLVED)))


def fallback_keys(keys: DataFrame, providers: list[Provider]) -> DataFrame:
    """J2 input: keys the first provider does not answer (left anti join)."""
    first = _ordered(providers)[0]
    return keys.join(first.hits().select("isbn"), "isbn", "left_anti")


def resolved_ids(keys: DataFrame, providers: list[Provider]) -> DataFrame:
    """Keys with a hit in any provider, with the winning provider."""
    return resolve_keys(keys, providers).where(F.col("provider").isNotNull()).select("isbn", "provider")


def unresolved_ids(keys: DataFrame, providers: list[Provider]) -> DataFrame:
    """Distinct keys no provider answers, with the error."""
    return resolve_keys(keys, providers).where(F.col("error").isNotNull()).select("isbn", "error")


def counted(valid: DataFrame) -> tuple[DataFrame, int, int]:
    """``key_counts`` written once, the number of rows and the most that one key has (observed while writing)."""
    spark = valid.sparkSession
    path, seen = scratch_path(spark, "keys", unique=True), Observation()
    counts = key_counts(valid)
    counts.observe(seen, F.sum("n").alias("total"), F.max("n").alias("most")).write.parquet(path)
    found = seen.get
    return spark.read.schema(counts.schema).parquet(path), found["total"] or 0, found["most"] or 0


def attach(valid: DataFrame, resolved: DataFrame,
           rows_per_split: int = DEFAULT_ROWS_PER_SPLIT,
           counts: DataFrame | None = None, total: int | None = None, most: int | None = None) -> DataFrame:
    """Join each input row to its key's result, splitting hot keys.

    ``resolved`` carries ``n`` (rows per key). A key with more than ``limit``
    rows gets ``ceil(n / limit)`` salts: its input rows are spread over them
    by their ``ROW`` identity and its single result row is copied once per
    salt. ``limit`` is ``rows_per_split``, or ``N / MAX_SPLIT_KEYS`` when that
    is more, so fewer than MAX_SPLIT_KEYS keys can be above it: the split set
    needs no cap. Every other key has at most ``limit`` rows. If no key is
    above it, a plain join does. ``counts`` (``key_counts``), when given,
    feeds the split set directly instead of ``resolved``; ``total`` and
    ``most`` are the sum and the largest of its counts, if the caller has
    them. Rows without ``ROW`` are written once to get one if they need it.
    """
    counts = counts if counts is not None else resolved
    if total is None or most is None:
        seen = counts.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
        total, most = seen["total"] or 0, seen["most"] or 0
    limit = max(rows_per_split, -(-total // MAX_SPLIT_KEYS))
    if most <= limit:
        return valid.drop(ROW).join(resolved.drop("n"), "isbn", "left")
    if ROW not in valid.columns:
        valid = numbered(valid)
    splits = F.ceil(F.col("n") / F.lit(limit)).cast("int")
    hot = F.broadcast(counts.where(F.col("n") > limit).select("isbn", splits.alias("_splits")))
    left = (valid.join(hot, "isbn", "left")
            .withColumn("_salt", F.pmod(F.col(ROW), F.coalesce(F.col("_splits"), F.lit(1))).cast("int"))
            .drop("_splits", ROW))
    right = (resolved.join(hot, "isbn", "left")
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_splits"), F.lit(1)) - 1)))
             .drop("_splits", "n"))
    return left.join(right, ["isbn", "_salt"], "left").drop("_salt")


def resolve(valid: DataFrame, providers: list[Provider],
            rows_per_split: int = DEFAULT_ROWS_PER_SPLIT) -> DataFrame:
    """C1 core: one result row per valid input row.

    Output: the input columns + ``provider``, ``meta`` (STRUCT, NULL when
    unresolved) and ``error`` (NULL when resolved).
    """
    counts, total, most = counted(valid)
    return attach(valid, resolve_keys_in_turn(counts, providers), rows_per_split, counts, total, most)


def first_results(valid: DataFrame, rows: int, lookup: DataFrame) -> DataFrame:
    """The results of the first ``rows`` valid rows by ``pos``: a top-k before any join.

    At most ``rows`` keys are looked up, so they are what a join broadcasts.
    """
    top = valid.orderBy("pos").limit(rows)
    keys = F.broadcast(top.select("isbn").distinct())
    hits = lookup.select("isbn", "provider", "meta").join(keys, "isbn", "left_semi")
    return resolve_keys_with_lookup(top, hits)


def lookup_table(providers: list[Provider]) -> DataFrame:
    """Per-key winner over every snapshot key: ``(isbn, provider, meta)``.

    The priority pick of ``resolve_keys`` done once for all keys a snapshot
    holds, so it can be written once and reused by any number of batches or
    micro-batches without parsing a response again. Each provider's latest
    hits are unioned with their rank and reduced by a grouped ``min_by``
    (map-side partial aggregate).
    """
    hits = None
    for rank, p in enumerate(_ordered(providers)):
        h = p.hits().select("isbn", F.lit(rank).alias("rank"), F.lit(p.name).alias("provider"), "meta")
        hits = h if hits is None else hits.unionByName(h)
    return priority_pick(hits)


def priority_pick(hits: DataFrame) -> DataFrame:
    """``(isbn, provider, meta)``: of each key's hits the one with the smallest ``rank``."""
    best = hits.groupBy("isbn").agg(F.min_by(F.struct("provider", "meta"), F.col("rank")).alias("w"))
    return best.select("isbn", F.col("w.provider").alias("provider"), F.col("w.meta").alias("meta"))


def save_lookup(lookup: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Write the lookup as a table bucketed and sorted by ``isbn`` (below ``path``, if given).

    Joins against it then shuffle only the (small) key side: the lookup is
    read already partitioned by key, so a large lookup is not moved again
    by every batch that uses it.
    """
    writer = lookup.write.mode("overwrite").bucketBy(buckets, "isbn").sortBy("isbn").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return lookup.sparkSession.table(table)


def resolve_keys_with_lookup(keys: DataFrame, lookup: DataFrame) -> DataFrame:
    """``resolve_keys`` against a prepared lookup table (one left join)."""
    out = keys.join(lookup.select("isbn", "provider", "meta"), "isbn", "left")
    return out.withColumn("error", F.when(F.col("provider").isNull(), F.lit(fixed.MSG_UNRESOLVED)))


def resolve_with_lookup(valid: DataFrame, lookup: DataFrame,
                        rows_per_split: int = DEFAULT_ROWS_PER_SPLIT) -> DataFrame:
    """``resolve`` against a prepared lookup table; same output columns."""
    counts, total, most = counted(valid)
    return attach(valid, resolve_keys_with_lookup(counts, lookup), rows_per_split, counts, total, most)
