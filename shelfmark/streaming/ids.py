"""Streamed identifiers (S2, C3) with Structured Streaming.

Identifiers arrive as text files in a folder. Cleaning and classification
are the batch column expressions; resolution runs per micro-batch through
``foreachBatch`` with the batch operators themselves (on a lookup table
bucketed by key), so stream and batch give identical rows. A
micro-batch is first written classified to the shared folder: its rows get
their identity there, by which a hot key is split as in a batch job. The
lookup is read already partitioned, so a micro-batch shuffles its own few
keys and not the lookup. Each micro-batch writes to its own ``epoch=<id>``
folder with overwrite, so a replayed batch after a failure replaces its
output instead of duplicating it. The summaries work alike: an epoch leaves
its totals and its failed keys, and ``stream_summary`` merges what is there.

No state, no watermark: every row is independent of the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import fixed
from ..operators.resolve import MAX_SPLIT_KEYS, ROW, attach, key_counts, read_numbered, resolve_keys_with_lookup
from ..operators.validate import classify, rejected_ids, valid_ids
from ..session import remove_path, scratch_path
from ..sources.lines import clean_id_lines


def read_id_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None, block: str | None = None) -> DataFrame:
    """Streaming ``(file, raw)`` with the line-file rules (P1); ``block`` names a column for a hash of file and block."""
    reader = spark.readStream.option("lineSep", "\n")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    place = [F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias(block)] if block else []
    lines = reader.text(folder).select(F.col("_metadata.file_path").alias("file"), *place, "value")
    return clean_id_lines(lines)


def _trigger(writer, interval: str | None):
    """``interval`` None: process what is there and stop (availableNow);
    else a processing-time trigger such as '1 minute'."""
    return writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)


def clean_ids_to(spark: SparkSession, folder: str, out: str, checkpoint: str,
                 interval: str | None = None) -> StreamingQuery:
    """S2 job: cleaned ids appended to a parquet sink (exactly-once file sink)."""
    writer = (read_id_stream(spark, folder).writeStream.format("parquet")
              .option("path", out).option("checkpointLocation", checkpoint))
    return _trigger(writer, interval).start()


def resolved_stream(spark: SparkSession, folder: str, lookup: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """C3 as one streaming plan: classify, then a stream-static left join
    to the lookup table. Append-only and stateless; sink it with any file
    sink (exactly-once).

    ``hot`` (isbn, splits) names keys that come often, say from ``hot_keys``
    of what was read so far: their rows are spread over ``splits`` salts by
    the file block that they stand in, so no task gets a hot key's rows from
    more blocks than its share, and their one lookup row is copied for each.
    A small lookup is broadcast by Spark's size check, and then nothing is
    dealt by key at all.
    """
    valid = valid_ids(read_id_stream(spark, folder, block="_block"))
    found = lookup.select("isbn", "provider", "meta")
    if hot is None:
        joined = valid.drop("_block").join(found, "isbn", "left")
    else:
        splits = F.broadcast(hot.select("isbn", F.col("splits").alias("_splits")))   # at most MAX_SPLIT_KEYS rows
        many = F.coalesce(F.col("_splits"), F.lit(1))
        left = valid.join(splits, "isbn", "left").withColumn("_salt", F.pmod(F.col("_block"), many).cast("int")).drop("_splits", "_block")
        right = found.join(splits, "isbn", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), many.cast("int") - 1))).drop("_splits")
        joined = left.join(right, ["isbn", "_salt"], "left").drop("_salt")
    return joined.withColumn("error", F.when(F.col("provider").isNull(), F.lit(fixed.MSG_UNRESOLVED)))


def hot_keys(counts: DataFrame, rows_per_split: int) -> DataFrame:
    """(isbn, splits) of the keys with more rows than one join task should get, from ``key_counts``.

    The limit grows with the input as in ``attach``, so fewer than MAX_SPLIT_KEYS keys are above it.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(rows_per_split, -(-total // MAX_SPLIT_KEYS))
    return counts.where(F.col("n") > limit).select("isbn", F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("splits"))


def resolve_stream(spark: SparkSession, folder: str, lookup_table: str, out: str, rejects: str,
                   checkpoint: str, project=None, max_files_per_trigger: int | None = None,
                   interval: str | None = None, summary: str | None = None) -> StreamingQuery:
    """Streamed ids -> classify -> resolve per micro-batch -> parquet.

    ``lookup_table`` names a table written by ``save_lookup``. ``project``
    maps the result rows to the sink's columns (e.g. CSV rows). With
    ``summary``, each epoch leaves there what ``stream_summary`` adds up.
    """
    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        session = batch.sparkSession
        work = scratch_path(session, "stream", "batch", unique=True)
        read, seen = Observation(), Observation()
        (classify(batch).observe(read, F.count(F.lit(1)).alias("rows_read"), F.count_if(F.col("v.type") != fixed.TYPE_INVALID).alias("rows_valid"))
         .write.parquet(f"{work}/classified"))
        classified = read_numbered(session, f"{work}/classified")
        valid = valid_ids(classified)
        keys = resolve_keys_with_lookup(key_counts(valid), session.table(lookup_table))
        failed = F.col("error").isNotNull()
        keys.observe(seen, F.max("n").alias("most"), F.sum(F.when(failed, F.col("n"))).alias("failed")).write.parquet(f"{work}/keys")
        keys = session.read.schema(keys.schema).parquet(f"{work}/keys")
        n, bad = read.get, seen.get["failed"] or 0
        res = attach(valid, keys, total=n["rows_valid"], most=seen.get["most"] or 0)
        res = project(res) if project else res
        res.write.mode("overwrite").parquet(f"{out}/epoch={epoch_id}")
        rejected_ids(classified).drop(ROW).write.mode("overwrite").parquet(f"{rejects}/epoch={epoch_id}")
        if summary:
            keys.where(failed).select("isbn", "n", "error").write.mode("overwrite").parquet(f"{summary}/failed/epoch={epoch_id}")
            totals = session.createDataFrame([(n["rows_read"], n["rows_valid"], n["rows_valid"] - bad, bad)], TOTALS_DDL)
            totals.write.mode("overwrite").parquet(f"{summary}/totals/epoch={epoch_id}")
        remove_path(session, work)

    writer = (read_id_stream(spark, folder, max_files_per_trigger).writeStream
              .foreachBatch(write_batch).option("checkpointLocation", checkpoint))
    return _trigger(writer, interval).start()


TOTALS_DDL = "rows_read BIGINT, rows_valid BIGINT, successful BIGINT, failed BIGINT"
FAILED_DDL = "isbn STRING, n BIGINT, error STRING"


def stream_failed_keys(spark: SparkSession, summary: str) -> DataFrame:
    """A4 over all epochs so far: each key that some epoch could not resolve, once, with its rows."""
    failed = spark.read.schema(FAILED_DDL + ", epoch BIGINT").parquet(f"{summary}/failed")
    return failed.groupBy("isbn").agg(F.sum("n").alias("n"), F.max("error").alias("error"))


def stream_summary(spark: SparkSession, summary: str) -> DataFrame:
    """A1-A3 of a streamed run, one row, merged from what its epochs left: rows read and valid, rows resolved and
    failed, and the distinct failed keys with the successes that A2 counts beside them.

    A replayed epoch has replaced its own part, so nothing counts twice.
    """
    totals = spark.read.schema(TOTALS_DDL + ", epoch BIGINT").parquet(f"{summary}/totals")
    sums = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows_read", "rows_valid", "successful", "failed")])
    distinct = stream_failed_keys(spark, summary).agg(F.count(F.lit(1)).alias("failed_keys"))
    both = sums.crossJoin(distinct)   # one row each
    return both.select("rows_read", "rows_valid", F.col("rows_valid").alias("total"), "successful", "failed",
                       (F.col("rows_valid") - F.col("failed_keys")).alias("successful_keys"), "failed_keys")
