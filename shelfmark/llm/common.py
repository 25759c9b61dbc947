"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import shared_dir

#: Words are maximal runs of anything but space and the controls \t \n \v \f \r.
WORD_SPLIT = r"[\x20\x09-\x0D]+"
WORD_RE = re.compile(r"[^\x20\x09-\x0D]+")
ROWS_PER_FILE = 50_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the columns an operator needs, under the operator's own names.

    Whatever else the table holds (also columns named like the operator's
    results) is left behind here, so nothing can clash later.
    """
    return df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in names.items()])


def words(text: Column) -> Column:
    """Array of the words of a text; null text gives an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_SPLIT)
    return F.array_remove(parts, "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def residue(key: Column, n: int) -> Column:
    """crc32 of the key's decimal text modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), "shelfmark-llm", f"{name}-{uuid.uuid4().hex[:12]}")


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here.

    ``rows`` is a bound of a small table's rows: it gets one file for every
    ROWS_PER_FILE of them instead of one for each shuffle partition.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    if rows is not None:
        df = df.coalesce(max(6, -(-rows // ROWS_PER_FILE)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_split(rows: DataFrame, groups: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` left-joined with ``groups`` (one row a key, ``n`` rows of it in ``rows``), hot keys split.

    ``rows`` has to be a stored table: a row's place there says which part of
    its key's rows it belongs to, so rows equal in every column spread too and
    a repeated task splits alike. A key is hot above twice the rows that a task
    would get evenly; fewer keys than half the tasks can be, so they are
    broadcast. Key columns must not be null; ``n`` is not among the results.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = max(1000, -(-2 * rows.count() // tasks))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    hot = F.broadcast(groups.filter(F.col(n) > limit).select(*keys, F.ceil(F.col(n) / F.lit(limit)).cast("int").alias("_parts")))
    place = F.xxhash64("_metadata.file_name", "_metadata.row_index")
    left = rows.withColumn("_place", place).join(hot, keys, "left").withColumn("_part", F.pmod("_place", parts).cast("int")).drop("_place", "_parts")
    right = groups.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts", n)
    return left.join(right, [*keys, "_part"], "left").drop("_part")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows, so that few texts are Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def worker_state(owner: str) -> dict:
    """A dict that lives as long as this Python worker (parsed models, caches).

    A worker keeps the state of one operator: it goes when another asks.
    """
    state = vars(sys).setdefault("_shelfmark_llm_state", {})
    if state.get("owner") != owner:
        state.clear()
        pa.default_memory_pool().release_unused()
        state["owner"] = owner
    return state


def shipped(spark: SparkSession, model: object) -> Broadcast[bytes]:
    """A broadcast of ``model`` with its class by value, so that workers need no copy of this package to read it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def received(shared: Broadcast[bytes]):
    """The model of a ``shipped`` broadcast; a worker makes it once and keeps the last one."""
    state, data = vars(sys).setdefault("_shelfmark_llm_received", {}), shared.value
    if state.get("data") is not data:
        state["data"], state["model"] = data, cloudpickle.loads(data)
    return state["model"]
