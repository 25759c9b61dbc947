"""Lines of text files by file and block, numbered over all files in name order.

Spark reads a file in blocks (splits), packed into tasks by size, so neither
task nor row number says where a line stands. What does is the file's name, the
block's first byte and the line's place in its block. The lines are written
once with these three; numbering then takes the count of each block (one row a
block), a running sum over these few rows, and a join back by block. No line is
sorted or moved for it, and the written table keeps the numbers the same
whatever happens to executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

BLOCK = ["file", "block"]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written into the shared folder once and read back."""
    path = scratch_path(df.sparkSession, "blocks", name, unique=True)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def block_lines(spark: SparkSession, path: str, **derived: Column) -> DataFrame:
    """``(file, block, at, value)`` of every line, written once; ``at`` grows by one within a block.

    ``derived`` adds columns computed from ``value``.
    """
    # The number is taken right after the scan, so a block's lines are numbered without a gap.
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    return written(lines.select("*", *[c.alias(name) for name, c in derived.items()]), "lines")


def ahead(order: list[str], part: list[str] | None = None):
    """All rows before a row (of its ``part``), for sums over one row a block or file."""
    window = Window.partitionBy(*part) if part else Window.partitionBy()
    return window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def running_total(n: str, order: list[str], part: list[str] | None = None) -> Column:
    return F.coalesce(F.sum(n).over(ahead(order, part)), F.lit(0))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, value)``: ``line`` counts all lines of all files from 0, files in the order of their names."""
    lines = block_lines(spark, path)
    counts = lines.groupBy(*BLOCK).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    bases = written(counts.select(*BLOCK, (running_total("n", BLOCK) - F.col("first")).alias("base")), "bases")
    return lines.join(bases, BLOCK).select("file", (F.col("base") + F.col("at")).alias("line"), "value")
