"""Identifier sources: line files (S1), literal values / columns (S3).

Line rules: Unicode trim, drop empty lines and lines starting with '#'
(after the trim), keep the inner text untouched. Lines split on '\\n' only;
a trailing '\\r' goes with the trim.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._util import col, with_once
from ..functions.isbn import trim_space
from .blocks import numbered_lines


def clean_id_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """P1 on a frame of text lines: adds ``raw`` (trimmed), drops blanks/comments."""
    keep = [c for c in lines.columns if c != value]
    trimmed = with_once(lines, trim_space(value), "raw").select(*keep, "raw")
    return trimmed.where((F.col("raw") != "") & ~F.col("raw").startswith("#"))


def read_id_lines(spark: SparkSession, path: str, in_order: bool = True) -> DataFrame:
    """``(file, pos, raw)``; ``pos`` is the line's number over all files in name order.

    The number counts blank and comment lines too, so it has gaps where these
    were. The lines are written once for it (``sources/blocks.py``). Without
    ``in_order`` nothing is written, and ``pos`` follows line order only
    within a file split: enough where rows are counted or merely checked.
    """
    if in_order:
        lines = numbered_lines(spark, path).withColumnRenamed("line", "pos")
    else:
        lines = (spark.read.option("lineSep", "\n").text(path)
                 .select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"), "value"))
    return clean_id_lines(lines)


def as_text(df: DataFrame, c: str):
    """Identifier text of column ``c``: strings as they are; integers in
    decimal; fractional numbers through DECIMAL(20,0) so 9.780134190440E12
    reads 9780134190440 (a lost leading zero cannot be recovered). A number
    that is out of that range, or none, keeps its own text and is rejected
    later as no identifier."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.StringType):
        return F.col(c)
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.coalesce(F.col(c).try_cast("decimal(20,0)").cast("string"), F.col(c).cast("string"))
    return F.col(c).cast("string")


def ids_from_column(df: DataFrame, c: str, pos=None) -> DataFrame:
    """S3: values used as they are (no trim, no comment filter); NULL dropped."""
    pos_col = col(pos) if pos is not None else F.monotonically_increasing_id()
    return df.select(pos_col.cast("bigint").alias("pos"), as_text(df, c).alias("raw")).where(F.col("raw").isNotNull())


def ids_from_values(spark: SparkSession, values: list[str]) -> DataFrame:
    """S3 for a literal argument list (small by nature: command-line values)."""
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "pos BIGINT, raw STRING")
