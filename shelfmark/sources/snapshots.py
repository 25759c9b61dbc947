"""Provider snapshot tables: stored raw responses per requested key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.providers import SNAPSHOT_DDL


def read_snapshot(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``(isbn, status_code, body, fetched_at)``; parquet prunes to these."""
    df = spark.read.format(fmt).load(path) if fmt == "parquet" else \
        spark.read.format(fmt).schema(SNAPSHOT_DDL).load(path)
    fetched = F.col("fetched_at") if "fetched_at" in df.columns else F.lit(None).cast("timestamp")
    return df.select("isbn", "status_code", "body", fetched.alias("fetched_at"))
