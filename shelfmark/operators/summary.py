"""Result summaries (A1, A2), computed on the key-level table.

Both read ``(isbn, n, error)`` with one row per distinct key, so the input
rows are never re-scanned or re-shuffled for a summary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary_rows(resolved_keys: DataFrame) -> DataFrame:
    """A1: total rows, rows resolved and rows failed (duplicates count)."""
    failed = F.col("error").isNotNull()
    return resolved_keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(~failed, F.col("n"))), F.lit(0)).alias("successful"),
        F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("failed"),
    )


def summary_distinct(resolved_keys: DataFrame) -> DataFrame:
    """A2: failed = distinct failed keys, successful = total rows - failed."""
    failed = F.count_if(F.col("error").isNotNull())
    total = F.coalesce(F.sum("n"), F.lit(0))
    return resolved_keys.agg(total.alias("total"), (total - failed).alias("successful"), failed.alias("failed"))
