"""Classify identifier rows and split valid keys from rejects.

Each row is normalised once and checked once. The normalised value comes
out of a one-element ``explode``: a filter on it cannot be pushed below that
Generate, so the optimizer does not inline the normalisation into every
reference of the checksum predicate (which made the filter several times
more expensive than the check itself).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from .._util import with_once
from ..functions.isbn import classification, id_type, is_valid_id, normalize_id, reject_reason

_N = "_n"
_OK = "_ok"


def _normalized(ids: DataFrame, raw: str) -> DataFrame:
    return with_once(ids, normalize_id(raw), _N)


def classify(ids: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``v STRUCT<type, normalized, error>`` (map-side, no shuffle)."""
    checked = _normalized(ids, raw).withColumn(_OK, is_valid_id(_N))
    return checked.select(*ids.columns, classification(_N, _OK).alias("v"))


def valid_ids(ids: DataFrame, raw: str = "raw") -> DataFrame:
    """Rows whose identifier is valid; ``isbn`` is the normalised key.

    Every other input column is kept, so duplicates and positions survive.
    Accepts raw ids or a classified frame (then ``v`` is used as stored).
    """
    if "v" in ids.columns:
        keep = [c for c in ids.columns if c != "v"]
        return (ids.where(F.col("v.type") != fixed.TYPE_INVALID)
                .select(*keep, F.col("v.type").alias("id_type"), F.col("v.normalized").alias("isbn")))
    return (_normalized(ids, raw).where(is_valid_id(_N))
            .select(*ids.columns, id_type(_N, F.lit(True)).alias("id_type"), F.col(_N).alias("isbn")))


def rejected_ids(ids: DataFrame, raw: str = "raw") -> DataFrame:
    """The complementary side output, with the reason."""
    if "v" in ids.columns:
        keep = [c for c in ids.columns if c != "v"]
        return ids.where(F.col("v.type") == fixed.TYPE_INVALID).select(*keep, F.col("v.error").alias("reason"))
    return (_normalized(ids, raw).where(~is_valid_id(_N))
            .select(*ids.columns, reject_reason(_N).alias("reason")))


def input_counts(ids: DataFrame, raw: str = "raw") -> DataFrame:
    """A3: rows read and valid rows, one grand aggregate (partial per task)."""
    ok = (F.col("v.type") != fixed.TYPE_INVALID) if "v" in ids.columns else is_valid_id(_N)
    src = ids if "v" in ids.columns else _normalized(ids, raw)
    return src.agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(ok).alias("rows_valid"))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Opt-in guard that fails the job early on an empty input."""
    if df.isEmpty():
        raise ValueError(message)
    return df
