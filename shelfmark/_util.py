from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    """Accept a column name or a Column."""
    return c if isinstance(c, Column) else F.col(c)


def with_once(df, expr: Column, name: str):
    """Add ``expr`` as column ``name``, computed once per row.

    The value comes out of a one-element ``explode``: a later filter on it
    cannot be pushed below that Generate, so the optimizer does not inline
    ``expr`` into every reference of the predicate.
    """
    return df.select(*df.columns, F.explode(F.array(expr)).alias(name))
