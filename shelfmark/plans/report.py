"""Output projections and writers: text report, JSON Lines, CSV (K1-K3).

Each projection is a plain ``select`` over the result table
``(pos, isbn, meta, error, ...)``; the writers add the ordering (a range-
partitioned global sort on ``pos``, so part files concatenate in order)
and the file options.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.fields import isbn13_or_key, join_list, pages_text

_M = "meta"


def _m(name: str, default) -> Column:
    return F.coalesce(F.col(f"{_M}.{name}"), F.lit(default))


def _ok() -> Column:
    return F.col("error").isNull()


def csv_rows(results: DataFrame, keep=("pos",)) -> DataFrame:
    """K3: the 10 CSV columns (lists joined by '; ', blank pages when <= 0)."""
    h = fixed.CSV_HEADER
    return results.select(
        *[c for c in keep if c in results.columns],
        F.col("isbn").alias(h[0]),
        isbn13_or_key(_m("isbn_13", ""), F.col("isbn")).alias(h[1]),
        _m("title", "").alias(h[2]),
        join_list(F.col(f"{_M}.authors"), fixed.CSV_LIST_SEP).alias(h[3]),
        _m("publisher", "").alias(h[4]),
        _m("publication_date", "").alias(h[5]),
        pages_text(_m("pages", 0)).alias(h[6]),
        join_list(F.col(f"{_M}.categories"), fixed.CSV_LIST_SEP).alias(h[7]),
        F.when(_ok(), F.lit(fixed.STATUS_SUCCESS)).otherwise(F.lit(fixed.STATUS_ERROR)).alias(h[8]),
        F.coalesce(F.col("error"), F.lit("")).alias(h[9]),
    )


def text_blocks(results: DataFrame, keep=("pos",)) -> DataFrame:
    """K1: one text record per row, byte-exact including the separator."""
    lab = fixed.TEXT_LABELS

    def line(label: str, value: Column, present: Column) -> Column:
        return F.when(present, F.concat(F.lit(label), value))

    authors = F.col(f"{_M}.authors")
    cats = F.col(f"{_M}.categories")
    pages = _m("pages", 0)
    ok_block = F.concat_ws(
        "\n",
        F.concat(F.lit(lab[0]), F.col("isbn")),
        line(lab[1], _m("isbn_13", ""), _m("isbn_13", "") != ""),
        line(lab[2], _m("title", ""), _m("title", "") != ""),
        line(lab[3], F.array_join(authors, fixed.TEXT_LIST_SEP), F.size(authors) > 0),
        line(lab[4], _m("publisher", ""), _m("publisher", "") != ""),
        line(lab[5], _m("publication_date", ""), _m("publication_date", "") != ""),
        line(lab[6], pages.cast("string"), pages > 0),
        line(lab[7], F.array_join(cats, fixed.TEXT_LIST_SEP), F.size(cats) > 0),
        F.lit(fixed.TEXT_OK),
    )
    failed_block = F.concat(F.lit(lab[0]), F.col("isbn"), F.lit("\n" + fixed.TEXT_FAILED), F.col("error"))
    block = F.concat(F.when(_ok(), ok_block).otherwise(failed_block), F.lit(fixed.TEXT_RECORD_END))
    return results.select(*[c for c in keep if c in results.columns], F.col("isbn"), block.alias("text"))


def _data_struct() -> Column:
    return F.struct(
        F.col("isbn").alias("isbn"),
        F.nullif(_m("isbn_10", ""), F.lit("")).alias("isbn_10"),  # omitempty
        F.nullif(_m("isbn_13", ""), F.lit("")).alias("isbn_13"),  # omitempty
        _m("title", "").alias("title"),
        F.col(f"{_M}.authors").alias("authors"),
        _m("publisher", "").alias("publisher"),
        _m("publication_date", "").alias("publication_date"),
        _m("pages", 0).alias("pages"),
        F.col(f"{_M}.categories").alias("categories"),
    )


def json_entries(results: DataFrame, keep=("pos",)) -> DataFrame:
    """K2: ``{isbn, status, data?, error?}`` per row (data only on success)."""
    return results.select(
        *[c for c in keep if c in results.columns],
        F.col("isbn"),
        F.when(_ok(), F.lit(fixed.STATUS_SUCCESS)).otherwise(F.lit(fixed.STATUS_ERROR)).alias("status"),
        F.when(_ok(), _data_struct()).alias("data"),
        F.col("error"),
    )


def json_lines(entries: DataFrame, keep=("pos",)) -> DataFrame:
    """The JSON Lines text of each entry.

    An unknown list is written as ``null``; empty identifiers, and ``data`` or
    ``error`` where there is none, are left out. Quotes inside values are
    escaped, so the members taken out here can't be part of a value.
    """
    body = F.regexp_replace(F.to_json(F.struct("isbn", "status", "data", "error"), {"ignoreNullFields": "false"}),
                            r'"isbn_1[03]":null,|,"(?:data|error)":null', "")
    return entries.select(*[c for c in keep if c in entries.columns], F.col("isbn"), F.col("status"),
                          body.alias("line"))


def in_order(df: DataFrame, order: str = "pos") -> DataFrame:
    """Global sort on ``order`` for ordered sinks (range-partitioned).

    A hash of the row breaks ties, so a position value shared by a large
    group of different rows is spread over several range partitions; the
    hash is deterministic, so a retried task sends every row to the same
    place. MAP columns, which have no hash, stay out of it.
    """
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return df.orderBy(F.col(order), F.xxhash64(*[F.col(f"`{c}`") for c in hashed]))


def _ordered(df: DataFrame, order: str | None) -> DataFrame:
    if order and order in df.columns:
        return in_order(df, order).drop(order)
    return df


def write_csv(rows: DataFrame, path: str, order: str | None = "pos", mode: str = "overwrite") -> None:
    """CSV with the tool's quoting: RFC 4180 doubling, empty stays empty."""
    (_ordered(rows, order).write.mode(mode)
     .option("header", True).option("escape", '"').option("quote", '"')
     .option("emptyValue", "").option("nullValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def read_csv_rows(spark, path: str) -> DataFrame:
    """Read back a CSV written by ``write_csv`` (all columns STRING, empty stays empty)."""
    return (spark.read.option("header", True).option("escape", '"').option("multiLine", True)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .option("emptyValue", "").csv(path).na.fill(""))


def write_text(blocks: DataFrame, path: str, order: str | None = "pos", mode: str = "overwrite") -> None:
    """Concatenated text records; the writer's own newline ends each record."""
    out = _ordered(blocks.select(*[c for c in ("pos",) if c in blocks.columns],
                                 F.expr("substring(text, 1, length(text) - 1)").alias("value")), order)
    out.write.mode(mode).text(path)


def write_json(entries: DataFrame, path: str, order: str | None = "pos", mode: str = "overwrite") -> None:
    """JSON Lines, one entry per line (the text of ``json_lines``)."""
    lines = json_lines(entries)
    cols = [c for c in ("pos",) if c in lines.columns]
    _ordered(lines.select(*cols, F.col("line").alias("value")), order).write.mode(mode).text(path)


def write_summary(summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The one-row ``{total, successful, failed}`` document next to the entries."""
    summary.coalesce(1).write.mode(mode).json(path)
