"""Cell cleaning, spreadsheet references and output field formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .._util import col
from .isbn import trim_space


def is_sheet_header(c) -> Column:
    """A header cell, compared case-insensitively before any stripping
    (upper then lower, so 'ſ' matches 's' as simple case folding does)."""
    return F.lower(F.upper(col(c))).isin(*fixed.SHEET_HEADER_CELLS)


def clean_sheet_cell(c) -> Column:
    """trim, then strip spaces, hyphens and dots."""
    return F.translate(trim_space(c), fixed.SHEET_STRIP_CHARS, "")


def extract_sheet_id(c) -> Column:
    """id from a spreadsheet URL, else the input unchanged."""
    found = F.regexp_extract(col(c), fixed.SHEET_ID_PATTERN, 1)
    return F.coalesce(F.nullif(found, F.lit("")), col(c))


def range_error(c) -> Column:
    """P10: NULL for a usable A1 range, else the tool's message."""
    r = col(c)
    return (
        F.when(r.isNull() | (r == ""), F.lit(fixed.MSG_RANGE_EMPTY))
        .when(~(r.contains(":") | r.contains("!")), F.format_string(fixed.MSG_RANGE_FORMAT, r))
    )


def _column_index(letters: Column) -> Column:
    """Column number from 0 of one to three letters; places that are missing count as '@', the character before 'A'."""
    at = F.lpad(F.upper(letters), 3, "@")
    return sum((F.ascii(F.substring(at, i + 1, 1)) - 64) * 26 ** (2 - i) for i in range(3)) - 1


def range_cells(c) -> Column:
    """STRUCT<column, first, last> of an A1 range: the column from 0 and the rows from 1 (``last`` NULL: to the end).

    NULL where P10 finds an error or the cells can't be read. Only the first
    column counts, as the scan reads the first cell of every row.
    """
    cells = F.trim(F.regexp_extract(col(c), r"([^!]*)$", 1))
    pattern = r"^\$?([A-Za-z]{1,3})\$?(\d*)(:\$?[A-Za-z]{1,3}\$?(\d*))?$"
    part = {k: F.regexp_extract(cells, pattern, k) for k in (1, 2, 3, 4)}
    number = {k: part[k].try_cast("bigint") for k in (2, 4)}
    last = F.coalesce(number[4], F.when(part[3] == "", number[2]))
    found = F.struct(_column_index(part[1]).cast("int").alias("column"), F.coalesce(number[2], F.lit(1)).alias("first"), last.alias("last"))
    return F.when(range_error(c).isNull() & cells.rlike(pattern), found)


def join_list(c, sep: str) -> Column:
    """list joined by `sep`; a NULL list gives ''."""
    return F.coalesce(F.array_join(col(c), sep), F.lit(""))


def pages_text(c) -> Column:
    """F16: decimal text if > 0, else ''."""
    return F.when(col(c) > 0, col(c).cast("string")).otherwise(F.lit(""))


def isbn13_or_key(isbn13, isbn) -> Column:
    """ISBN-13 if present, else the lookup key (not converted)."""
    return F.coalesce(F.nullif(col(isbn13), F.lit("")), col(isbn))
