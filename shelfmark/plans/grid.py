"""Spreadsheet-style grid output (K4-K7).

The grid is a flat 9-column STRING table (no original key column). Targets
are tables or paths; "create the tab if missing" is ``saveAsTable`` on a
name the catalog does not know yet, and an existing target is not an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions.fields import isbn13_or_key, join_list, pages_text
from ..operators.resolve import first_results
from . import report as P


def _m(name: str, default):
    return F.coalesce(F.col(f"meta.{name}"), F.lit(default))


def sheet_rows(results: DataFrame, keep=("pos",)) -> DataFrame:
    """K4 rows: lists joined by ', ', status Success/Error, raw values."""
    h = fixed.GRID_HEADER
    ok = F.col("error").isNull()
    return results.select(
        *[c for c in keep if c in results.columns],
        isbn13_or_key(_m("isbn_13", ""), F.col("isbn")).alias(h[0]),
        _m("title", "").alias(h[1]),
        join_list(F.col("meta.authors"), fixed.GRID_LIST_SEP).alias(h[2]),
        _m("publisher", "").alias(h[3]),
        _m("publication_date", "").alias(h[4]),
        pages_text(_m("pages", 0)).alias(h[5]),
        join_list(F.col("meta.categories"), fixed.GRID_LIST_SEP).alias(h[6]),
        F.when(ok, F.lit(fixed.GRID_STATUS_SUCCESS)).otherwise(F.lit(fixed.GRID_STATUS_ERROR)).alias(h[7]),
        F.coalesce(F.col("error"), F.lit("")).alias(h[8]),
    )


JOB = "job"


def write_grid(rows: DataFrame, target: str, mode: str = "overwrite", fmt: str = "parquet",
               as_table: bool = False, job: str | None = None) -> None:
    """K4 (mode='overwrite') / K5 (mode='append') / K6 (create if missing).

    Exactly the 9 grid columns are written. A ``pos`` column only orders the
    rows: part files concatenate in its order. Appending adds rows after the
    existing ones; the header is schema, never repeated as data.

    With ``job``, an append is done once however often the job runs: its rows
    are the target's partition of that name, which a repeated run stages and
    exchanges for its own on commit (dynamic partition overwrite), and a run
    that fails leaves as it was. A target is appended to with job names from
    its first write on, or without.
    """
    out = P.in_order(rows).select(*fixed.GRID_HEADER) if "pos" in rows.columns else rows.select(*fixed.GRID_HEADER)
    if job is not None:
        out, keys = out.withColumn(JOB, F.lit(job)), {"partitionBy": [JOB]}
    else:
        keys = {}
    spark = rows.sparkSession
    new = as_table and not spark.catalog.tableExists(target)
    again = job is not None and mode == "append"
    writer = out.write.mode("overwrite" if again or new else mode).format(fmt)
    if again:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        writer = (writer.option("header", True).option("escape", '"')
                  .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if as_table and again and not new:
        writer.insertInto(target)
    elif as_table:
        writer.saveAsTable(target, **keys)
    else:
        writer.save(target, **keys)


def read_grid(spark: SparkSession, target: str, fmt: str = "parquet", as_table: bool = False) -> DataFrame:
    """The 9 grid columns of a target, whichever jobs appended them."""
    if as_table:
        found = spark.table(target)
    elif fmt == "csv":
        # A grid cell is never NULL: an empty cell reads back as ''.
        found = (spark.read.option("header", True).option("escape", '"').option("multiLine", True)
                 .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
                 .csv(target).na.fill(""))
    else:
        found = spark.read.format(fmt).load(target)
    return found.select(*[F.col(f"`{c}`") for c in fixed.GRID_HEADER])


# The preview shows PREVIEW_ROWS grid rows, the header among them.
PREVIEW_DATA = fixed.PREVIEW_ROWS - 1


def preview_rows(valid: DataFrame, lookup: DataFrame) -> DataFrame:
    """K7 data rows shown by a dry run: the first valid rows by ``pos``, and no other, are resolved."""
    return sheet_rows(first_results(valid, PREVIEW_DATA, lookup))


def first_rows(rows: DataFrame) -> DataFrame:
    """K7 rows of a grid that is there already (TakeOrderedAndProject)."""
    return rows.orderBy("pos").limit(PREVIEW_DATA)


def preview_report(rows: DataFrame, spreadsheet_id: str | None = None, output_range: str = "",
                   create_tab: str = "", data_rows: int | None = None) -> list[str]:
    """K7 dry-run text: total grid rows (data + header), first rows, remainder.

    With ``spreadsheet_id`` the text carries the tool's full frame (title,
    target, optional new tab, closing note). ``data_rows`` is the number of
    rows when the caller has it already (a job's summary); else it is
    counted. The driver receives at most PREVIEW_ROWS - 1 rows.
    """
    total = (rows.count() if data_rows is None else data_rows) + 1
    head = [list(fixed.GRID_HEADER)] + [
        [r[c] for c in fixed.GRID_HEADER] for r in first_rows(rows).collect()
    ]
    body = [fixed.PREVIEW_TOTAL % total, ""]
    body += [fixed.PREVIEW_ROW % (i + 1, " ".join(str(v) for v in row)) for i, row in enumerate(head)]
    if total > len(head):
        body.append(fixed.PREVIEW_MORE % (total - len(head)))
    if spreadsheet_id is None:
        return body
    frame = [fixed.PREVIEW_TITLE, "=" * len(fixed.PREVIEW_TITLE), fixed.PREVIEW_TARGET % spreadsheet_id,
             fixed.PREVIEW_RANGE % output_range]
    if create_tab:
        frame.append(fixed.PREVIEW_NEW_TAB % create_tab)
    return frame + [""] + body + ["", fixed.PREVIEW_NOTE]
