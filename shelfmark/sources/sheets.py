"""Spreadsheet sources (S4, S7) over grid exports (CSV, all cells STRING)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from .._util import with_once
from ..functions.fields import is_sheet_header, range_cells
from ..functions.isbn import trim_space
from .blocks import block_lines, written


def _column_number(letters: str) -> int:
    n = 0
    for ch in letters.upper():
        n = n * 26 + ord(ch) - ord("A") + 1
    return n - 1


def parse_range(a1: str) -> tuple[int, int, int | None]:
    """(column from 0, first row, last row or None) of an A1 range that P10 accepts.

    ``Sheet1!C2:C``, ``A2:A100``, ``B:B`` or ``Tab!B1`` (one cell). Only the
    first column counts, as the scan reads the first cell of every row.
    """
    if not a1:
        raise ValueError(fixed.MSG_RANGE_EMPTY)
    cells = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?(\d*)(:\$?[A-Za-z]{1,3}\$?(\d*))?", a1.rpartition("!")[2].strip())
    if cells is None or not (":" in a1 or "!" in a1):
        raise ValueError(fixed.MSG_RANGE_FORMAT % a1)
    first = int(cells[2] or 1)
    last = int(cells[4]) if cells[4] else first if cells[2] and not cells[3] else None
    return _column_number(cells[1]), first, last


# What a quote does to a row's state, and the text up to the next quote after it: the state before (at the start of a
# cell, in a plain cell, in a quoted cell, after a quote in a quoted cell) gives one state for each kind of that text
# (empty, ending with a comma, other). A quote inside a plain cell is a letter like any other.
_START, _PLAIN, _QUOTED, _AFTER = range(4)
_QUOTE_THEN = {
    _START: (_QUOTED, _QUOTED, _QUOTED),
    _PLAIN: (_PLAIN, _START, _PLAIN),
    _QUOTED: (_AFTER, _START, _PLAIN),
    _AFTER: (_QUOTED, _QUOTED, _QUOTED),
}
# What a line does to whether its row goes on (0: no open quoted cell, 1: one is open).
_KEEPS, _TURNS, _ENDS, _OPENS = range(4)


def line_effect(value: str = "value") -> Column:
    """What a line does to the state of its row: the quote automaton run from both states that a line can begin in.

    The pair of states is one number (4 times the one from outside a quoted
    cell, plus the one from inside), so a line is walked once, quote by quote.
    """
    pairs = [4 * _QUOTE_THEN[a][k] + _QUOTE_THEN[b][k] for a in range(4) for b in range(4) for k in range(3)]
    return F.expr(f"""
      CASE WHEN contains({value}, '"') THEN
        element_at(array({_EFFECT_OF}), aggregate(
          slice(split({value}, '"'), 2, length({value}) + 1),
          IF(split({value}, '"')[0] = '' OR endswith(split({value}, '"')[0], ','), {4 * _START + _QUOTED}, {4 * _PLAIN + _QUOTED}),
          (s, x) -> element_at(array({", ".join(map(str, pairs))}), 3 * s + CASE WHEN x = '' THEN 1 WHEN endswith(x, ',') THEN 2 ELSE 3 END)) + 1)
      ELSE {_KEEPS} END""")


# The effect of a pair of end states, by its number.
_EFFECT_OF = ", ".join(str((_OPENS if inside else _TURNS) if out else (_KEEPS if inside else _ENDS))
                       for out in (a == _QUOTED for a in range(4)) for inside in (b == _QUOTED for b in range(4)))

# State after a line that begins in state {0}.
_AFTER_SQL = f"CASE effect WHEN {_KEEPS} THEN {{0}} WHEN {_TURNS} THEN 1 - {{0}} WHEN {_OPENS} THEN 1 ELSE 0 END"


def _with_states(source: str, window: str) -> str:
    """SQL for ``source`` with the state before each row in the order of ``window``: ``open`` if it does not depend on
    how the window's part begins, else ``open`` turned by that beginning (``free``). Effects compose: the last that
    sets the state counts (it and the turns up to it are one number, ``held``), and the turns since."""
    upto = f"({window} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    before = f"({window} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""(
      SELECT * EXCEPT (turns, held, turned), held IS NULL AS free,
        int((coalesce(held, 0) % 2 + turned - coalesce(held, 0) DIV 2) % 2) AS open
      FROM (SELECT *, coalesce(max(turns) OVER {before}, 0) AS turned,
                   last(CASE WHEN effect IN ({_ENDS}, {_OPENS}) THEN 2 * turns + int(effect = {_OPENS}) END, true) OVER {before} AS held
            FROM (SELECT *, sum(int(effect = {_TURNS})) OVER {upto} AS turns FROM {source})))"""


# One row a block. Only lines with quotes are looked at in order, and without their text. Lines that go on with an open
# cell, if the block begins outside (on0) or inside (on1) one, are those before the first quoted line and that line,
# those between quoted lines, and those after the last one: lines up to the next quoted one begin in the state after
# this one. A file begins outside whatever the file before it ends with, so the state is known everywhere.
_BLOCKS_SQL = f"""
WITH runs AS (
  SELECT *, lead(at) OVER (PARTITION BY file, block ORDER BY at) - at AS long,
    {_AFTER_SQL.format("open")} AS after, free AND effect = {_TURNS} AS loose
  FROM {_with_states(f"(SELECT file, block, at, effect FROM {{lines}} WHERE effect <> {_KEEPS})", "PARTITION BY file, block ORDER BY at")}),
sums AS (
  SELECT file, block, min(at) AS q, max(at) AS z, max(CASE WHEN long IS NULL THEN after + 2 * int(loose) END) AS last,
    coalesce(sum(CASE WHEN NOT loose AND after = 1 THEN long END), 0) AS inner,
    coalesce(sum(CASE WHEN loose AND after = 1 THEN long END), 0) AS inner0,
    coalesce(sum(CASE WHEN loose AND after = 0 THEN long END), 0) AS inner1
  FROM runs GROUP BY file, block),
blocks AS (
  SELECT file, block, min(at) AS first, max(at) AS end, max(int(effect IN ({_TURNS}, {_OPENS}))) AS opens
  FROM {{lines}} GROUP BY file, block),
effects AS (
  SELECT file, block, first, end, opens,
    coalesce(inner + inner0 + last % 2 * (end - z), 0) AS on0,
    coalesce(inner + inner1 + IF(last >= 2, 1 - last % 2, last % 2) * (end - z), 0) + coalesce(q, end) - first + 1 AS on1,
    CASE WHEN lead(file) OVER (ORDER BY file, block) <> file THEN {_ENDS}
         WHEN last IS NULL OR last = 2 THEN {_KEEPS} WHEN last = 3 THEN {_TURNS} WHEN last = 1 THEN {_OPENS} ELSE {_ENDS} END AS effect
  FROM blocks LEFT JOIN sums USING (file, block)),
placed AS (
  SELECT *, coalesce(sum(end - first + 1 - IF(open = 1, on1, on0))
                     OVER (ORDER BY file, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over
  FROM {_with_states("effects", "ORDER BY file, block")}),
shifted AS (
  SELECT *, max(IF(begins, over, NULL)) OVER (ORDER BY file, block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shift
  FROM (SELECT *, coalesce(lag(file) OVER (ORDER BY file, block) <> file, true) AS begins FROM placed))
SELECT file, block, first, open AS start, open = 0 AND opens = 0 AS simple, over - shift AS base, shift FROM shifted
"""

# Every line of a block that is not simple, with its row in the file, and the states before and after it.
_MIXED_SQL = f"""
SELECT file, block, at, value, shift, before, {_AFTER_SQL.format("before")} AS after,
  base + sum(1 - before) OVER (PARTITION BY file, block ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS row
FROM (SELECT *, IF(free AND start = 1, 1 - open, open) AS before
      FROM {_with_states("(SELECT * FROM {lines} JOIN {blocks} USING (file, block) WHERE NOT simple)", "PARTITION BY file, block ORDER BY at")})
"""

_SIMPLE_SQL = "SELECT file, base + at - first + 1 AS row, shift, value AS text FROM {lines} JOIN {blocks} USING (file, block) WHERE simple"

_SEVERAL_SQL = f"""
WITH mixed AS ({_MIXED_SQL}),
several AS (
  SELECT file, row, shift, sort_array(collect_list(struct(block, at, value))) AS parts
  FROM mixed WHERE before = 1 OR after = 1 GROUP BY file, row, shift)
SELECT file, row, shift, value AS text FROM mixed WHERE before = 0 AND after = 0
UNION ALL SELECT file, row, shift, array_join(parts.value, '\\n') FROM several
"""


def read_grid_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of grid exports (CSV text): ``(file, row, number, text)``, blank rows included; ``row`` counts from 1 within
    each file, ``number`` over all files in the order of their names.

    A quoted cell may hold line breaks, so a line may go on with the row before
    it. Whether it does follows from an automaton over the quotes: each line's
    effect is known by itself, the effects of a block's lines are summed up,
    and a running sum over the blocks (one row each) gives the state that each
    begins in and its first row number. Blocks in which every line is a row
    are numbered where they are; the others line by line, block by block; rows
    of several lines are put together at the end. No task gets a whole file. A
    quote inside a cell that is not quoted is a letter and costs no row; a
    quoted cell that is never closed reaches to the end of its file.
    """
    lines, kinds = block_lines(spark, path, effect=line_effect()), Observation()
    counts = [F.count_if(F.col("simple")).alias("simple"), F.count_if(~F.col("simple")).alias("mixed")]
    blocks = written(spark.sql(_BLOCKS_SQL, lines=lines).observe(kinds, *counts), "grid-blocks")
    # Kinds of blocks that there are none of are left out of the plan.
    parts = [spark.sql(text, lines=lines, blocks=blocks) for text, n in ((_SIMPLE_SQL, kinds.get["simple"]), (_SEVERAL_SQL, kinds.get["mixed"])) if n]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else spark.sql(_SIMPLE_SQL, lines=lines, blocks=blocks)
    return rows.select("file", "row", (F.col("shift") + F.col("row")).alias("number"), "text")


def _cells(text: str, columns: int) -> Column:
    return F.from_csv(F.regexp_replace(text, "\r$", ""), ", ".join(f"c{i} string" for i in range(columns)),
                      {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})


def read_grid_export(spark: SparkSession, path: str, a1: str | None = None) -> DataFrame:
    """Rows of a grid export (CSV): ``(row, c0)``, blank rows included.

    ``row`` counts from 1 over all files in the order of their names; with a
    range, the rows and the column it names. Ragged rows give NULL.
    """
    column, first, last = parse_range(a1) if a1 is not None else (0, 1, None)
    out = read_grid_records(spark, path).select(F.col("number").alias("row"), _cells("text", column + 1).getField(f"c{column}").alias("c0"))
    out = out.where(F.col("row") >= first) if first > 1 else out
    return out.where(F.col("row") <= last) if last is not None else out


def export_name(file: Column) -> Column:
    """The file's name without its folders."""
    return F.regexp_extract(file, r"([^/]*)$", 1)


def read_grid_manifest(spark: SparkSession, path: str, manifest: DataFrame, name: Column | None = None) -> DataFrame:
    """Rows of many grid exports, each with a range of its own: ``(export, row, c0)`` in one scan.

    ``manifest`` has ``(export, range)``; an export is one file below ``path``,
    and ``name`` says how its name follows from the column ``file`` (its last
    part by default). An export with several ranges is given once for each;
    exports without a usable range, and files that the manifest does not name,
    give no rows (``range_error`` has the reasons). Row numbers are those of
    the export's own file. The widest column asked for bounds what is parsed.
    """
    wanted = written(manifest.select("export", range_cells("range").alias("r")).where(F.col("r").isNotNull()), "manifest")
    widest = wanted.agg(F.max("r.column")).first()[0]
    cells = _cells("text", 1 if widest is None else widest + 1)
    rows = read_grid_records(spark, path).withColumn("export", export_name(F.col("file")) if name is None else name)
    last = F.coalesce("r.last", "row")
    asked = rows.join(wanted, "export").where((F.col("row") >= F.col("r.first")) & (F.col("row") <= last))
    values = F.array(*[cells.getField(f"c{i}") for i in range(0 if widest is None else widest + 1)])
    return asked.select("export", "row", F.get(values, F.col("r.column")).alias("c0") if widest is not None else F.lit(None).cast("string").alias("c0"))


def sheet_column_ids(grid: DataFrame, cell: str = "c0", row: str = "row") -> DataFrame:
    """First cell of each row, trimmed; blanks and header cells
    skipped (header test before stripping); spaces, '-' and '.' stripped;
    empty results dropped. Output ``(pos, raw)``."""
    staged = with_once(grid.select(F.col(row).alias("pos"), F.col(cell).alias("_c")), trim_space("_c"), "_t")
    kept = staged.where(F.col("_t").isNotNull() & (F.col("_t") != "") & ~is_sheet_header("_t"))
    return with_once(kept.select("pos", "_t"), F.translate("_t", fixed.SHEET_STRIP_CHARS, ""), "raw") \
        .select("pos", "raw").where(F.col("raw") != "")


def read_sheet_column(spark: SparkSession, path: str, require: bool = False, a1: str | None = None) -> DataFrame:
    """S4 over a grid export; ``require`` fails on an empty range or when
    nothing is left after cleaning (P8, the tool's messages)."""
    grid = read_grid_export(spark, path, a1)
    if require and grid.isEmpty():
        raise ValueError(fixed.MSG_NO_DATA % (a1 or path))
    ids = sheet_column_ids(grid)
    if require and ids.isEmpty():
        raise ValueError(fixed.MSG_NO_IDS % (a1 or path))
    return ids


def sheet_row_count(grid: DataFrame) -> DataFrame:
    """Rows in the range, blanks and headers included."""
    return grid.agg(F.count(F.lit(1)).alias("rows"))
