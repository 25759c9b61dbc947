"""DuckDB oracle SQL for every registered query.

The oracle restates the derivation rules of ``inputs.py`` in SQL and
computes expected results directly: classification by its own checksum
SQL, provider outcomes by a table of expected fields per response variant
(no JSON parsing), resolution by plain left joins. Tables are the driver's
views (orders, part, lineitem, pages).
"""

from __future__ import annotations

from .. import fixed
from .inputs import EXPORTS

# --- derivation --------------------------------------------------------------


def _book(src: str, b: str, extra: str) -> str:
    """Subquery adding b9, c10, c13, k10, k13 for book column ``b``."""
    digits = [f"CAST(substr(b9, {i}, 1) AS INTEGER)" for i in range(1, 10)]
    s10 = " + ".join(f"{d} * {11 - i}" for i, d in enumerate(digits, start=1))
    s13 = "38 + " + " + ".join(f"{d} * {3 if i % 2 == 1 else 1}" for i, d in enumerate(digits, start=1))
    return f"""(
  SELECT *, b9 || c10 AS k10, '978' || b9 || CAST(c13 AS VARCHAR) AS k13 FROM (
    SELECT *, CASE WHEN (11 - ({s10}) % 11) % 11 = 10 THEN 'X'
                   ELSE CAST((11 - ({s10}) % 11) % 11 AS VARCHAR) END AS c10,
              (10 - ({s13}) % 10) % 10 AS c13
    FROM (SELECT {extra}, {b} AS b, lpad(CAST({b} AS VARCHAR), 9, '0') AS b9 FROM {src})))"""


def _shape_sql(shape: str) -> str:
    return f"""CASE {shape}
      WHEN 0 THEN k13
      WHEN 1 THEN '978-' || substr(b9, 1, 1) || '-' || substr(b9, 2, 3) || '-' || substr(b9, 5, 5) || '-' || CAST(c13 AS VARCHAR)
      WHEN 2 THEN k10
      WHEN 3 THEN substr(b9, 1, 1) || ' ' || substr(b9, 2, 3) || ' ' || substr(b9, 5, 5) || ' ' || c10
      WHEN 4 THEN '978' || b9 || CAST((c13 + 1) % 10 AS VARCHAR)
      WHEN 5 THEN '978' || b9
      WHEN 6 THEN '999' || b9 || CAST(c13 AS VARCHAR)
      ELSE lower(k10) END"""


RAW_IDS = f"""raw_ids AS (
  SELECT pos, {_shape_sql('pos % 8')} AS raw
  FROM {_book('orders', 'o_custkey', 'o_orderkey AS pos')})"""

RAW_IDS_LARGE = f"""raw_ids AS (
  SELECT pos, {_shape_sql('shape')} AS raw
  FROM {_book('lineitem', 'l_partkey', 'l_orderkey * 8 + l_linenumber AS pos, (l_orderkey + l_linenumber) % 8 AS shape')})"""

RAW_IDS_SKEWED = f"""raw_ids AS (
  SELECT pos, {_shape_sql('shape')} AS raw
  FROM {_book('lineitem', 'CASE WHEN l_orderkey % 3 = 0 THEN 7 ELSE l_partkey END',
              'l_orderkey * 8 + l_linenumber AS pos, (l_orderkey + l_linenumber) % 8 AS shape')})"""

RAW_IDS_IDENTICAL = f"""raw_ids AS (
  SELECT 0 AS pos, {_shape_sql('1')} AS raw
  FROM {_book('lineitem', '1', 'l_orderkey')})"""

DECORATED = """decorated AS (
  SELECT pos, CASE pos % 5 WHEN 0 THEN raw WHEN 1 THEN '  ' || raw WHEN 2 THEN raw || chr(9)
                           WHEN 3 THEN raw || chr(13) ELSE chr(12288) || raw || ' ' END AS raw
  FROM raw_ids)"""


def _classify_sql(n: str) -> tuple[str, str]:
    """(isbn10_ok, isbn13_ok) boolean SQL over normalised string ``n``."""
    d = lambda i: f"TRY_CAST(substr({n}, {i}, 1) AS INTEGER)"
    s10 = " + ".join(f"{d(i)} * {11 - i}" for i in range(1, 10))
    ok10 = (f"(regexp_full_match({n}, '[0-9]{{9}}[0-9Xx]') AND "
            f"({s10} + CASE WHEN upper(substr({n}, 10, 1)) = 'X' THEN 10 ELSE {d(10)} END) % 11 = 0)")
    s13 = " + ".join(f"{d(i)} * {1 if i % 2 == 1 else 3}" for i in range(1, 13))
    ok13 = (f"(regexp_full_match({n}, '97[89][0-9]{{10}}') AND "
            f"(10 - ({s13}) % 10) % 10 = {d(13)})")
    return ok10, ok13


_OK10, _OK13 = _classify_sql("n")

CLASSIFIED = f"""normalized AS (
  SELECT *, replace(replace(raw, '-', ''), ' ', '') AS n FROM raw_ids),
classified AS (
  SELECT pos, raw, n,
    CASE WHEN strlen(n) = 13 THEN CASE WHEN {_OK13} THEN '{fixed.TYPE_ISBN13}' ELSE '{fixed.TYPE_INVALID}' END
         WHEN strlen(n) = 10 THEN CASE WHEN {_OK10} THEN '{fixed.TYPE_ISBN10}' ELSE '{fixed.TYPE_INVALID}' END
         ELSE '{fixed.TYPE_INVALID}' END AS type,
    CASE WHEN strlen(n) = 13 THEN CASE WHEN {_OK13} THEN '' ELSE '{fixed.MSG_BAD_ISBN13}' END
         WHEN strlen(n) = 10 THEN CASE WHEN {_OK10} THEN '' ELSE '{fixed.MSG_BAD_ISBN10}' END
         ELSE '{fixed.MSG_BAD_FORMAT}' END AS error
  FROM normalized),
valid AS (
  SELECT pos, raw, type AS id_type, n AS isbn FROM classified WHERE type <> '{fixed.TYPE_INVALID}')"""

# Expected provider outcomes per response variant (see inputs.py).
_PARTS = f"""parts AS (
  SELECT *, 'Writer ' || CAST(p_partkey % 101 AS VARCHAR) AS w1,
            'Writer ' || CAST(p_partkey % 89 + 100 AS VARCHAR) AS w2,
            CAST(p_partkey % 70 + 1950 AS VARCHAR) AS year,
            'Size ' || CAST(p_size AS VARCHAR) AS subj2,
            (p_partkey // 5) % 8 AS va, (p_partkey // 5) % 9 AS vb
  FROM {_book('part', 'p_partkey', 'p_partkey, p_name, p_brand, p_type, p_size')}),
part_keys AS (
  SELECT *, k13 AS isbn FROM parts UNION ALL SELECT *, k10 AS isbn FROM parts)"""


def _jarr(*items: str) -> str:
    return "'[' || " + " || ',' || ".join(f"'\"' || {i} || '\"'" for i in items) + " || ']'"


EXPECTED = f"""{_PARTS},
exp_a AS (
  SELECT isbn, 'provider_a' AS provider, '' AS isbn_10, '' AS isbn_13,
    CASE WHEN va IN (0, 6, 7) THEN p_name ELSE '' END AS title,
    CASE WHEN va IN (0, 6, 7) THEN {_jarr('w1', 'w2')} END AS authors,
    CASE WHEN va IN (0, 7) THEN p_brand WHEN va = 5 THEN p_brand ELSE '' END AS publisher,
    CASE WHEN va IN (0, 7) THEN year ELSE '' END AS publication_date,
    CAST(CASE WHEN va IN (0, 6, 7) THEN p_size ELSE 0 END AS BIGINT) AS pages,
    CASE WHEN va IN (0, 7) THEN {_jarr('p_type', 'subj2')} WHEN va = 5 THEN {_jarr('p_type')} END AS categories
  FROM part_keys WHERE p_partkey % 5 IN (0, 1) AND va IN (0, 4, 5, 6, 7)),
exp_b AS (
  SELECT isbn, 'provider_b' AS provider,
    CASE WHEN vb IN (0, 8) THEN k10 ELSE '' END AS isbn_10,
    CASE WHEN vb IN (0, 6) THEN k13 ELSE '' END AS isbn_13,
    CASE WHEN vb = 5 THEN '' ELSE p_name END AS title,
    CASE WHEN vb = 0 THEN {_jarr('w1', 'w2')} WHEN vb = 6 THEN {_jarr('w1')} WHEN vb = 8 THEN '[]' END AS authors,
    CASE WHEN vb = 0 THEN p_brand ELSE '' END AS publisher,
    CASE WHEN vb = 0 THEN year || '-' || lpad(CAST(p_partkey % 12 + 1 AS VARCHAR), 2, '0') || '-01' ELSE '' END
      AS publication_date,
    CAST(CASE WHEN vb IN (0, 6) THEN p_size ELSE 0 END AS BIGINT) AS pages,
    CASE WHEN vb = 0 THEN {_jarr('p_type')} WHEN vb = 8 THEN {_jarr('p_type', "''")} END AS categories
  FROM part_keys WHERE p_partkey % 5 IN (1, 2, 3) AND vb IN (0, 5, 6, 8))"""

_FIELDS = ("provider", "isbn_10", "isbn_13", "title", "authors", "publisher", "publication_date", "pages",
           "categories")

KEYS = """keys AS (SELECT isbn, count(*) AS n FROM valid GROUP BY isbn),
best AS (
  SELECT k.isbn, k.n, """ + ",\n    ".join(
    f"CASE WHEN a.isbn IS NOT NULL THEN a.{f} ELSE b.{f} END AS {f}" for f in _FIELDS) + f""",
    CASE WHEN a.isbn IS NULL AND b.isbn IS NULL THEN '{fixed.MSG_UNRESOLVED}' END AS error
  FROM keys k LEFT JOIN exp_a a ON a.isbn = k.isbn LEFT JOIN exp_b b ON b.isbn = k.isbn),
results AS (
  SELECT v.pos, v.raw, v.isbn, """ + ", ".join(f"r.{f}" for f in _FIELDS) + """, r.error
  FROM valid v JOIN best r ON r.isbn = v.isbn)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _base(raw: str = RAW_IDS) -> str:
    return _with(raw, CLASSIFIED, EXPECTED, KEYS)


def _list_join(c: str, sep: str) -> str:
    # The expected lists are JSON text; turn them into joined text.
    inner = f"substr({c}, 3, length({c}) - 4)"
    return f"coalesce(CASE WHEN {c} = '[]' THEN '' ELSE replace({inner}, '\",\"', '{sep}') END, '')"


def _csv_cols(prefix_pos: bool = True) -> str:
    h = fixed.CSV_HEADER
    cols = [
        f'isbn AS "{h[0]}"',
        f"CASE WHEN coalesce(isbn_13, '') <> '' THEN isbn_13 ELSE isbn END AS \"{h[1]}\"",
        f"coalesce(title, '') AS \"{h[2]}\"",
        f"{_list_join('authors', fixed.CSV_LIST_SEP)} AS \"{h[3]}\"",
        f"coalesce(publisher, '') AS \"{h[4]}\"",
        f"coalesce(publication_date, '') AS \"{h[5]}\"",
        f"CASE WHEN coalesce(pages, 0) > 0 THEN CAST(pages AS VARCHAR) ELSE '' END AS \"{h[6]}\"",
        f"{_list_join('categories', fixed.CSV_LIST_SEP)} AS \"{h[7]}\"",
        f"CASE WHEN error IS NULL THEN '{fixed.STATUS_SUCCESS}' ELSE '{fixed.STATUS_ERROR}' END AS \"{h[8]}\"",
        f"coalesce(error, '') AS \"{h[9]}\"",
    ]
    return ", ".join((["pos"] if prefix_pos else []) + cols)


def _grid_cols(prefix_pos: bool = True) -> str:
    h = fixed.GRID_HEADER
    cols = [
        f"CASE WHEN coalesce(isbn_13, '') <> '' THEN isbn_13 ELSE isbn END AS \"{h[0]}\"",
        f"coalesce(title, '') AS \"{h[1]}\"",
        f"{_list_join('authors', fixed.GRID_LIST_SEP)} AS \"{h[2]}\"",
        f"coalesce(publisher, '') AS \"{h[3]}\"",
        f"coalesce(publication_date, '') AS \"{h[4]}\"",
        f"CASE WHEN coalesce(pages, 0) > 0 THEN CAST(pages AS VARCHAR) ELSE '' END AS \"{h[5]}\"",
        f"{_list_join('categories', fixed.GRID_LIST_SEP)} AS \"{h[6]}\"",
        f"CASE WHEN error IS NULL THEN '{fixed.GRID_STATUS_SUCCESS}' ELSE '{fixed.GRID_STATUS_ERROR}' END AS \"{h[7]}\"",
        f"coalesce(error, '') AS \"{h[8]}\"",
    ]
    return ", ".join((["pos"] if prefix_pos else []) + cols)


def _text_block() -> str:
    lab = fixed.TEXT_LABELS
    nl = "chr(10)"
    authors = _list_join("authors", fixed.TEXT_LIST_SEP)
    cats = _list_join("categories", fixed.TEXT_LIST_SEP)

    def opt(label: str, value: str, cond: str) -> str:
        return f"CASE WHEN {cond} THEN '{label}' || {value} || {nl} ELSE '' END"

    ok = " || ".join([
        f"'{lab[0]}' || isbn || {nl}",
        opt(lab[1], "isbn_13", "coalesce(isbn_13, '') <> ''"),
        opt(lab[2], "title", "coalesce(title, '') <> ''"),
        opt(lab[3], authors, f"{authors} <> ''"),
        opt(lab[4], "publisher", "coalesce(publisher, '') <> ''"),
        opt(lab[5], "publication_date", "coalesce(publication_date, '') <> ''"),
        opt(lab[6], "CAST(pages AS VARCHAR)", "coalesce(pages, 0) > 0"),
        opt(lab[7], cats, f"{cats} <> ''"),
        f"'{fixed.TEXT_OK}'",
    ])
    failed = f"'{lab[0]}' || isbn || {nl} || '{fixed.TEXT_FAILED}' || error"
    end = f"{nl} || {nl} || '---' || {nl} || {nl}"
    return f"(CASE WHEN error IS NULL THEN {ok} ELSE {failed} END) || {end}"


def _json_line() -> str:
    def s(name: str, v: str) -> str:
        return f"'\"{name}\":\"' || {v} || '\"'"

    data = " || ',' || ".join([
        s("isbn", "isbn"),
    ]) + " || " + (
        "CASE WHEN isbn_10 <> '' THEN ',' || " + s("isbn_10", "isbn_10") + " ELSE '' END || "
        "CASE WHEN isbn_13 <> '' THEN ',' || " + s("isbn_13", "isbn_13") + " ELSE '' END || "
        "',' || " + s("title", "title") + " || "
        "',\"authors\":' || coalesce(authors, 'null') || "
        "',' || " + s("publisher", "publisher") + " || "
        "',' || " + s("publication_date", "publication_date") + " || "
        "',\"pages\":' || CAST(pages AS VARCHAR) || "
        "',\"categories\":' || coalesce(categories, 'null')"
    )
    ok = (f"'{{\"isbn\":\"' || isbn || '\",\"status\":\"{fixed.STATUS_SUCCESS}\",\"data\":{{' || "
          f"{data} || '}}}}'")
    bad = (f"'{{\"isbn\":\"' || isbn || '\",\"status\":\"{fixed.STATUS_ERROR}\",\"error\":\"' || error || '\"}}'")
    return f"CASE WHEN error IS NULL THEN {ok} ELSE {bad} END"


def _lines_cte() -> str:
    # Cleaned id lines equal the raw ids: decorations are edge white space.
    return _with(RAW_IDS)


def _sheet_cells() -> str:
    words = ", ".join(f"'{w}'" for w in ("ISBN", "isbn-13", "ISBN Number", "Isbn-10"))
    return f"""sheet AS (
  SELECT pos, CASE pos % 7 WHEN 0 THEN raw WHEN 1 THEN ' ' || raw || ' ' WHEN 2 THEN replace(raw, '-', '.')
                WHEN 3 THEN chr(9) || raw WHEN 4 THEN regexp_replace(raw, '(...)', '\\1 ', 'g')
                WHEN 5 THEN raw || '.' ELSE raw END AS c0
  FROM raw_ids
  UNION ALL
  SELECT pos, CASE WHEN pos % 50 = 0 THEN [{words}][CAST((pos // 50) % 4 + 1 AS INTEGER)]
                   WHEN pos % 50 = 25 THEN '' WHEN pos % 50 = 10 THEN '. - ' ELSE 'isbn 13' END AS c0
  FROM raw_ids WHERE pos % 50 IN (0, 25, 10, 40)),
sheet_ids AS (
  SELECT pos, replace(replace(replace(trim(c0, ' ' || chr(9)), ' ', ''), '-', ''), '.', '') AS raw
  FROM sheet
  WHERE trim(c0, ' ' || chr(9)) <> ''
    AND lower(trim(c0, ' ' || chr(9))) NOT IN ('isbn', 'isbn-10', 'isbn-13', 'isbn number'))"""


def _sheet_base() -> str:
    """Resolution over the ids of the sheet export instead of raw_ids."""
    cls = CLASSIFIED.replace("FROM raw_ids)", "FROM sheet_clean)")
    return _with(RAW_IDS, _sheet_cells(), "sheet_clean AS (SELECT pos, raw FROM sheet_ids WHERE raw <> '')",
                 cls, EXPECTED, KEYS)


_MANIFEST = """manifest AS (
  SELECT page_id AS job_id,
    CASE page_id % 4
      WHEN 0 THEN 'https://docs.google.com/spreadsheets/d/' || sid || '/edit'
      WHEN 1 THEN 'https://docs.google.com/spreadsheets/d/' || sid || '/edit#gid=0'
      WHEN 2 THEN sid ELSE url END AS sheet_ref,
    CASE page_id % 6 WHEN 0 THEN 'Sheet1!A2:A' WHEN 1 THEN 'A2:A' || CAST(page_id + 1 AS VARCHAR)
      WHEN 2 THEN 'A:A' WHEN 3 THEN 'A' || CAST(page_id AS VARCHAR) WHEN 4 THEN '' ELSE 'Tab!B1' END AS range
  FROM (SELECT *, '1B' || upper(substr(md5(url), 1, 10)) || '-' || CAST(page_id AS VARCHAR) || '_x' AS sid
        FROM pages))"""


def oracle_sql() -> dict[str, str]:
    base = _base()
    res_cols = "pos, isbn, provider, isbn_10, isbn_13, title, authors, publisher, publication_date, pages, " \
               "categories, error"
    prov_cols = "isbn, provider, isbn_10, isbn_13, title, authors, publisher, publication_date, pages, categories"
    q = {
        "normalize_ids": _with(RAW_IDS) + "SELECT pos, raw, replace(replace(raw, '-', ''), ' ', '') AS normalized "
                                          "FROM raw_ids",
        "check_isbn10": _with(RAW_IDS, CLASSIFIED) + f"SELECT pos, n AS candidate, coalesce({_OK10}, false) AS ok "
                                                     "FROM normalized",
        "check_isbn13": _with(RAW_IDS, CLASSIFIED) + f"SELECT pos, n AS candidate, coalesce({_OK13}, false) AS ok "
                                                     "FROM normalized",
        "classify_ids": _with(RAW_IDS, CLASSIFIED) + "SELECT pos, raw, type, CASE WHEN type = 'Invalid' THEN '' "
                                                     "ELSE n END AS normalized, error FROM classified",
        "valid_ids": _with(RAW_IDS, CLASSIFIED) + "SELECT pos, raw, id_type, isbn FROM valid",
        "rejected_ids": _with(RAW_IDS, CLASSIFIED) + "SELECT pos, raw, error AS reason FROM classified "
                                                     "WHERE type = 'Invalid'",
        "isbn10_to_13": _with(RAW_IDS, CLASSIFIED) + (
            "SELECT pos, n AS isbn, CASE WHEN strlen(n) <> 10 THEN '' "
            "WHEN regexp_full_match(substr(n, 1, 9), '[0-9]{9}') THEN '978' || substr(n, 1, 9) || CAST((10 - (38 + "
            + " + ".join(f"CAST(substr(n, {i}, 1) AS INTEGER) * {3 if i % 2 == 1 else 1}" for i in range(1, 10))
            + ") % 10) % 10 AS VARCHAR) END AS isbn13 FROM normalized"),
        "input_counts": _with(RAW_IDS, CLASSIFIED) + "SELECT count(*) AS rows_read, "
                                                     "count(*) FILTER (WHERE type <> 'Invalid') AS rows_valid "
                                                     "FROM classified",
        "scan_id_lines": _lines_cte() + "SELECT raw FROM raw_ids",
        "stream_clean_ids": _lines_cte() + "SELECT raw FROM raw_ids",
        "id_lines_in_order": _with(RAW_IDS) + (
            "SELECT sum(CASE WHEN pos % 10 IN (0, 5, 7) THEN 2 ELSE 1 END) OVER (ORDER BY pos)::BIGINT - 1 AS pos, raw FROM raw_ids"),
        "scan_sheet_manifest": _with(_MANIFEST, RAW_IDS, f"""rows AS (
  SELECT pos % {EXPORTS} AS job, row_number() OVER (PARTITION BY pos % {EXPORTS} ORDER BY pos) AS row, raw,
    CASE WHEN pos % 5 = 1 THEN 'status' || chr(10) || '"' || o_orderstatus || '"' WHEN pos % 7 = 2 THEN o_orderstatus || '"'
      ELSE o_orderstatus END AS b
  FROM raw_ids JOIN orders ON o_orderkey = pos)""") + (
            "SELECT 'export=' || job::VARCHAR AS export, row, CASE job % 6 WHEN 5 THEN b ELSE raw END AS c0 "
            "FROM rows JOIN manifest ON job_id = job WHERE CASE job % 6 WHEN 0 THEN row >= 2 WHEN 1 THEN row BETWEEN 2 AND job + 1 "
            "WHEN 2 THEN true WHEN 5 THEN row = 1 ELSE false END"),
        "scan_id_literals": _with(RAW_IDS, DECORATED, CLASSIFIED.replace("FROM raw_ids)", "FROM decorated)"))
        + "SELECT pos, raw, type, error FROM classified",
        "scan_sheet_column": _with(RAW_IDS, _sheet_cells()) + "SELECT raw FROM sheet_ids WHERE raw <> ''",
        "sheet_row_count": _with(RAW_IDS, _sheet_cells()) + "SELECT count(*) AS rows FROM sheet",
        "provider_a_hits": _with(EXPECTED) + f"SELECT {prov_cols} FROM exp_a",
        "provider_b_hits": _with(EXPECTED) + f"SELECT {prov_cols} FROM exp_b",
        "extract_sheet_ids": _with(_MANIFEST) + (
            "SELECT job_id, sheet_ref, coalesce(nullif(regexp_extract(sheet_ref, "
            "'/spreadsheets/d/([a-zA-Z0-9_-]+)', 1), ''), sheet_ref) AS sheet_id FROM manifest"),
        "check_ranges": _with(_MANIFEST) + (
            f"SELECT job_id, range, CASE WHEN range = '' THEN '{fixed.MSG_RANGE_EMPTY}' "
            "WHEN NOT (contains(range, ':') OR contains(range, '!')) THEN "
            "replace('" + fixed.MSG_RANGE_FORMAT.replace("'", "''") + "', '%s', range) END AS range_error FROM manifest"),
        "resolve": base + f"SELECT {res_cols} FROM results",
        "resolve_chain": base + f"SELECT {res_cols} FROM results",
        "fallback_keys": base + "SELECT k.isbn FROM keys k WHERE NOT EXISTS "
                                "(SELECT 1 FROM exp_a a WHERE a.isbn = k.isbn)",
        "lookup_upkeep": _with(EXPECTED) + (
            f"SELECT {prov_cols} FROM exp_a UNION ALL SELECT {prov_cols} FROM exp_b b WHERE NOT EXISTS (SELECT 1 FROM exp_a a WHERE a.isbn = b.isbn)"),
        "unresolved_ids": base + "SELECT isbn, error FROM best WHERE error IS NOT NULL",
        "resolved_ids": base + "SELECT isbn, provider FROM best WHERE error IS NULL",
        "summary_rows": base + "SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total, "
                               "CAST(coalesce(sum(n) FILTER (WHERE error IS NULL), 0) AS BIGINT) AS successful, "
                               "CAST(coalesce(sum(n) FILTER (WHERE error IS NOT NULL), 0) AS BIGINT) AS failed "
                               "FROM best",
        "summary_distinct": base + "SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total, "
                                   "CAST(coalesce(sum(n), 0) - count(*) FILTER (WHERE error IS NOT NULL) AS BIGINT) "
                                   "AS successful, count(*) FILTER (WHERE error IS NOT NULL) AS failed FROM best",
        "csv_rows": base + f"SELECT {_csv_cols()} FROM results",
        "sheet_rows": base + f"SELECT {_grid_cols(prefix_pos=False)} FROM results",
        "render_text": base + f"SELECT pos, isbn, {_text_block()} AS text FROM results",
        "json_entries": base + f"SELECT pos, isbn, CASE WHEN error IS NULL THEN '{fixed.STATUS_SUCCESS}' "
                               f"ELSE '{fixed.STATUS_ERROR}' END AS status, {_json_line()} AS line FROM results",
        "preview_rows": base + f"SELECT {_grid_cols()} FROM results ORDER BY pos LIMIT {fixed.PREVIEW_ROWS - 1}",
        "sheet_append": base + f"SELECT {_grid_cols(prefix_pos=False)} FROM results UNION ALL SELECT {_grid_cols(prefix_pos=False)} FROM results",
        "sheet_append_jobs": base + f"SELECT {_grid_cols(prefix_pos=False)} FROM results UNION ALL SELECT {_grid_cols(prefix_pos=False)} FROM results",
        "stream_resolve": base + f"SELECT {_csv_cols(prefix_pos=False)} FROM results",
        "stream_summary": base + (
            "SELECT (SELECT count(*) FROM raw_ids) AS rows_read, count(*) AS rows_valid, count(*) AS total, "
            "count(*) FILTER (WHERE error IS NULL) AS successful, count(*) FILTER (WHERE error IS NOT NULL) AS failed, "
            "count(*) - count(DISTINCT isbn) FILTER (WHERE error IS NOT NULL) AS successful_keys, "
            "count(DISTINCT isbn) FILTER (WHERE error IS NOT NULL) AS failed_keys FROM results"),
        "stream_join_hot": _base(RAW_IDS_SKEWED) + "SELECT isbn, provider, title, error FROM results",
        "sheet_round_trip": _sheet_base() + f"SELECT {_grid_cols(prefix_pos=False)} FROM results",
        "resolve_identical_rows": _base(RAW_IDS_IDENTICAL) + "SELECT raw, isbn, provider, title, error FROM results",
        "resolve_skewed": _base(RAW_IDS_SKEWED) + "SELECT pos, isbn, provider, title, error FROM results",
        "bench_classify_large": _with(RAW_IDS_LARGE, CLASSIFIED) + (
            "SELECT type, error, count(*) AS n FROM classified GROUP BY type, error"),
    }
    return q
