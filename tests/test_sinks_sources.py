"""Sinks (text, CSV, JSON, grid, preview) and sources (lines, sheets, refs)."""

import json
import os

from shelfmark.functions.fields import extract_sheet_id, range_error
from shelfmark.plans import grid as G
from shelfmark.plans import report as P
from shelfmark.sources.lines import ids_from_values, read_id_lines
from shelfmark.sources.sheets import read_sheet_column, sheet_row_count, read_grid_export

RESULT_DDL = ("pos BIGINT, isbn STRING, provider STRING, meta STRUCT<isbn_10: STRING, isbn_13: STRING, "
              "title: STRING, authors: ARRAY<STRING>, publisher: STRING, publication_date: STRING, pages: BIGINT, "
              "categories: ARRAY<STRING>>, error STRING")

GO_BOOK = ("", "978-0134190440", "The Go Programming Language", ["Alan A. A. Donovan", "Brian W. Kernighan"],
           "Addison-Wesley", "2015-11-16", 400, ["Programming", "Computer Science"])


def _results(spark):
    return spark.createDataFrame([
        (1, "9780134190440", "provider_a", GO_BOOK, None),
        (2, "0596520689", None, None, "failed to resolve ISBN from all APIs"),
        (3, "043942089X", "provider_b", ("", "", "Say \"hi\", ok", [], "", "", 0, None), None),
    ], RESULT_DDL)


def test_text_report_exact(spark):
    blocks = [r.text for r in P.text_blocks(_results(spark)).orderBy("pos").collect()]
    assert blocks[0] == (
        "ISBN: 9780134190440\nISBN-13: 978-0134190440\nTitle: The Go Programming Language\n"
        "Authors: Alan A. A. Donovan, Brian W. Kernighan\nPublisher: Addison-Wesley\n"
        "Publication Date: 2015-11-16\nPages: 400\nCategories: Programming, Computer Science\n"
        "Status: ✓ Resolved\n\n---\n\n")
    assert blocks[1] == "ISBN: 0596520689\nStatus: ✗ Failed - failed to resolve ISBN from all APIs\n\n---\n\n"
    assert blocks[2] == 'ISBN: 043942089X\nTitle: Say "hi", ok\nStatus: ✓ Resolved\n\n---\n\n'


def test_text_writer_bytes(spark, tmp_dir):
    out = os.path.join(tmp_dir, "text")
    P.write_text(P.text_blocks(_results(spark)), out)
    data = "".join(open(os.path.join(out, f), encoding="utf-8").read()
                   for f in sorted(os.listdir(out)) if f.startswith("part-"))
    assert data.startswith("ISBN: 9780134190440\n") and data.count("\n\n---\n\n") == 3
    assert data.index("0596520689") < data.index("043942089X")


def test_csv_rows_and_writer(spark, tmp_dir):
    rows = P.csv_rows(_results(spark))
    assert rows.columns[1:] == ["ISBN", "ISBN-13", "Title", "Authors", "Publisher", "Publication Date", "Pages",
                                "Categories", "Status", "Error"]
    out = os.path.join(tmp_dir, "csv")
    P.write_csv(rows, out)
    back = P.read_csv_rows(spark, out).collect()
    assert [tuple(r) for r in back] == [
        ("9780134190440", "978-0134190440", "The Go Programming Language",
         "Alan A. A. Donovan; Brian W. Kernighan", "Addison-Wesley", "2015-11-16", "400",
         "Programming; Computer Science", "success", ""),
        ("0596520689", "0596520689", "", "", "", "", "", "", "error",
         "failed to resolve ISBN from all APIs"),
        ("043942089X", "043942089X", 'Say "hi", ok', "", "", "", "", "", "success", ""),
    ]
    text = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.startswith("part-"))
    assert '"Say ""hi"", ok"' in text                       # RFC 4180 quote doubling


def test_json_lines(spark, tmp_dir):
    lines = {r.isbn: json.loads(r.line) for r in P.json_lines(P.json_entries(_results(spark))).collect()}
    ok = lines["9780134190440"]
    assert ok["status"] == "success" and "error" not in ok and ok["data"]["isbn_13"] == "978-0134190440"
    assert "isbn_10" not in ok["data"] and ok["data"]["pages"] == 400
    assert lines["0596520689"] == {"isbn": "0596520689", "status": "error",
                                   "error": "failed to resolve ISBN from all APIs"}
    assert lines["043942089X"]["data"]["authors"] == [] and lines["043942089X"]["data"]["categories"] is None
    out = os.path.join(tmp_dir, "json")
    P.write_json(P.json_entries(_results(spark)), out)
    assert spark.read.json(out).count() == 3


def test_grid_rows_append_and_preview(spark, tmp_dir):
    rows = G.sheet_rows(_results(spark))
    first = rows.orderBy("pos").first()
    assert tuple(first)[1:] == ("978-0134190440", "The Go Programming Language",
                                "Alan A. A. Donovan, Brian W. Kernighan", "Addison-Wesley", "2015-11-16", "400",
                                "Programming, Computer Science", "Success", "")
    target = os.path.join(tmp_dir, "grid")
    G.write_grid(rows, target)
    G.write_grid(rows, target, mode="append")
    assert G.read_grid(spark, target).count() == 6
    report = G.preview_report(rows)
    assert report[0] == "Would write 4 rows:" and report[2].startswith("Row 1: [ISBN-13 Title")
    assert len([x for x in report if x.startswith("Row ")]) == 4 and not report[-1].startswith("...")


def test_grid_table_create_if_missing(spark):
    rows = G.sheet_rows(_results(spark), keep=())
    name = "grid_append_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    G.write_grid(rows, name, mode="append", as_table=True)     # creates the tab
    G.write_grid(rows, name, mode="append", as_table=True)     # appends
    assert spark.table(name).count() == 6
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_line_file_scan(spark, tmp_dir):
    path = os.path.join(tmp_dir, "ids.txt")
    with open(path, "w", encoding="utf-8") as f:
        f.write("# header\n978-0134190440\n\n  0-596-52068-9\t\r\n   \n9780132350884\r\n#x\n　0451524934\n")
    got = [r.raw for r in read_id_lines(spark, path).orderBy("pos").collect()]
    assert got == ["978-0134190440", "0-596-52068-9", "9780132350884", "0451524934"]


def test_literal_values_untrimmed(spark):
    assert [r.raw for r in ids_from_values(spark, [" 1", "#2"]).collect()] == [" 1", "#2"]


def test_sheet_cells(spark, tmp_dir):
    path = os.path.join(tmp_dir, "grid.csv")
    with open(path, "w") as f:
        f.write('ISBN,Title\nisbn-13\nISBN Number,x\n,\n" 978.0134190440 ",y\nisbn 13\n". - ",z\n')
    grid = read_grid_export(spark, path)
    assert sheet_row_count(grid).first().rows == 7
    got = [r.raw for r in read_sheet_column(spark, path).orderBy("pos").collect()]
    assert got == ["9780134190440", "isbn13"]


def test_sheet_id_and_range(spark):
    url = "https://docs.google.com/spreadsheets/d/1BxiMVs0XRA5nFMdKvBdBZjgmUUqptlbs74OgvE2upms/edit"
    df = spark.createDataFrame([(url,), (url + "#gid=0",), ("1BxiMVs0XRA5nFMdKvBdBZjgmUUqptlbs74OgvE2upms",)],
                               "u STRING")
    assert {r[0] for r in df.select(extract_sheet_id("u")).collect()} == {
        "1BxiMVs0XRA5nFMdKvBdBZjgmUUqptlbs74OgvE2upms"}
    rng = spark.createDataFrame([("Sheet1!A2:A",), ("A2:A100",), ("A:A",), ("A2",), ("",)], "r STRING")
    got = [r[0] for r in rng.select(range_error("r")).collect()]
    assert got[:3] == [None, None, None]
    assert got[3] == "invalid range format: A2 (use A1 notation like 'A2:A' or 'Sheet1!A2:A')"
    assert got[4] == "range cannot be empty"


def test_numeric_identifier_column(spark):
    from shelfmark.sources.lines import ids_from_column

    df = spark.createDataFrame([(1, 9780134190440.0, 596520689)], "k INT, d DOUBLE, n BIGINT")
    assert ids_from_column(df, "d", pos="k").first().raw == "9780134190440"
    assert ids_from_column(df, "n", pos="k").first().raw == "596520689"   # leading zero lost


def test_snapshot_without_fetch_times(spark, tmp_dir):
    from shelfmark.operators.providers import latest_response, parse_provider_a
    from shelfmark.sources.snapshots import read_snapshot

    path = os.path.join(tmp_dir, "snap")
    spark.createDataFrame([("1", 200, '{"ISBN:1":{"title":"T"}}')], "isbn STRING, status_code INT, body STRING") \
        .write.parquet(path)
    r = latest_response(parse_provider_a(read_snapshot(spark, path))).first()
    assert r.hit and r.meta.title == "T"


def test_json_read_back_with_fixed_schema(spark, tmp_dir):
    entries = P.json_entries(_results(spark))
    out = os.path.join(tmp_dir, "json_rb")
    P.write_json(entries, out)                      # pos orders the lines and is not written
    expected = entries.drop("pos")
    back = spark.read.schema(expected.schema).json(out)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, expected.collect()))


def test_empty_input_guard(spark):
    import pytest

    from shelfmark.operators.validate import require_rows, valid_ids

    ids = ids_from_values(spark, ["bad", "12"])
    with pytest.raises(ValueError, match="No valid ISBNs"):
        require_rows(valid_ids(ids), "No valid ISBNs to process")


def test_sheet_guards(spark, tmp_dir):
    import pytest

    path = os.path.join(tmp_dir, "headers.csv")
    with open(path, "w") as f:
        f.write("ISBN\n\nisbn-13\n")
    with pytest.raises(ValueError, match="no valid ISBNs found in range"):
        read_sheet_column(spark, path, require=True)
    assert read_sheet_column(spark, path).count() == 0


def test_grid_export_keeps_rows_whole(spark, tmp_dir):
    path = os.path.join(tmp_dir, "grid")
    os.makedirs(path)
    with open(os.path.join(path, "a.csv"), "w") as f:
        f.write('Title,ISBN,ISBN\n\n"A ""book"", with\na break",9780134190440,0596520689\r\n\nx,"9780132350884\n",\n')
    with open(os.path.join(path, "b.csv"), "w") as f:
        f.write(",043942089X\n")
    grid = read_grid_export(spark, path)
    assert [(r.row, r.c0) for r in grid.orderBy("row").collect()] == [
        (1, "Title"), (2, None), (3, 'A "book", with\na break'), (4, None), (5, "x"), (6, None)]
    assert sheet_row_count(grid).first().rows == 6
    col_b = read_grid_export(spark, path, "Sheet1!B2:B")
    assert [(r.row, r.c0) for r in col_b.orderBy("row").collect()] == [
        (2, None), (3, "9780134190440"), (4, None), (5, "9780132350884\n"), (6, "043942089X")]
    assert [r.raw for r in read_sheet_column(spark, path, a1="C:C").orderBy("pos").collect()] == ["0596520689"]
    assert [r.row for r in read_grid_export(spark, path, "B3:B4").orderBy("row").collect()] == [3, 4]
    assert [r.c0 for r in read_grid_export(spark, path, "Tab!B6").collect()] == ["043942089X"]


def test_grid_export_rejects_unusable_ranges(spark, tmp_dir):
    import pytest

    for bad in ("", "A2", "Sheet1!", "1:2", "A2:B:C"):
        with pytest.raises(ValueError, match="range"):
            read_grid_export(spark, tmp_dir, bad)


def test_numbers_out_of_range_become_rejects(spark):
    from shelfmark.operators.validate import rejected_ids, valid_ids
    from shelfmark.sources.lines import ids_from_column

    ids = ids_from_column(spark.createDataFrame([(1, 1e25), (2, float("nan")), (3, 9780134190440.0), (4, None)], "k INT, d DOUBLE"), "d", pos="k")
    assert [r.pos for r in valid_ids(ids).collect()] == [3]
    assert sorted(r.pos for r in rejected_ids(ids).collect()) == [1, 2]


def test_json_members_inside_values_stay(spark):
    odd = 'x,"error":null "isbn_10":null, ,"data":null'
    df = spark.createDataFrame([(1, "9780134190440", "provider_a", ("", "", odd, None, "", "", 0, None), None),
                                (2, "0596520689", None, None, odd)], RESULT_DDL)
    got = [json.loads(r.line) for r in P.json_lines(P.json_entries(df)).orderBy("pos").collect()]
    assert got[0]["data"]["title"] == odd and got[1]["error"] == odd and got[0]["data"]["authors"] is None
    assert "isbn_10" not in got[0]["data"] and "error" not in got[0] and "data" not in got[1]
