"""Lines and grid rows by file and block: order over files, quotes over blocks, manifests, working tables."""

import os
import random

import pytest

from shelfmark.functions.fields import range_cells
from shelfmark.operators.resolve import lookup_table, resolve_with_lookup
from shelfmark.operators.validate import valid_ids
from shelfmark.plans import report as P
from shelfmark.session import scratch_path, scratch_scope, shared_dir
from shelfmark.sources.lines import read_id_lines
from shelfmark.sources.sheets import (parse_range, read_grid_export, read_grid_manifest, read_grid_records, read_sheet_column,
                                      sheet_row_count)
from test_resolve import _providers


@pytest.fixture()
def small_blocks(spark):
    """Sets the sizes by which files are cut into blocks and packed into tasks."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def set_sizes(block, cost):
        spark.conf.set(names[0], block)
        spark.conf.set(names[1], cost)

    yield set_sizes
    for n, v in before.items():
        spark.conf.set(n, v)


def _write(folder, name, text):
    with open(os.path.join(folder, name), "w", newline="", encoding="utf-8") as f:
        f.write(text)


def by_hand(text):
    """Row texts of a CSV, walked letter by letter."""
    rows, row, state = [], "", "start"
    for ch in text[:-1] if text.endswith("\n") else text:
        if ch == "\n" and state != "quoted":
            rows.append(row)
            row, state = "", "start"
            continue
        row += ch
        if state == "quoted":
            state = "after" if ch == '"' else "quoted"
        elif ch == '"' and state in ("start", "after"):
            state = "quoted"
        else:
            state = "start" if ch == "," else "plain"
    return [*rows, row] if text else []


@pytest.mark.parametrize("seed", range(6))
def test_rows_equal_a_walk_by_letter(spark, tmp_dir, small_blocks, seed):
    rng = random.Random(seed)
    small_blocks(rng.choice([30, 90, 400]), rng.choice([1, 64]))
    pieces = ["a", "b,", ",", '"', '""', "\n", "x\n", '"q\nr",', '" stray, "', "\r\n", '9,5" disk\n', '"a"\n', '"open\n', "é,"]
    want = []
    for f in range(3):
        text = "".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 30, 80])))
        _write(tmp_dir, f"f{f}.csv", text)
        want += [(f"f{f}.csv", i, r) for i, r in enumerate(by_hand(text), 1)]
    got = sorted((os.path.basename(r["file"]), r["row"], r["number"], r["text"]) for r in read_grid_records(spark, tmp_dir).collect())
    assert got == [(f, i, n, r) for n, (f, i, r) in enumerate(want, 1)]


def test_stray_quote_costs_no_row(spark, tmp_dir, small_blocks):
    small_blocks(24, 1)
    _write(tmp_dir, "a.csv", 'isbn,title\n9780134190440,5" disk book\n9780132350884,"two\nlines"\n0596520689,"a ""b""\n\nc"\n043942089X,"" x" y\n')
    _write(tmp_dir, "b.csv", '0451524934,"un"quoted, end\n')
    assert [r.raw for r in read_sheet_column(spark, tmp_dir).orderBy("pos").collect()] == [
        "9780134190440", "9780132350884", "0596520689", "043942089X", "0451524934"]
    assert sheet_row_count(read_grid_export(spark, tmp_dir)).first().rows == 6
    assert [r.c0 for r in read_grid_export(spark, tmp_dir, "B2:B4").orderBy("row").collect()] == ['5" disk book', "two\nlines", 'a "b"\n\nc']


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_whose_lines_are_rows_are_numbered_in_place(spark, tmp_dir, small_blocks):
    """No window and no group: no text leaves its task."""
    small_blocks(64, 1)
    _write(tmp_dir, "a.csv", "".join(f'{k},"t, {k}"\n' for k in range(200)))
    rows = read_grid_records(spark, tmp_dir)
    assert [r.row for r in rows.orderBy("number").collect()] == list(range(1, 201))
    assert "Window" not in _plan(rows) and "Aggregate" not in _plan(rows)


def test_windows_take_a_block_at_most(spark, tmp_dir, small_blocks):
    small_blocks(64, 1)
    _write(tmp_dir, "a.csv", "".join(f'{k},"t\n{k}"\n' for k in range(50)))
    _write(tmp_dir, "b.csv", "".join(f"{k},t\n" for k in range(50)))
    rows = read_grid_records(spark, tmp_dir)
    assert [r.number for r in rows.orderBy("number").collect()] == list(range(1, 101))
    windows = [line for line in _plan(rows).splitlines() if "Window [" in line]
    assert windows and all("file#" in w.split("], [")[1] and "block#" in w.split("], [")[1] for w in windows), windows


def test_line_order_over_files_of_unequal_size(spark, tmp_dir, small_blocks):
    small_blocks(200, 1)
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    keys = ["9780134190440", "0596520689", "9780132350884"]
    files = {"a.txt": ["9780134190440"], "b.txt": [keys[i % 3] if i % 4 else "# note" for i in range(300)], "c.txt": ["", "0596520689", "bad"]}
    for name, lines in files.items():
        _write(src, name, "\n".join(lines) + "\n")
    ids = read_id_lines(spark, src)
    flat = [line for name in sorted(files) for line in files[name]]
    want = [(i, line) for i, line in enumerate(flat) if line and not line.startswith("#")]
    assert sorted((r.pos, r.raw) for r in ids.collect()) == want
    out = os.path.join(tmp_dir, "csv")
    P.write_csv(P.csv_rows(resolve_with_lookup(valid_ids(ids), lookup_table(_providers(spark)))), out)
    text = "".join(open(os.path.join(out, f)).read().split("\n", 1)[1] for f in sorted(os.listdir(out)) if f.startswith("part-"))
    assert [line.split(",")[0] for line in text.splitlines()] == [line for _, line in want if line != "bad"]


def test_manifest_gives_each_export_its_range(spark, tmp_dir):
    _write(tmp_dir, "a.csv", 'h,x\n1,"p\nq"\n2,r"\n3,s\n')
    _write(tmp_dir, "b.csv", "k,1\nl,2\n")
    _write(tmp_dir, "c.csv", "not named\n")
    manifest = spark.createDataFrame([("a.csv", "Sheet1!A2:A"), ("a.csv", "B2:B3"), ("b.csv", "Tab!B1"), ("b.csv", "A1"), ("b.csv", ""),
                                      ("d.csv", "A:A"), ("b.csv", "zz:zz")], "export STRING, range STRING")
    got = sorted(tuple(r) for r in read_grid_manifest(spark, tmp_dir, manifest).collect() if r["c0"] is not None)
    assert got == [("a.csv", 2, "1"), ("a.csv", 2, "p\nq"), ("a.csv", 3, "2"), ("a.csv", 3, 'r"'), ("a.csv", 4, "3"), ("b.csv", 1, "1")]
    assert read_grid_manifest(spark, tmp_dir, manifest.where("export = 'd.csv'")).count() == 0
    assert read_grid_manifest(spark, tmp_dir, manifest.limit(0)).count() == 0


def test_range_column_equals_range_rule(spark):
    ranges = ["Sheet1!A2:A", "A2:A100", "B:B", "Tab!B1", "$C$3:$D$9", "zzz!AZ5:BA", "'My tab'!AAA7", "A2", "", "Sheet1!", "1:2", "A2:B:C", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(ranges)], "i INT, r STRING")
    got = {x.i: None if x.c is None else tuple(x.c) for x in df.select("i", range_cells("r").alias("c")).collect()}
    for i, r in enumerate(ranges):
        try:
            assert got[i] == parse_range(r or ""), r
        except ValueError:
            assert got[i] is None, r


def test_scope_removes_working_tables(spark, tmp_dir):
    _write(tmp_dir, "a.txt", "9780134190440\n")
    folder = os.path.join(shared_dir(spark), "shelfmark", "blocks")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with scratch_scope(spark):
        assert read_id_lines(spark, tmp_dir).count() == 1
        assert set(os.listdir(folder)) > before
        with scratch_scope(spark):
            inner = scratch_path(spark, "blocks", "x", unique=True)
            spark.range(1).write.parquet(inner)
        assert not os.path.exists(inner)
    assert set(os.listdir(folder)) == before


def test_empty_files(spark, tmp_dir):
    _write(tmp_dir, "a.csv", "")
    assert read_grid_export(spark, tmp_dir).count() == 0 and read_id_lines(spark, tmp_dir).count() == 0
