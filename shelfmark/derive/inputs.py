"""Inputs derived from the driver's tables (none of them holds an ISBN).

Identifiers come from ``orders`` (one per order, shape by key) or, for
volume, ``lineitem``; provider snapshots are JSON bodies built from
``part``. Everything is Spark column arithmetic over whole tables, so the
work grows with the tables. The same rules are restated in DuckDB SQL by
``oracle.py``, which computes the expected results without parsing JSON.

Book number ``b`` -> ``b9`` (9 digits, zero padded) -> ISBN-10 ``b9 + c10``
(``X`` for 10) and ISBN-13 ``'978' + b9 + c13``.
"""

from __future__ import annotations

import hashlib
import os
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .._util import with_once
from ..session import path_exists, scratch_path

def _code_tag() -> str:
    """Hash of the package source: any change to a derivation rule or to the
    parsing code behind a cached table gives new paths, never a stale copy."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.sha1()
    for folder, _, files in sorted(os.walk(root)):
        for name in sorted(f for f in files if f.endswith(".py")):
            with open(os.path.join(folder, name), "rb") as fh:
                h.update(name.encode() + fh.read())
    return h.hexdigest()[:10]


DERIVE_VERSION = _code_tag()

# Orders decorated in the line file / sheet export, and extra rows.
LINE_DECOR = 5
SHEET_DECOR = 7
SHEET_HEADER_WORDS = ("ISBN", "isbn-13", "ISBN Number", "Isbn-10")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _digits(b: Column) -> list[Column]:
    return [(F.floor(b / F.lit(10 ** (8 - i))) % 10).cast("int") for i in range(9)]


def _checked(b: Column) -> dict[str, Column]:
    """Nine digits and both check digits of book ``b`` (< 10**9)."""
    d = _digits(b)
    s10 = sum((d[i] * (10 - i) for i in range(1, 9)), d[0] * 10)
    c10 = (F.lit(11) - s10 % 11) % 11
    s13 = sum((d[i] * (3 if i % 2 == 0 else 1) for i in range(1, 9)), F.lit(38) + d[0] * 3)
    return {"b9": F.lpad(b.cast("string"), 9, "0"), "c10": F.when(c10 == 10, F.lit("X")).otherwise(c10.cast("string")),
            "c13": (F.lit(10) - s13 % 10) % 10}


def _keys(b9: Column, c10: Column, c13: Column) -> dict[str, Column]:
    """The key forms made of what ``_checked`` gives."""
    return {
        "b9": b9, "c10": c10, "c13": c13.cast("string"),
        "k10": F.concat(b9, c10), "k13": F.concat(F.lit("978"), b9, c13.cast("string")),
        "bad13": F.concat(F.lit("978"), b9, ((c13 + 1) % 10).cast("string")),
    }


def book_keys(b: Column) -> dict[str, Column]:
    """Numeric derivation of the two key forms of book ``b`` (< 10**9)."""
    return _keys(**_checked(b))


def _shaped(k: dict[str, Column], shape: Column) -> Column:
    b9 = k["b9"]
    parts = [F.substring(b9, 1, 1), F.substring(b9, 2, 3), F.substring(b9, 5, 5)]
    return (
        F.when(shape == 0, k["k13"])
        .when(shape == 1, F.concat_ws("-", F.lit("978"), *parts, k["c13"]))
        .when(shape == 2, k["k10"])
        .when(shape == 3, F.concat_ws(" ", *parts, k["c10"]))
        .when(shape == 4, k["bad13"])
        .when(shape == 5, F.concat(F.lit("978"), b9))
        .when(shape == 6, F.concat(F.lit("999"), b9, k["c13"]))
        .otherwise(F.lower(k["k10"]))
    )


def _with_digits(df: DataFrame, b: Column) -> DataFrame:
    """``df`` with what ``_checked`` gives for ``b``, each once per row.

    All shapes with all digits in one expression are a method too long for
    the JVM to compile.
    """
    for name, value in _checked(b).items():
        df = with_once(df, value, name)
    return df


def _with_raw(numbers: DataFrame) -> DataFrame:
    """``(pos, raw)`` of ``(pos, book, shape)``."""
    df = _with_digits(numbers, F.col("book"))
    return df.select("pos", _shaped(_keys(F.col("b9"), F.col("c10"), F.col("c13")), F.col("shape")).alias("raw"))


def raw_ids_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("book"), (F.col("o_orderkey") % 8).alias("shape"))


def raw_ids_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_ids(pos, raw)``: one identifier per order, 8 shapes by key."""
    return _with_raw(raw_ids_numbers(spark, sf_dir))


def raw_ids_large_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_ids_large(pos, raw)`` from lineitem; ``pos`` is not unique."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.col("l_partkey").alias("book"),
                     ((F.col("l_orderkey") + F.col("l_linenumber")) % 8).alias("shape"))


# Book that a third of the skewed input rows refer to.
HOT_BOOK = 7


def raw_ids_skewed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_ids_skewed(pos, raw)`` from lineitem: every third order refers
    to one hot book, so a handful of keys hold a third of all rows."""
    li = table(spark, sf_dir, "lineitem")
    book = F.when(F.col("l_orderkey") % 3 == 0, F.lit(HOT_BOOK)).otherwise(F.col("l_partkey"))
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), book.alias("book"),
                     ((F.col("l_orderkey") + F.col("l_linenumber")) % 8).alias("shape"))


def id_lines_skewed_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skewed ids as text lines."""
    return load(spark, sf_dir, "raw_ids_skewed").select("pos", F.col("raw").alias("value"))


# Book that all rows of the identical input refer to.
SAME_BOOK = 1


def raw_ids_identical_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_ids_identical(raw)``: the same identifier for every lineitem row,
    and no other column."""
    return table(spark, sf_dir, "lineitem").select(_shaped(book_keys(F.lit(SAME_BOOK)), F.lit(1)).alias("raw"))


def _jstr(c: Column) -> Column:
    """A JSON string literal for ``c`` (quoted and escaped)."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def _book_fields(p: DataFrame) -> DataFrame:
    p = _with_digits(p.select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), F.col("p_partkey"))
    k = _keys(F.col("b9"), F.col("c10"), F.col("c13"))
    p = with_once(with_once(p, k["k10"], "k10"), k["k13"], "k13")
    return p.select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "k10", "k13",
        F.concat(F.lit("Writer "), (F.col("p_partkey") % 101).cast("string")).alias("w1"),
        F.concat(F.lit("Writer "), (F.col("p_partkey") % 89 + 100).cast("string")).alias("w2"),
        (F.col("p_partkey") % 70 + 1950).cast("string").alias("year"),
        F.concat(F.lit("Size "), F.col("p_size").cast("string")).alias("subj2"),
        F.timestamp_seconds(F.col("p_partkey") + F.lit(1735689600)).alias("ts"),
    )


def snapshot_a_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider A responses for every book, both key forms.

    Books ``p % 5 in (0, 1)`` are known; the others got a 404. Variant ``va = (p div 5) % 8``: 0 full; 1 latest is a 404 (an older 200
    exists and must not be used); 2 truncated JSON; 3 member null; 4 empty
    object (hit, blanks); 5 wrong-typed members; 6 mixed arrays and a
    fractional page count; 7 full, with an older superseded response.
    """
    p = _book_fields(table(spark, sf_dir, "part")).withColumn("known", F.col("p_partkey") % 5 < 2)
    p = p.withColumn("va", (F.floor(F.col("p_partkey") / 5) % 8).cast("int"))
    keyed = p.withColumn("isbn", F.explode(F.array("k13", "k10")))
    key = F.col("isbn")
    good = F.format_string(
        '{"ISBN:%s":{"title":%s,"authors":[{"name":%s},{"name":%s}],"publishers":[{"name":%s}],'
        '"publish_date":%s,"number_of_pages":%d,"subjects":[{"name":%s},{"name":%s}]}}',
        key, _jstr(F.col("p_name")), _jstr(F.col("w1")), _jstr(F.col("w2")), _jstr(F.col("p_brand")),
        _jstr(F.col("year")), F.col("p_size"), _jstr(F.col("p_type")), _jstr(F.col("subj2")))
    old = F.format_string('{"ISBN:%s":{"title":%s}}', key, _jstr(F.concat(F.lit("OLD "), F.col("p_name"))))
    va = F.col("va")
    body = (
        F.when(va.isin(0, 1, 7), good)
        .when(va == 2, F.format_string('{"ISBN:%s":{"title":%s', key, _jstr(F.col("p_name"))))
        .when(va == 3, F.format_string('{"ISBN:%s":null}', key))
        .when(va == 4, F.format_string('{"ISBN:%s":{}}', key))
        .when(va == 5, F.format_string(
            '{"ISBN:%s":{"title":%d,"number_of_pages":"%d","authors":"zz","publishers":[{"name":%s}],'
            '"publish_date":%s,"subjects":[{"name":%s}]}}',
            key, F.col("p_size"), F.col("p_size"), _jstr(F.col("p_brand")), F.col("year"), _jstr(F.col("p_type"))))
        .otherwise(F.format_string(
            '{"ISBN:%s":{"title":%s,"number_of_pages":%d.9,"authors":[{"name":%s},{"x":1},"s",{"name":5},'
            '{"name":%s}],"publishers":[{"q":1},{"name":"P2"}],"subjects":[]}}',
            key, _jstr(F.col("p_name")), F.col("p_size"), _jstr(F.col("w1")), _jstr(F.col("w2"))))
    )
    latest = keyed.select("isbn", F.when((va == 1) | ~F.col("known"), 404).otherwise(200).alias("status_code"),
                          F.when(F.col("known"), body).otherwise(F.lit("not found")).alias("body"),
                          F.col("ts").alias("fetched_at"))
    older = keyed.where(F.col("known") & va.isin(1, 7)).select(
        "isbn", F.lit(200).alias("status_code"), old.alias("body"),
        (F.col("ts") - F.expr("INTERVAL 1 DAY")).alias("fetched_at"))
    return latest.unionByName(older)


def snapshot_b_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider B responses for every book, both key forms.

    Books ``p % 5 in (1, 2, 3)`` are known; the others got an answer without
    items. Variant ``vb = (p div 5) % 9``: 0 full; 1 status 500; 2 no items;
    3 ``totalItems`` 1 with an empty list; 4 string page count (strict
    decode fails); 5 null title (hit, blanks); 6 two items, repeated ISBN_13
    (last wins); 7 second item with a numeric language (fails); 8 empty
    author list, a null category, ISBN_10 only.
    """
    p = _book_fields(table(spark, sf_dir, "part"))
    known = (F.col("p_partkey") % 5).between(1, 3)
    p = p.withColumn("vb", F.when(known, F.floor(F.col("p_partkey") / 5) % 9).otherwise(2).cast("int"))
    keyed = p.withColumn("isbn", F.explode(F.array("k13", "k10")))
    date = F.concat_ws("-", F.col("year"), F.lpad((F.col("p_partkey") % 12 + 1).cast("string"), 2, "0"), F.lit("01"))
    vol = lambda pages_fmt: F.format_string(
        '{"title":%s,"authors":[%s,%s],"publisher":%s,"publishedDate":%s,"pageCount":' + pages_fmt + ','
        '"language":"en","categories":[%s],"industryIdentifiers":[{"type":"ISBN_10","identifier":%s},'
        '{"type":"ISBN_13","identifier":%s}]}',
        _jstr(F.col("p_name")), _jstr(F.col("w1")), _jstr(F.col("w2")), _jstr(F.col("p_brand")), _jstr(date),
        F.col("p_size"), _jstr(F.col("p_type")), _jstr(F.col("k10")), _jstr(F.col("k13")))
    wrap = lambda total, items: F.format_string('{"kind":"books#volumes","totalItems":%d,"items":[%s]}',
                                                F.lit(total), items)
    vb = F.col("vb")
    # One after the other, so that no method gets too long to be compiled.
    keyed = with_once(keyed, F.when(vb.isin(0, 1, 7), vol("%d")), "plain")
    keyed = with_once(keyed, F.when(vb == 4, vol('"%d"')).otherwise(F.col("plain")), "vol")
    keyed = with_once(keyed, F.when(vb == 6, wrap(2, F.format_string(
        '{"volumeInfo":{"title":%s,"authors":[%s],"pageCount":%d,"industryIdentifiers":['
        '{"type":"ISBN_13","identifier":"0000000000000"},{"type":"ISBN_13","identifier":%s}]}},'
        '{"volumeInfo":{"title":"second","language":"de"}}',
        _jstr(F.col("p_name")), _jstr(F.col("w1")), F.col("p_size"), _jstr(F.col("k13"))))), "two")
    body = (
        F.when(vb.isin(0, 1), wrap(1, F.format_string('{"volumeInfo":%s}', F.col("vol"))))
        .when(vb == 2, F.lit('{"kind":"books#volumes","totalItems":0}'))
        .when(vb == 3, F.lit('{"totalItems":1,"items":[]}'))
        .when(vb == 4, wrap(1, F.format_string('{"volumeInfo":%s}', F.col("vol"))))
        .when(vb == 5, F.lit('{"totalItems":1,"items":[{"volumeInfo":{"title":null,'
                             '"industryIdentifiers":[{"type":"OTHER","identifier":"x"}]}}]}'))
        .when(vb == 6, F.col("two"))
        .when(vb == 7, wrap(2, F.format_string('{"volumeInfo":%s},{"volumeInfo":{"language":7}}', F.col("vol"))))
        .otherwise(wrap(3, F.format_string(
            '{"volumeInfo":{"title":%s,"authors":[],"categories":[%s,null],"pageCount":0,'
            '"industryIdentifiers":[{"type":"ISBN_10","identifier":%s}]}}',
            _jstr(F.col("p_name")), _jstr(F.col("p_type")), _jstr(F.col("k10")))))
    )
    return keyed.select("isbn", F.when(vb == 1, 500).otherwise(200).alias("status_code"),
                        body.alias("body"), F.col("ts").alias("fetched_at"))


def _line_decor(k: Column, raw: Column) -> Column:
    return (
        F.when(k % LINE_DECOR == 0, raw)
        .when(k % LINE_DECOR == 1, F.concat(F.lit("  "), raw))
        .when(k % LINE_DECOR == 2, F.concat(raw, F.lit("\t")))
        .when(k % LINE_DECOR == 3, F.concat(raw, F.lit("\r")))
        .otherwise(F.concat(F.lit("\u3000"), raw, F.lit(" ")))
    )


def id_lines_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of an identifier file: ids with edge white space, CR line
    ends, comment, blank and space-only lines (``value`` column)."""
    r = raw_ids_expr(spark, sf_dir)
    k = F.col("pos")
    extra = (
        F.when(k % 10 == 0, F.concat(F.lit("# comment "), k.cast("string")))
        .when(k % 10 == 5, F.lit("   "))
        .when(k % 10 == 7, F.lit(""))
    )
    lines = F.filter(F.array(extra, _line_decor(k, F.col("raw"))), lambda x: x.isNotNull())
    return r.select(k.alias("pos"), F.posexplode(lines).alias("idx", "value"))


def decorated_ids_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pos, raw)`` with the line decorations kept (literal-value input)."""
    r = raw_ids_expr(spark, sf_dir)
    return r.select("pos", _line_decor(F.col("pos"), F.col("raw")).alias("raw"))


def sheet_grid_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a grid export (CSV text, ids in column C): one decorated id per
    order, and at fixed keys header, punctuation-only and 'isbn 13' cells,
    empty lines, and before it a quoted cell with a line break and a comma, or
    one that is not quoted and holds stray quotes."""
    r = raw_ids_expr(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), "o_orderstatus")
    g = r.join(o, "pos")
    k = F.col("pos")
    cell = (
        F.when(k % SHEET_DECOR == 0, F.col("raw"))
        .when(k % SHEET_DECOR == 1, F.concat(F.lit(" "), F.col("raw"), F.lit(" ")))
        .when(k % SHEET_DECOR == 2, F.regexp_replace(F.col("raw"), "-", "."))
        .when(k % SHEET_DECOR == 3, F.concat(F.lit("\t"), F.col("raw")))
        .when(k % SHEET_DECOR == 4, F.regexp_replace(F.col("raw"), "(...)", "$1 "))
        .when(k % SHEET_DECOR == 5, F.concat(F.col("raw"), F.lit(".")))
        .otherwise(F.col("raw"))
    )
    words = F.array(*[F.lit(w) for w in SHEET_HEADER_WORDS])
    extra = (
        F.when(k % 50 == 0, F.element_at(words, (F.floor(k / 50) % len(SHEET_HEADER_WORDS) + 1).cast("int")))
        .when(k % 50 == 10, F.lit(". - "))
        .when(k % 50 == 40, F.lit("isbn 13"))
    )
    second = F.when(k % 11 == 3, F.concat(F.lit('"status ""'), F.col("o_orderstatus"), F.lit('""\nof, the order"'))) \
        .when(k % 13 == 6, F.concat(F.lit('5" of "'), F.col("o_orderstatus"))).otherwise(F.col("o_orderstatus"))
    lines = F.filter(F.array(F.when(k % 50 == 25, F.lit("")), F.concat(F.lit("x,y,"), extra),
                             F.concat(F.lit("order,"), second, F.lit(","), cell)), lambda x: x.isNotNull())
    return g.select(k.alias("pos"), F.posexplode(lines).alias("idx", "value"))


# Exports that the orders are dealt to, one file each.
EXPORTS = 24


def sheet_exports_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``EXPORTS`` grid exports, ids in column A: order ``k`` is a row of export ``k % EXPORTS``; column B
    holds its status with stray quotes, or quoted with a line break."""
    r = raw_ids_expr(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), "o_orderstatus")
    k = F.col("pos")
    second = F.when(k % 5 == 1, F.concat(F.lit('"status\n""'), F.col("o_orderstatus"), F.lit('"""'))) \
        .when(k % 7 == 2, F.concat(F.col("o_orderstatus"), F.lit('"'))).otherwise(F.col("o_orderstatus"))
    return r.join(o, "pos").select("pos", (k % EXPORTS).cast("int").alias("export"), F.concat_ws(",", "raw", second).alias("value"))


def job_manifest_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``job_manifest(job_id, sheet_ref, range)`` from ``pages``."""
    pg = table(spark, sf_dir, "pages")
    j = F.col("page_id")
    sid = F.concat(F.lit("1B"), F.upper(F.substring(F.md5(F.col("url")), 1, 10)), F.lit("-"),
                   j.cast("string"), F.lit("_x"))
    ref = (
        F.when(j % 4 == 0, F.concat(F.lit("https://docs.google.com/spreadsheets/d/"), sid, F.lit("/edit")))
        .when(j % 4 == 1, F.concat(F.lit("https://docs.google.com/spreadsheets/d/"), sid, F.lit("/edit#gid=0")))
        .when(j % 4 == 2, sid)
        .otherwise(F.col("url"))
    )
    rng = (
        F.when(j % 6 == 0, F.lit("Sheet1!A2:A"))
        .when(j % 6 == 1, F.concat(F.lit("A2:A"), (j + 1).cast("string")))
        .when(j % 6 == 2, F.lit("A:A"))
        .when(j % 6 == 3, F.concat(F.lit("A"), j.cast("string")))
        .when(j % 6 == 4, F.lit(""))
        .otherwise(F.lit("Tab!B1"))
    )
    return pg.select(j.alias("job_id"), ref.alias("sheet_ref"), rng.alias("range"))


# --- materialisation -------------------------------------------------------

# name -> (builder, format, layout key or None)
_BUILDERS = {
    "raw_ids": (raw_ids_numbers, "parquet", "pos"),
    "raw_ids_large": (raw_ids_large_numbers, "parquet", "pos"),
    "decorated_ids": (decorated_ids_expr, "parquet", "pos"),
    "raw_ids_skewed": (raw_ids_skewed_numbers, "parquet", "pos"),
    "raw_ids_identical": (raw_ids_identical_expr, "parquet", None),
    "snapshot_a": (snapshot_a_expr, "parquet", "isbn"),
    "snapshot_b": (snapshot_b_expr, "parquet", "isbn"),
    "id_lines": (id_lines_expr, "text", "pos"),
    "id_lines_skewed": (id_lines_skewed_expr, "text", "pos"),
    "sheet_grid": (sheet_grid_expr, "text", "pos"),
    "sheet_exports": (sheet_exports_expr, "exports", "pos"),
    "job_manifest": (job_manifest_expr, "parquet", "job_id"),
}
# Tables built as numbers that are put in place first and written out as text then: the ranges are
# cut from a sample that scans what is dealt, and numbers are cheaper to make and to deal.
_FINISH = {"raw_ids": _with_raw, "raw_ids_large": _with_raw, "raw_ids_skewed": _with_raw}
_LOCK = threading.RLock()  # re-entrant: a build may materialise its own inputs


def register(name: str, build, fmt: str = "parquet", key: str | None = "isbn") -> None:
    """Add a table built by ``build(spark, sf_dir)`` to what ``materialize`` can write."""
    _BUILDERS[name] = (build, fmt, key)


def _layout(spark: SparkSession, df: DataFrame, key: str | None) -> DataFrame:
    """As many files as the session has shuffle partitions, which is the
    setting that follows the size of the data. Ordered inputs keep their key
    order (range partitions, sorted within); snapshots are hashed by key."""
    if key is None:
        return df
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if key == "isbn":
        return df.repartition(n, key)
    order = [key] + [c for c in ("idx",) if c in df.columns]
    return df.repartitionByRange(n, key).sortWithinPartitions(*order)


def _content_tag(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the source tables' files: changed tables get new derived ones."""
    files = None
    for name in ("orders", "lineitem", "part", "pages"):
        listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                  .load(f"{sf_dir.rstrip('/')}/{name}.parquet").select("path", "modificationTime", "length"))
        files = listed if files is None else files.unionByName(listed)
    mark = F.pmod(F.xxhash64("path", "modificationTime", "length"), F.lit(1 << 40))
    r = files.agg(F.sum(mark).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return f"{r['n']}-{r['s']}"


def derived_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    tag = hashlib.sha1(f"{sf_dir} {_content_tag(spark, sf_dir)}".encode()).hexdigest()[:10]
    return scratch_path(spark, "derived", f"{DERIVE_VERSION}-{tag}", name)


def materialize(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Write a derived input once into the shared folder and return its path.

    A written table cuts the lineage (derived expressions are not inlined
    into every later plan) and survives executor loss. A marker table is
    written after the data, so an interrupted copy is rewritten.
    """
    path = derived_path(spark, sf_dir, name)
    with _LOCK:
        if _complete(spark, path):
            return path
        build, fmt, key = _BUILDERS[name]
        df = build(spark, sf_dir) if fmt == "exports" else _layout(spark, build(spark, sf_dir), key)
        df = _FINISH[name](df) if name in _FINISH else df
        if fmt == "exports":   # a folder with one file for each export, as each is written by one task
            (df.repartition(EXPORTS, "export").sortWithinPartitions("export", key).select("export", "value")
             .write.mode("overwrite").option("lineSep", "\n").partitionBy("export").text(path))
        elif fmt == "text":
            df.select("value").write.mode("overwrite").option("lineSep", "\n").text(path)
        else:
            df.write.mode("overwrite").parquet(path)
        _mark_complete(spark, path)
    return path


def _marker(path: str) -> str:
    return path.rstrip("/") + ".complete"


def _complete(spark: SparkSession, path: str) -> bool:
    """True if ``path`` was written completely (its marker table is there, and complete)."""
    return path_exists(spark, _marker(path) + "/_SUCCESS")


def _mark_complete(spark: SparkSession, path: str) -> None:
    spark.range(1).write.mode("overwrite").parquet(_marker(path))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The materialised derived table as a DataFrame."""
    path = materialize(spark, sf_dir, name)
    return spark.read.parquet(path) if _BUILDERS[name][1] == "parquet" else spark.read.text(path)
