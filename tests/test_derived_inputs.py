import re

import pytest
from pyspark.sql import functions as F

from shelfmark.derive import inputs as D

# HotSpot does not compile a method with more bytecode than this: it is interpreted for every row.
JIT_LIMIT = 8000


def _longest_method(spark, df) -> int:
    df.createOrReplaceTempView("derived_input")
    text = spark.sql("EXPLAIN CODEGEN SELECT * FROM derived_input").first()[0]
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text))


def _tables(spark, folder):
    """lineitem, orders and part with a few rows, null keys among them."""
    n = spark.range(48)
    key = F.when(F.col("id") != 5, F.col("id"))
    n.select(key.alias("l_orderkey"), (F.col("id") * 7919).alias("l_partkey"), (F.col("id") % 7).cast("int").alias("l_linenumber")) \
        .write.parquet(f"{folder}/lineitem.parquet")
    n.select(key.alias("o_orderkey"), F.when(F.col("id") != 8, F.col("id") * 104729).alias("o_custkey"), F.lit("O").alias("o_orderstatus")) \
        .write.parquet(f"{folder}/orders.parquet")
    n.select(F.col("id").alias("p_partkey"), F.lit('a "name"').alias("p_name"), F.lit("brand").alias("p_brand"),
             F.lit("type").alias("p_type"), F.col("id").cast("int").alias("p_size")).write.parquet(f"{folder}/part.parquet")
    n.select(F.col("id").alias("page_id"), F.lit("u").alias("url")).write.parquet(f"{folder}/pages.parquet")


def _isbn(book, shape):
    """The shapes restated in Python."""
    b9 = f"{book:09d}"
    d = [int(x) for x in b9]
    c10 = (11 - sum((10 - i) * x for i, x in enumerate(d)) % 11) % 11
    c10 = "X" if c10 == 10 else str(c10)
    c13 = (10 - (38 + sum((3 if i % 2 == 0 else 1) * x for i, x in enumerate(d))) % 10) % 10
    parts = [b9[0], b9[1:4], b9[4:9]]
    return [f"978{b9}{c13}", "-".join(["978", *parts, str(c13)]), b9 + c10, " ".join([*parts, c10]),
            f"978{b9}{(c13 + 1) % 10}", "978" + b9, f"999{b9}{c13}", (b9 + c10).lower()][shape]


@pytest.mark.parametrize("name", ["raw_ids", "raw_ids_large", "raw_ids_skewed"])
def test_identifiers_are_made_by_methods_the_jvm_compiles(spark, tmp_dir, name):
    _tables(spark, tmp_dir)
    build = D._BUILDERS[name][0]
    assert _longest_method(spark, D._FINISH[name](build(spark, tmp_dir))) <= JIT_LIMIT


def test_provider_bodies_are_made_by_methods_the_jvm_compiles(spark, tmp_dir):
    _tables(spark, tmp_dir)
    assert _longest_method(spark, D.snapshot_a_expr(spark, tmp_dir)) <= JIT_LIMIT
    assert _longest_method(spark, D.snapshot_b_expr(spark, tmp_dir)) <= JIT_LIMIT


def test_identifiers_and_their_lines_hold_every_row(spark, tmp_dir):
    _tables(spark, tmp_dir)
    rows = [(r["pos"], r["raw"]) for r in D.load(spark, tmp_dir, "raw_ids_skewed").collect()]
    expected = []
    for i in range(48):
        if i == 5:
            continue
        expected.append((i * 8 + i % 7, _isbn(D.HOT_BOOK if i % 3 == 0 else i * 7919, (i + i % 7) % 8)))
    assert sorted(r for r in rows if r[0] is not None) == sorted(expected)
    assert len(rows) == 48   # the row without an order is there too
    lines = [r["value"] for r in spark.read.text(D.materialize(spark, tmp_dir, "id_lines_skewed")).collect()]
    assert sorted(lines) == sorted(r[1] for r in rows)


def test_a_row_without_a_book_has_what_it_had(spark, tmp_dir):
    _tables(spark, tmp_dir)
    raw = {r["pos"]: r["raw"] for r in D.load(spark, tmp_dir, "raw_ids").collect()}
    assert raw[8] is None and len(raw) == 48
    assert raw[9] == _isbn(9 * 104729, 1)
