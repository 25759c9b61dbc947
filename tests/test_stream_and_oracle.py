"""Streaming equals batch; every registered query matches its DuckDB oracle."""

import os

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck
from shelfmark.derive import inputs as D
from shelfmark.operators.resolve import resolve
from shelfmark.operators.validate import valid_ids
from shelfmark.plans import report as P
from shelfmark.plans.registry import QUERIES, _providers
from shelfmark.sources.lines import read_id_lines

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    streamed = sorted(tuple(r) for r in QUERIES["stream_resolve"](spark, SF).collect())
    ids = read_id_lines(spark, D.materialize(spark, SF, "id_lines"))
    batch = P.csv_rows(resolve(valid_ids(ids), _providers(spark, SF)), keep=())
    assert streamed == sorted(tuple(r) for r in batch.collect())
    assert len(streamed) > 0


def test_stream_takes_several_micro_batches(spark, tmp_dir):
    from shelfmark.plans.registry import _bucketed_lookup
    from shelfmark.streaming.ids import resolve_stream

    out = f"{tmp_dir}/out"
    q = resolve_stream(spark, D.materialize(spark, SF, "id_lines"), _bucketed_lookup(spark, SF), out, f"{tmp_dir}/rejects",
                       f"{tmp_dir}/checkpoint", max_files_per_trigger=2)
    q.awaitTermination()
    assert len([d for d in os.listdir(out) if d.startswith("epoch=")]) >= 3


def test_changed_tables_get_new_derived_paths(spark, tmp_dir):
    for name in ("orders", "lineitem", "part", "pages"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_dir}/{name}.parquet")
    first = D.derived_path(spark, tmp_dir, "raw_ids")
    assert first == D.derived_path(spark, tmp_dir, "raw_ids")
    spark.read.parquet(f"{SF}/orders.parquet").limit(5).write.mode("append").parquet(f"{tmp_dir}/orders.parquet")
    assert first != D.derived_path(spark, tmp_dir, "raw_ids")


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["pos", "ISBN", "ISBN-13"] and df.count() > 0


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_oracle_parity(spark, con, name):
    ok, msg = compare(spark, SF, name, E.queries()[name], E.oracle_sql()[name], con)
    assert ok, msg


def test_every_query_has_oracle():
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def test_oracle_column_types_match(spark, con):
    """Same column names and types on both sides (not only equal values)."""
    for name in E.oracle_sql():
        q = E.queries()[name]
        spark_types = {f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
                       for f in q(spark, SF).schema.fields}
        rel = con.sql(E.oracle_sql()[name])
        assert spark_types == dict(zip(rel.columns, map(str, rel.types))), name
