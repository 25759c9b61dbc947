"""Providers asked in turn, previews of a few keys, named appends, summaries of streamed runs, streamed hot keys."""

import os

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import resolve as R
from shelfmark.operators.keyfilter import key_filter, only_keys
from shelfmark.operators.summary import summary_distinct, summary_rows
from shelfmark.operators.validate import input_counts, valid_ids
from shelfmark.plans import grid as G
from shelfmark.plans.jobs import run_resolve, write_sheet
from shelfmark.streaming.ids import hot_keys, resolve_stream, resolved_stream, stream_failed_keys, stream_summary
from test_resolve import _providers, _valid


def test_filter_keeps_every_key_and_drops_most_others(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id")).alias("isbn"))
    wide = spark.range(50000).select(F.concat(F.lit("k"), F.col("id")).alias("isbn"), F.lit("body").alias("body"))
    left = only_keys(wide, key_filter(keys, 5000), 5000)
    assert left.columns == wide.columns
    got = {r.isbn for r in left.select("isbn").collect()}
    assert {f"k{i}" for i in range(5000)} <= got and len(got) < 5000 + 45000 * 0.02
    assert only_keys(wide, key_filter(keys.limit(0), 0), 0).count() == 0


def test_too_many_keys_mean_no_filter(spark, monkeypatch):
    from shelfmark.operators import keyfilter

    monkeypatch.setattr(keyfilter, "MAX_KEYS", 10)
    keys = spark.range(20).select(F.col("id").cast("string").alias("isbn"))
    assert key_filter(keys, 20) is None and only_keys(keys, None, 20).count() == 20


def test_rows_without_a_key_are_no_hits(spark):
    df = spark.createDataFrame([(None,), ("a",)], "isbn STRING")
    assert only_keys(df, key_filter(df.where("isbn = 'a'"), 1), 1).where("isbn is null").count() <= 1


def test_providers_in_turn_give_the_same(spark):
    keys = R.key_counts(_valid(spark, ["9780134190440", "0596520689", "9780132350884", "043942089X", "9780134190440"]))
    provs = _providers(spark)
    for order in (provs, provs[:1], [*provs, R.Provider("provider_c", 3, provs[0].snapshot, provs[0].parse)]):
        assert sorted(map(tuple, R.resolve_keys_in_turn(keys, order).collect()), key=str) == \
            sorted(map(tuple, R.resolve_keys(keys, order).collect()), key=str)


def test_second_provider_parses_only_what_is_open(spark, monkeypatch):
    """Nine keys of ten are answered by the first provider: the parse of the second sees about the tenth left."""
    n = 400
    keys = [f"{i:09d}X" for i in range(n)]
    a = spark.createDataFrame([(k, 200, f'{{"ISBN:{k}":{{"title":"t"}}}}' if i % 10 else "x", None) for i, k in enumerate(keys)], "isbn STRING, status_code INT, body STRING, fetched_at TIMESTAMP")
    b = spark.createDataFrame([(k, 200, '{"totalItems":1,"items":[{"volumeInfo":{"title":"b"}}]}', None) for k in keys], a.schema)
    from shelfmark.operators.providers import default_providers

    seen = []
    first, second = default_providers(a, b)
    watched = R.Provider(second.name, 2, b, lambda s: (seen.append(s), second.parse(s))[1])
    counts = spark.createDataFrame([(k, 1) for k in keys], "isbn STRING, n BIGINT")
    got = R.resolve_keys_in_turn(counts, [first, watched])
    assert {r.provider: r["count"] for r in got.groupBy("provider").count().collect()} == {"provider_a": n * 9 // 10, "provider_b": n // 10}
    assert n // 10 <= seen[0].count() < n // 10 + n * 0.05
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    at = next(i for i, line in enumerate(plan.splitlines()) if "parsejson" in line.lower().replace("_", ""))
    assert "_bits" in "\n".join(plan.splitlines()[at:]), plan          # the filter stands below the parse


def test_preview_looks_up_the_shown_keys_only(spark):
    values = ["9780134190440", "0596520689", "9780132350884", "043942089X"] * 5
    valid, lookup = _valid(spark, values), R.lookup_table(_providers(spark))
    shown = G.preview_rows(valid, lookup)
    whole = G.sheet_rows(R.resolve_with_lookup(valid, lookup)).orderBy("pos").limit(G.PREVIEW_DATA)
    assert sorted(map(tuple, shown.collect())) == sorted(map(tuple, whole.collect()))
    plan = R.first_results(valid, G.PREVIEW_DATA, lookup)._jdf.queryExecution().optimizedPlan().toString()
    joins = [i for i, line in enumerate(plan.splitlines()) if "Join " in line]
    assert len(joins) == 2 and plan.count(f"GlobalLimit {G.PREVIEW_DATA}") == 2     # the top-k feeds both joins


@pytest.mark.parametrize("as_table", [False, True])
def test_a_job_run_twice_appends_once(spark, tmp_dir, as_table):
    valid = _valid(spark, ["9780134190440", "0596520689", "9780132350884"])
    rows = G.sheet_rows(R.resolve_with_lookup(valid, R.lookup_table(_providers(spark))))
    target = "named_appends" if as_table else os.path.join(tmp_dir, "grid")
    if as_table:
        spark.sql(f"DROP TABLE IF EXISTS {target}")
    for job in ("a", "b", "a", "a"):
        G.write_grid(rows, target, mode="append", as_table=as_table, job=job)
    got = G.read_grid(spark, target, as_table=as_table)
    assert got.count() == 6 and len(got.columns) == 9
    G.write_grid(rows.limit(1), target, mode="append", as_table=as_table, job="b")      # the job's rows are what its last run gave
    assert G.read_grid(spark, target, as_table=as_table).count() == 4
    if as_table:
        spark.sql(f"DROP TABLE {target}")


def test_write_sheet_by_job_name(spark, tmp_dir):
    ids = spark.createDataFrame([(0, "9780134190440"), (1, "bad")], "pos BIGINT, raw STRING")
    job = run_resolve(spark, ids, lookup=R.lookup_table(_providers(spark)))
    for _ in range(2):
        write_sheet(job, f"{tmp_dir}/g", mode="append", fmt="csv", job_name="day-1")
    assert G.read_grid(spark, f"{tmp_dir}/g", fmt="csv").count() == 1
    job.close()


VALUES = [["9780134190440", "9780132350884", "bad", "9780132350884"], ["0596520689", "9780132350884", "# no id", "043942089X"],
          ["9780134190440", "x", "043942089X"], ["", "bad"]]


def test_streamed_summary_equals_batch_also_after_a_replay(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    lookup = "stream_lookup_summary"
    R.save_lookup(R.lookup_table(_providers(spark)), lookup, 4, path=os.path.join(tmp_dir, "lookup"))
    out, rej, ck, summary = (os.path.join(tmp_dir, d) for d in ("out", "rej", "ck", "summary"))

    def run():
        resolve_stream(spark, src, lookup, out, rej, ck, max_files_per_trigger=1, summary=summary).awaitTermination()

    def check(files):
        flat = [v for f in VALUES[:files] for v in f if v and not v.startswith("#")]
        ids = spark.createDataFrame([(i, v) for i, v in enumerate(flat)], "pos BIGINT, raw STRING")
        keys = R.resolve_keys_with_lookup(R.key_counts(valid_ids(ids)), spark.table(lookup))
        rows, distinct, read = (f(x).first() for f, x in ((summary_rows, keys), (summary_distinct, keys), (input_counts, ids)))
        got = stream_summary(spark, summary).first()
        assert (got.rows_read, got.rows_valid) == (read.rows_read, read.rows_valid)
        assert (got.total, got.successful, got.failed) == (rows.total, rows.successful, rows.failed)
        assert (got.successful_keys, got.failed_keys) == (distinct.successful, distinct.failed)
        assert {(r.isbn, r.n) for r in stream_failed_keys(spark, summary).collect()} == {(r.isbn, r.n) for r in keys.where("error is not null").collect()}

    for i, values in enumerate(VALUES[:2]):
        with open(os.path.join(src, f"{i}.txt"), "w") as f:
            f.write("\n".join(values) + "\n")
    run()
    check(2)
    # The last epoch's commit is lost: it runs once more and replaces what it left.
    commits = sorted(int(c) for c in os.listdir(f"{ck}/commits") if c.isdigit())
    os.unlink(f"{ck}/commits/{commits[-1]}")
    crc = f"{ck}/commits/.{commits[-1]}.crc"
    if os.path.exists(crc):
        os.unlink(crc)
    run()
    check(2)
    for i, values in enumerate(VALUES[2:], 2):
        with open(os.path.join(src, f"{i}.txt"), "w") as f:
            f.write("\n".join(values) + "\n")
    run()
    check(4)


def test_streamed_hot_key_reaches_several_tasks(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    for i in range(12):
        with open(os.path.join(src, f"{i}.txt"), "w") as f:
            f.write("9780134190440\n" * 50 + "0596520689\nbad\n")
    lookup = R.lookup_table(_providers(spark))
    counts = spark.createDataFrame([("9780134190440", 600), ("0596520689", 12)], "isbn STRING, n BIGINT")
    hot = hot_keys(counts, 100)
    assert [tuple(r) for r in hot.collect()] == [("9780134190440", 6)]

    def run(name, hot):
        rows = resolved_stream(spark, src, lookup, hot).select("isbn", "provider", "error", F.spark_partition_id().alias("p"))
        out = os.path.join(tmp_dir, name)
        (rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-ck").trigger(availableNow=True)
         .start().awaitTermination())
        return spark.read.parquet(out)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plain, salted = run("plain", None), run("salted", hot)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    cols = ["isbn", "provider", "error"]
    assert sorted(plain.select(*cols).collect()) == sorted(salted.select(*cols).collect()) and plain.count() == 612
    tasks = {name: df.where("isbn = '9780134190440'").select("p").distinct().count() for name, df in (("plain", plain), ("salted", salted))}
    assert tasks["plain"] == 1 and tasks["salted"] > 1
