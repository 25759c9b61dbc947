"""Resolution: priority, fallback, duplicates, hot-key splitting, summaries."""

import contextlib
import datetime as dt
import io
import os

from pyspark.sql import functions as F

from shelfmark import fixed
from shelfmark.operators import resolve as R
from shelfmark.operators.providers import default_providers
from shelfmark.operators.summary import summary_distinct, summary_rows
from shelfmark.operators.validate import valid_ids
from shelfmark.plans import grid as G
from shelfmark.plans.report import in_order

TS = dt.datetime(2025, 1, 1)
SNAP = "isbn STRING, status_code INT, body STRING, fetched_at TIMESTAMP"


def _providers(spark):
    a = spark.createDataFrame([
        ("9780134190440", 200, '{"ISBN:9780134190440":{"title":""}}', TS),   # A hit, blank title
        ("0596520689", 500, '{"ISBN:0596520689":{"title":"A"}}', TS),         # A miss
        ("9780132350884", 200, '{"ISBN:9780132350884":null}', TS),            # A miss
    ], SNAP)
    b = spark.createDataFrame([
        ("9780134190440", 200, '{"totalItems":1,"items":[{"volumeInfo":{"title":"B wins?"}}]}', TS),
        ("0596520689", 200, '{"totalItems":1,"items":[{"volumeInfo":{"title":"From B",'
                            '"industryIdentifiers":[{"type":"ISBN_13","identifier":"9780596520687"}]}}]}', TS),
    ], SNAP)
    return default_providers(a, b)


def _valid(spark, values):
    ids = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "pos BIGINT, raw STRING")
    return valid_ids(ids)


def test_priority_fallback_and_duplicates(spark):
    values = ["978-0134190440", "0-596-52068-9", "9780132350884", "9780134190440", "bad", "043942089x"]
    res = R.resolve(_valid(spark, values), _providers(spark)).orderBy("pos").collect()
    assert [r.pos for r in res] == [0, 1, 2, 3, 5]            # rejects dropped, duplicates kept
    by = {r.pos: r for r in res}
    assert by[0].provider == "provider_a" and by[0].meta.title == ""   # whole-record priority
    assert by[3].provider == "provider_a"
    assert by[1].provider == "provider_b" and by[1].meta.title == "From B" and by[1].meta.isbn_13 == "9780596520687"
    assert by[2].provider is None and by[2].error == "failed to resolve ISBN from all APIs"
    assert by[5].error is not None                              # lower-case x is its own key


def test_hot_key_split_matches_plain_join(spark):
    # one key holds most rows; tiny split size forces the salted path
    hot = ["9780134190440"] * 3000 + ["0596520689"] * 40 + ["9780132350884"] * 7
    valid = _valid(spark, hot)
    provs = _providers(spark)
    resolved = R.resolve_keys(R.key_counts(valid), provs)
    split = R.attach(valid, resolved, rows_per_split=100)
    plain = R.attach(valid, resolved, rows_per_split=10**9)
    cols = ["pos", "isbn", "provider", "error"]
    assert sorted(split.select(*cols).collect()) == sorted(plain.select(*cols).collect())
    assert split.count() == len(hot)
    # with a shuffled join (no broadcast, no partition coalescing) the hot
    # key's rows land in more than one join task
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = (R.attach(valid, resolved, rows_per_split=100)
                 .where(F.col("isbn") == "9780134190440")
                 .select(F.spark_partition_id().alias("p")).distinct().count())
        # (the joined column is used: a left join on unique keys is left out by the optimizer otherwise)
        plain_parts = (R.attach(valid, resolved, rows_per_split=10**9)
                       .where((F.col("isbn") == "9780134190440") & F.col("provider").isNotNull())
                       .select(F.spark_partition_id().alias("p")).distinct().count())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert plain_parts == 1 and parts > 1


def test_summaries(spark):
    values = ["9780134190440", "9780134190440", "9780132350884", "9780132350884", "0596520689"]
    keys = R.resolve_keys(R.key_counts(_valid(spark, values)), _providers(spark))
    r = summary_rows(keys).first()
    assert (r.total, r.successful, r.failed) == (5, 3, 2)
    d = summary_distinct(keys).first()
    assert (d.total, d.successful, d.failed) == (5, 4, 1)


def test_fallback_resolved_unresolved_sets(spark):
    keys = R.key_counts(_valid(spark, ["9780134190440", "0596520689", "9780132350884", "9780132350884"]))
    provs = _providers(spark)
    assert {r.isbn for r in R.fallback_keys(keys, provs).collect()} == {"0596520689", "9780132350884"}
    assert {(r.isbn, r.provider) for r in R.resolved_ids(keys, provs).collect()} == \
        {("9780134190440", "provider_a"), ("0596520689", "provider_b")}
    assert [r.isbn for r in R.unresolved_ids(keys, provs).collect()] == ["9780132350884"]


def test_resolve_plan_has_no_extra_exchange_between_provider_joins(spark):
    """Keys and provider hits are both hash-partitioned by isbn: the join chain
    should not re-shuffle them (broadcast is disabled to see the merge plan)."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        keys = R.key_counts(_valid(spark, ["9780134190440", "0596520689"]))
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            R.resolve_keys(keys, _providers(spark)).explain()
        plan = buf.getvalue()
        # one exchange per aggregate (keys, provider A, provider B) and none for the joins
        assert plan.count("Exchange hashpartitioning") == 3, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_job_writes_reports(spark, tmp_dir):
    import os

    from shelfmark.plans.jobs import run_resolve, write_report, write_sheet
    from shelfmark.plans.report import read_csv_rows

    ids = spark.createDataFrame([(i, v) for i, v in enumerate(
        ["978-0134190440", "bad", "0-596-52068-9", "9780132350884", "9780134190440"])], "pos BIGINT, raw STRING")
    job = run_resolve(spark, ids, _providers(spark))
    assert job.results.count() == 4 and job.rejected.count() == 1
    assert job.input_counts == {"rows_read": 5, "rows_valid": 4}
    s = job.summary.first()
    assert (s.total, s.successful, s.failed) == (4, 3, 1)
    out = os.path.join(tmp_dir, "out")
    for fmt in ("csv", "json", "text"):
        write_report(job, f"{out}/{fmt}", fmt)
    rows = read_csv_rows(spark, f"{out}/csv/results").collect()
    assert [r["ISBN"] for r in rows] == ["9780134190440", "0596520689", "9780132350884", "9780134190440"]
    assert spark.read.json(f"{out}/json/summary").first().total == 4
    preview = write_sheet(job, "sheet-1", dry_run=True)
    assert preview[:4] == ["DRY RUN - Preview of changes:", "=============================",
                           "Spreadsheet ID: sheet-1", "Output Range: "]
    assert "Would write 5 rows:" in preview and preview[-1] == "No changes were made (dry run mode)"
    via_lookup = run_resolve(spark, ids, lookup=R.lookup_table(_providers(spark)))
    cols = ["pos", "isbn", "provider", "error"]
    assert sorted(via_lookup.results.select(*cols).collect()) == sorted(job.results.select(*cols).collect())
    # split keys give the same rows
    salted = run_resolve(spark, ids, _providers(spark), rows_per_split=1)
    assert sorted(salted.results.select(*cols).collect()) == sorted(job.results.select(*cols).collect())
    # the grid holds exactly the header's columns, in input order
    target = os.path.join(tmp_dir, "grid")
    write_sheet(job, target, fmt="csv")
    text = "".join(open(os.path.join(target, f), encoding="utf-8").read()
                   for f in sorted(os.listdir(target)) if f.startswith("part-"))
    lines = [x for x in text.splitlines() if not x.startswith("ISBN-13,")]
    assert text.splitlines()[0] == ",".join(fixed.GRID_HEADER) and len(lines) == 4
    shown = [r["ISBN-13"] for r in G.sheet_rows(job.results).orderBy("pos").collect()]
    assert [x.split(",")[0] for x in lines] == shown
    work = job.work_dir
    job.close()
    assert not os.path.exists(work)


def test_identical_rows_spread_over_tasks(spark):
    """Rows equal in every column: only their place in the written table tells them apart."""
    key = "9780134190440"
    valid = spark.createDataFrame([(key,)] * 5000, "isbn STRING").repartition(4)
    keys = R.resolve_keys(R.key_counts(valid), _providers(spark))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = R.attach(valid, keys, rows_per_split=500).select("isbn", F.spark_partition_id().alias("p"))
        per = {r.p: r["count"] for r in out.groupBy("p").count().collect()}
        once = R.attach(valid, keys, rows_per_split=10**9).where(F.col("provider").isNotNull()).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(per.values()) == 5000 and len(per) > 1 and max(per.values()) < 4000 and once == 1


def test_rows_with_a_map_column(spark):
    valid = spark.createDataFrame([("9780134190440", {"a": 1})] * 30 + [("0596520689", None)] * 3, "isbn STRING, m MAP<STRING, INT>")
    keys = R.resolve_keys(R.key_counts(valid), _providers(spark))
    got = R.attach(valid, keys, rows_per_split=5)
    assert got.count() == 33 and got.where("m['a'] = 1").count() == 30
    assert in_order(valid.withColumn("pos", F.lit(1))).count() == 33


def test_split_set_is_small_without_a_cap(spark, monkeypatch):
    """Keys are split from N / MAX_SPLIT_KEYS rows on, so fewer than that many can be."""
    monkeypatch.setattr(R, "MAX_SPLIT_KEYS", 3)
    values = [f"9780134190440{i}" for i in range(10)]
    valid = spark.createDataFrame([(v,) for v in values for _ in range(20)], "isbn STRING")
    keys = R.resolve_keys(R.key_counts(valid), _providers(spark))
    assert R.attach(valid, keys, rows_per_split=1).count() == 200


def test_latest_response_has_one_answer_on_ties(spark):
    from shelfmark.operators.providers import latest_response, parse_provider_a

    rows = [("9780134190440", 200, '{"ISBN:9780134190440":{"title":"x"}}', TS), ("9780134190440", 404, "gone", TS),
            ("9780134190440", 200, '{"ISBN:9780134190440":{"title":"y"}}', TS),
            ("0596520689", 200, '{"ISBN:0596520689":{"title":"a"}}', None), ("0596520689", 200, '{"ISBN:0596520689":{"title":"b"}}', None)]
    seen = set()
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(order, SNAP).coalesce(1)
        seen.add(tuple(sorted((r.isbn, r.hit, r.meta.title if r.meta else None) for r in latest_response(parse_provider_a(df)).collect())))
    assert len(seen) == 1 and ("9780134190440", False, None) in next(iter(seen))   # the higher status code


def test_three_provider_chain_by_priority(spark):
    """The chain is a list: the lowest priority number with a hit wins."""
    from shelfmark.operators.providers import Provider, parse_provider_a

    a, b = _providers(spark)
    c_snap = spark.createDataFrame([
        ("9780132350884", 200, '{"ISBN:9780132350884":{"title":"C"}}', TS),
        ("9780134190440", 200, '{"ISBN:9780134190440":{"title":"C too"}}', TS),
    ], SNAP)
    c = Provider("provider_c", 0, c_snap, parse_provider_a)        # highest priority
    keys = R.key_counts(_valid(spark, ["9780134190440", "0596520689", "9780132350884"]))
    got = {r.isbn: (r.provider, r.meta.title if r.meta else None)
           for r in R.resolve_keys(keys, [a, b, c]).collect()}
    assert got == {"9780134190440": ("provider_c", "C too"), "0596520689": ("provider_b", "From B"),
                   "9780132350884": ("provider_c", "C")}


def test_bucketed_lookup_is_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lookup = R.save_lookup(R.lookup_table(_providers(spark)), "lookup_bucketed_test", 8)
        keys = R.key_counts(_valid(spark, ["9780134190440", "0596520689", "9780132350884"]))
        joined = R.resolve_keys_with_lookup(keys, lookup)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            joined.explain()
        plan = buf.getvalue()
        lookup_side = plan[plan.index("SortMergeJoin"):]
        # one exchange: the key aggregate; the bucketed lookup scan is read as is
        assert plan.count("Exchange hashpartitioning") == 1, plan
        assert "Bucketed: true" in lookup_side, plan
        got = {r.isbn: r.provider for r in joined.collect()}
        assert got == {"9780134190440": "provider_a", "0596520689": "provider_b", "9780132350884": None}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS lookup_bucketed_test")
