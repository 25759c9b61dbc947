"""Merging new responses into a store bucket by bucket."""

import datetime as dt
import os

from pyspark.sql import functions as F

from shelfmark.operators.providers import default_providers
from shelfmark.operators.resolve import lookup_table
from shelfmark.operators.upkeep import lookup_from_responses, merge_responses, save_responses

DDL = "isbn STRING, status_code INT, body STRING, fetched_at TIMESTAMP"
DAY = [dt.datetime(2025, 1, 1 + d) for d in range(5)]


def _a(key, title):
    return f'{{"ISBN:{key}":{{"title":"{title}"}}}}'


def _b(title):
    return f'{{"totalItems":1,"items":[{{"volumeInfo":{{"title":"{title}"}}}}]}}'


def _files(path):
    return {f"{d}/{f}": os.stat(os.path.join(path, d, f)).st_mtime_ns for d in os.listdir(path) if d.startswith("bucket=")
            for f in os.listdir(os.path.join(path, d)) if f.startswith("part-")}


def _rows(lookup):
    return sorted((r.isbn, r.provider, r.meta.title) for r in lookup.collect())


def test_merge_equals_a_rebuild_and_leaves_other_buckets(spark, tmp_dir):
    keys = [f"97800000000{i:02d}" for i in range(60)]
    a0 = [(k, 200, _a(k, "first"), DAY[1]) for k in keys[:40]]
    b0 = [(k, 200, _b("from b"), DAY[1]) for k in keys[20:]]
    # new: a later answer, an earlier one (superseded), a later miss that uncovers provider B, a new key, a repeated answer
    a1 = [(keys[0], 200, _a(keys[0], "second"), DAY[3]), (keys[1], 200, _a(keys[1], "old"), DAY[0]), (keys[30], 404, "gone", DAY[2]),
          ("9781111111111", 200, _a("9781111111111", "new"), DAY[1]), a0[2]]
    b1 = [(keys[0], 200, _b("never used"), DAY[4])]
    frame = lambda rows: spark.createDataFrame(rows, DDL)
    path = os.path.join(tmp_dir, "store")
    save_responses(default_providers(frame(a0), frame(b0)), path, 32)
    before = _files(path)
    fresh = default_providers(frame(a1), frame(b1))
    touched = merge_responses(spark, fresh, path, 32)
    after = _files(path)
    want = {r[0] for r in spark.createDataFrame([(k,) for k in (keys[0], keys[1], keys[30], "9781111111111", keys[2])], "isbn STRING")
            .select(F.pmod(F.xxhash64("isbn"), F.lit(32)).cast("int")).collect()}
    assert set(touched) == want and len(touched) < 32
    untouched = {f: t for f, t in before.items() if int(f.split("/")[0][7:]) not in want}
    assert untouched and all(after.get(f) == t for f, t in untouched.items())
    rebuilt = _rows(lookup_table(default_providers(frame(a0 + a1), frame(b0 + b1))))
    assert _rows(lookup_from_responses(spark, path)) == rebuilt
    got = {k: (p, t) for k, p, t in rebuilt}
    assert got[keys[0]] == ("provider_a", "second") and got[keys[1]] == ("provider_a", "first") and got[keys[30]] == ("provider_b", "from b")
    merge_responses(spark, fresh, path, 32)                      # once more: the same
    assert _rows(lookup_from_responses(spark, path)) == rebuilt


def test_nothing_new(spark, tmp_dir):
    path = os.path.join(tmp_dir, "store")
    one = spark.createDataFrame([("9780134190440", 200, _a("9780134190440", "t"), None)], DDL)
    none = one.limit(0)
    save_responses(default_providers(one, none), path, 4)
    before = _files(path)
    assert merge_responses(spark, default_providers(none, none), path, 4) == [] and _files(path) == before
    assert _rows(lookup_from_responses(spark, path)) == [("9780134190440", "provider_a", "t")]
