"""Provider response parsing: golden bodies for both providers."""

import datetime as dt

from shelfmark.operators.providers import latest_response, parse_provider_a, parse_provider_b

TS = dt.datetime(2025, 1, 1)


def _snap(spark, rows):
    return spark.createDataFrame([(k, s, b, TS + dt.timedelta(seconds=i)) for i, (k, s, b) in enumerate(rows)],
                                 "isbn STRING, status_code INT, body STRING, fetched_at TIMESTAMP")


def _parse(spark, fn, bodies, status=200):
    snap = _snap(spark, [("1", status, b) for b in bodies])
    out = fn(snap).withColumn("i", snap.fetched_at.cast("long")).orderBy("fetched_at").collect()
    return [(r.hit, r.meta) for r in out]


def test_provider_a_bodies(spark):
    bodies = [
        '{"ISBN:1":{"title":"T","number_of_pages":12.9,"authors":[{"name":"A"},{"x":1},"s",{"name":5},'
        '{"name":"B"}],"publishers":[{"q":1},{"name":"P2"}]}}',
        '{"ISBN:1":{"title":7,"number_of_pages":"300","authors":"zz"}}',
        '{"ISBN:1":{}}',
        '{}', '{bad', '{"ISBN:1":null}', '{"ISBN:1":[1]}',
        '{"ISBN:1":{"publish_date":"2001","subjects":[{"name":"S"}],"publishers":[{"name":"P"}],'
        '"number_of_pages":-3.5}} trailing',
        '{"ISBN:1":{"title":"first"},"ISBN:1":{"title":"last"}}',
    ]
    got = _parse(spark, parse_provider_a, bodies)
    hit, m = got[0]
    assert hit and m.title == "T" and m.pages == 12 and m.authors == ["A", "B"] and m.publisher == ""
    hit, m = got[1]
    assert hit and m.title == "" and m.pages == 0 and m.authors is None
    hit, m = got[2]
    assert hit and (m.title, m.publisher, m.publication_date, m.pages, m.authors, m.categories) == \
        ("", "", "", 0, None, None)
    assert [h for h, _ in got[3:7]] == [False] * 4
    hit, m = got[7]
    assert hit and m.publication_date == "2001" and m.categories == ["S"] and m.publisher == "P" and m.pages == -3
    hit, m = got[8]
    assert hit and m.title == "last"
    # any status other than 200 is a miss
    assert _parse(spark, parse_provider_a, ['{"ISBN:1":{}}'], status=404)[0][0] is False


def test_provider_b_bodies(spark):
    hits = [
        '{"totalItems":1,"items":[{"volumeInfo":{"title":"G","authors":["a"],"pageCount":3,'
        '"industryIdentifiers":[{"type":"ISBN_13","identifier":"x"},{"type":"ISBN_13","identifier":"y"}]}}]}',
        '{"totalItems":1,"items":[{"volumeInfo":{"title":null}}]}',
        '{"totalItems":1,"items":[{}]}',
        '{"totalItems":1,"items":[null]}',
        '{"totalItems":1,"items":[{"volumeInfo":null}]}',
    ]
    misses = [
        '{"totalItems":0,"items":[{"volumeInfo":{"title":"G"}}]}',
        '{"items":[{"volumeInfo":{"title":"G"}}]}',
        '{"totalItems":1}', '{"totalItems":1,"items":[]}',
        '{"totalItems":1,"items":[{"volumeInfo":{"pageCount":"3"}}]}',
        '{"totalItems":1,"items":[{"volumeInfo":{"pageCount":3.5}}]}',
        '{"totalItems":1,"items":[{"volumeInfo":{"pageCount":3.0}}]}',
        '{"totalItems":1,"items":[{"volumeInfo":{"title":5}}]}',
        '{"totalItems":1,"items":[{"volumeInfo":{"authors":["a",1]}}]}',
        '{"totalItems":1,"items":[{"volumeInfo":"s"}]}',
        '{"totalItems":1,"items":["s"]}',
        '{"totalItems":1,"items":{"a":1}}',
        '{"totalItems":1,"items":[{"volumeInfo":{"industryIdentifiers":["s"]}}]}',
        '{"totalItems":1,"items":[{"volumeInfo":{"industryIdentifiers":[{"type":1}]}}]}',
        '{"totalItems":2,"items":[{"volumeInfo":{"title":"G"}},{"volumeInfo":{"language":7}}]}',
        'not json',
    ]
    got = _parse(spark, parse_provider_b, hits + misses)
    assert [h for h, _ in got] == [True] * len(hits) + [False] * len(misses)
    m = got[0][1]
    assert (m.title, m.authors, m.pages, m.isbn_13, m.isbn_10) == ("G", ["a"], 3, "y", "")
    for _, m in got[1:5]:
        assert (m.title, m.authors, m.pages, m.categories) == ("", None, 0, None)


def test_provider_b_lists(spark):
    body = ('{"totalItems":3,"items":[{"volumeInfo":{"authors":[],"categories":["c",null],'
            '"industryIdentifiers":[{"type":"ISBN_10","identifier":"i10"},{"type":"ISBN_13"}]}}]}')
    (hit, m), = _parse(spark, parse_provider_b, [body])
    assert hit and m.authors == [] and m.categories == ["c", ""] and m.isbn_10 == "i10" and m.isbn_13 == ""


def test_latest_response_wins(spark):
    snap = spark.createDataFrame([
        ("1", 200, '{"ISBN:1":{"title":"old"}}', TS),
        ("1", 404, '{"ISBN:1":{"title":"new"}}', TS + dt.timedelta(days=1)),
        ("2", 404, '{"ISBN:2":{"title":"old"}}', TS),
        ("2", 200, '{"ISBN:2":{"title":"new"}}', TS + dt.timedelta(days=1)),
    ], "isbn STRING, status_code INT, body STRING, fetched_at TIMESTAMP")
    got = {r.isbn: (r.hit, r.meta.title if r.meta else None)
           for r in latest_response(parse_provider_a(snap)).collect()}
    assert got == {"1": (False, None), "2": (True, "new")}


def test_hot_key_responses_collapse_to_latest(spark):
    """One key holding most snapshot rows: the partial aggregate keeps the
    latest response (hit or miss) and nothing else."""
    from pyspark.sql import functions as F

    n = 30_000
    snap = spark.range(n).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("k"), F.col("id").cast("string"))).otherwise(F.lit("1"))
        .alias("isbn"),
        F.lit(200).alias("status_code"),
        F.format_string('{"ISBN:%s":{"title":"v%d"}}',
                        F.when(F.col("id") % 10 == 0, F.concat(F.lit("k"), F.col("id").cast("string")))
                        .otherwise(F.lit("1")), F.col("id")).alias("body"),
        F.timestamp_seconds(F.col("id") + F.lit(1_700_000_000)).alias("fetched_at"),
    ).repartition(8)
    latest = latest_response(parse_provider_a(snap))
    assert latest.count() == 1 + n // 10
    r = latest.where("isbn = '1'").first()
    assert r.hit and r.meta.title == f"v{n - 1}"
