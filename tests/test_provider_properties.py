"""Property test: provider parsing agrees with a plain-Python model of the
original decoding rules on random JSON bodies (one Spark job per batch).

The model states the rules directly: provider A reads each field only if it
has the expected JSON type; provider B rejects the whole response if any
declared member anywhere has a wrong type.
"""

import datetime as dt
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shelfmark.operators.providers import parse_provider_a, parse_provider_b

KEY = "9780134190440"
INT64 = 2 ** 63

scalars = st.one_of(
    st.none(), st.booleans(), st.integers(-10**6, 10**6),
    st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False).map(lambda f: round(f, 3)),
    st.sampled_from(["", "a", "Writer 7", "x\"y", "é"]),
)
named = st.one_of(scalars, st.fixed_dictionaries({}, optional={"name": scalars, "url": scalars}))
values = st.one_of(scalars, st.lists(named, max_size=3), st.fixed_dictionaries({}, optional={"name": scalars}))


def _is_int(v):
    return isinstance(v, int) and not isinstance(v, bool) and -INT64 <= v < INT64


def _is_num(v):
    return isinstance(v, (int, float)) and not isinstance(v, bool)


# --- provider A --------------------------------------------------------------

record_a = st.fixed_dictionaries({}, optional={
    "title": values, "authors": values, "publishers": values, "publish_date": values,
    "number_of_pages": values, "subjects": values})
body_a = st.one_of(
    record_a.map(lambda r: {f"ISBN:{KEY}": r}),
    values.map(lambda v: {f"ISBN:{KEY}": v}),
    record_a.map(lambda r: {"ISBN:other": r}),
)


def model_a(doc):
    rec = doc.get(f"ISBN:{KEY}") if isinstance(doc, dict) else None
    if not isinstance(rec, dict):
        return None

    def s(v):
        return v if isinstance(v, str) else ""

    def names(v):
        out = [e["name"] for e in v if isinstance(e, dict) and isinstance(e.get("name"), str)] \
            if isinstance(v, list) else []
        return out or None

    pubs = rec.get("publishers")
    first = pubs[0] if isinstance(pubs, list) and pubs else None
    pages = rec.get("number_of_pages")
    return (s(rec.get("title")), names(rec.get("authors")),
            s(first.get("name")) if isinstance(first, dict) else "",
            s(rec.get("publish_date")), int(pages) if _is_num(pages) else 0, names(rec.get("subjects")))


# --- provider B --------------------------------------------------------------

strings = st.one_of(scalars, st.lists(scalars, max_size=3))
identifier = st.one_of(scalars, st.fixed_dictionaries({}, optional={
    "type": st.one_of(st.sampled_from(["ISBN_10", "ISBN_13", "OTHER"]), scalars), "identifier": scalars}))
volume = st.fixed_dictionaries({}, optional={
    "title": scalars, "authors": strings, "publisher": scalars, "publishedDate": scalars,
    "pageCount": st.one_of(scalars, st.just(3.0)), "language": scalars, "categories": strings,
    "industryIdentifiers": st.one_of(scalars, st.lists(identifier, max_size=3)), "extra": values})
item = st.one_of(st.none(), st.sampled_from(["s", 1]), st.fixed_dictionaries({}, optional={"volumeInfo": st.one_of(
    volume, scalars)}))
body_b = st.fixed_dictionaries({}, optional={
    "totalItems": st.one_of(st.sampled_from([0, 1, 2]), scalars),
    "items": st.one_of(st.lists(item, max_size=3), scalars)})


def model_b(doc):
    if not isinstance(doc, dict):
        return None

    def ok_str(v):
        return v is None or isinstance(v, str)

    def ok_strs(v):
        return v is None or (isinstance(v, list) and all(ok_str(x) for x in v))

    def ok_vol(vi):
        if vi is None:
            return True
        if not isinstance(vi, dict):
            return False
        ids = vi.get("industryIdentifiers")
        ids_ok = ids is None or (isinstance(ids, list) and all(
            e is None or (isinstance(e, dict) and ok_str(e.get("type")) and ok_str(e.get("identifier")))
            for e in ids))
        pc = vi.get("pageCount")
        return (all(ok_str(vi.get(k)) for k in ("title", "publisher", "publishedDate", "language"))
                and (pc is None or _is_int(pc)) and ok_strs(vi.get("authors")) and ok_strs(vi.get("categories"))
                and ids_ok)

    total, items = doc.get("totalItems"), doc.get("items")
    if not (total is None or _is_int(total)):
        return None
    if not (items is None or isinstance(items, list)):
        return None
    for it in items or []:
        if it is not None and not (isinstance(it, dict) and ok_vol(it.get("volumeInfo"))):
            return None
    if not total or not items:
        return None
    vi = (items[0] or {}).get("volumeInfo") or {}

    def lst(v):
        return None if v is None else ["" if x is None else x for x in v]

    isbn10 = isbn13 = ""
    for e in vi.get("industryIdentifiers") or []:
        t, i = (e or {}).get("type") or "", (e or {}).get("identifier") or ""
        if t == "ISBN_10":
            isbn10 = i
        elif t == "ISBN_13":
            isbn13 = i
    return (isbn10, isbn13, vi.get("title") or "", lst(vi.get("authors")), vi.get("publisher") or "",
            vi.get("publishedDate") or "", vi.get("pageCount") or 0, lst(vi.get("categories")))


def _run(spark, fn, docs):
    ts = dt.datetime(2025, 1, 1)
    rows = [(f"{KEY}", 200, json.dumps(d), ts + dt.timedelta(seconds=i)) for i, d in enumerate(docs)]
    snap = spark.createDataFrame(rows, "isbn STRING, status_code INT, body STRING, fetched_at TIMESTAMP")
    return [r for r in fn(snap).orderBy("fetched_at").collect()]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(body_a, min_size=40, max_size=40))
def test_provider_a_matches_model(spark, docs):
    for doc, r in zip(docs, _run(spark, parse_provider_a, docs)):
        want = model_a(doc)
        got = None if not r.hit else (r.meta.title, r.meta.authors, r.meta.publisher, r.meta.publication_date,
                                      r.meta.pages, r.meta.categories)
        assert got == want, json.dumps(doc)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(body_b, min_size=40, max_size=40))
def test_provider_b_matches_model(spark, docs):
    for doc, r in zip(docs, _run(spark, parse_provider_b, docs)):
        want = model_b(doc)
        got = None if not r.hit else (r.meta.isbn_10, r.meta.isbn_13, r.meta.title, r.meta.authors,
                                      r.meta.publisher, r.meta.publication_date, r.meta.pages, r.meta.categories)
        assert got == want, json.dumps(doc)
