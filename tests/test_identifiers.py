"""Golden rows and properties for normalisation, checksums and classification."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.functions.isbn import classify_id, is_isbn10, is_isbn13, isbn10_to_13, normalize_id, trim_space

FMT = "Invalid ISBN format (must be 10 or 13 digits)"
BAD10 = "Invalid ISBN-10 checksum"
BAD13 = "Invalid ISBN-13 checksum"

GOLDEN = [
    ("0596520689", "ISBN10", "0596520689", ""),
    ("043942089X", "ISBN10", "043942089X", ""),
    ("0-596-52068-9", "ISBN10", "0596520689", ""),
    ("0596520688", "Invalid", "", BAD10),
    ("059652068", "Invalid", "", FMT),
    ("9780134190440", "ISBN13", "9780134190440", ""),
    ("978-0-13-419044-0", "ISBN13", "9780134190440", ""),
    ("9780134190441", "Invalid", "", BAD13),
    ("9990134190440", "Invalid", "", BAD13),
    ("978013419044", "Invalid", "", FMT),
    ("9791234567896", "ISBN13", "9791234567896", ""),
    # edge rows
    ("043942089x", "ISBN10", "043942089x", ""),
    ("0 596 5206 89", "ISBN10", "0596520689", ""),
    ("0596520689\t", "Invalid", "", FMT),
    ("978013419044X", "Invalid", "", BAD13),
    ("ééééé", "Invalid", "", BAD10),
    ("97801341904é", "Invalid", "", BAD13),
    ("", "Invalid", "", FMT),
    ("1234567890", "Invalid", "", BAD10),
    (None, "Invalid", "", FMT),
    # sample file: all valid
    ("978-0134190440", "ISBN13", "9780134190440", ""),
    ("9780132350884", "ISBN13", "9780132350884", ""),
    ("0451524934", "ISBN10", "0451524934", ""),
    ("9780316769174", "ISBN13", "9780316769174", ""),
]


def _classify(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, raw STRING")
    out = df.select("i", classify_id("raw").alias("v")).orderBy("i").collect()
    return [(r.v.type, r.v.normalized, r.v.error) for r in out]


def test_classify_golden(spark):
    got = _classify(spark, [g[0] for g in GOLDEN])
    assert got == [g[1:] for g in GOLDEN]


def test_raw_checksums(spark):
    cases10 = [("0596520689", True), ("043942089X", True), ("0596520688", False), ("059652068", False),
               ("0596520689\n", False)]
    cases13 = [("9780134190440", True), ("9791234567896", True), ("9780134190441", False),
               ("9990134190440", False), ("978013419044", False), ("9780134190440\n", False)]
    df = spark.createDataFrame([(v,) for v, _ in cases10], "n STRING")
    assert [r[0] for r in df.select(is_isbn10("n")).collect()] == [e for _, e in cases10]
    df = spark.createDataFrame([(v,) for v, _ in cases13], "n STRING")
    assert [r[0] for r in df.select(is_isbn13("n")).collect()] == [e for _, e in cases13]


def test_isbn10_to_13(spark):
    df = spark.createDataFrame([("0596520689",), ("043942089X",), ("059652068",), ("abcdefghiX",)], "n STRING")
    assert [r[0] for r in df.select(isbn10_to_13("n")).collect()] == ["9780596520687", "9780439420891", "", None]


def test_normalize_only_ascii_hyphen_and_space(spark):
    df = spark.createDataFrame([("0-596 52068–9 ",)], "n STRING")
    assert df.select(normalize_id("n")).first()[0] == "059652068–9 "


def test_trim_unicode(spark):
    df = spark.createDataFrame([("　\t 0596520689 \r\u0085",)], "n STRING")
    assert df.select(trim_space("n")).first()[0] == "0596520689"


def _isbn13_check(body12: str) -> str:
    s = sum(int(c) * (1 if i % 2 == 0 else 3) for i, c in enumerate(body12))
    return str((10 - s % 10) % 10)


def _isbn10_check(body9: str) -> str:
    s = sum(int(c) * (10 - i) for i, c in enumerate(body9))
    c = (11 - s % 11) % 11
    return "X" if c == 10 else str(c)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=999_999_999), min_size=5, max_size=5))
def test_properties(spark, books):
    """Single-digit substitutions are invalid; F5 output passes F3;
    inserted hyphens/spaces do not change the classification."""
    rows = []
    for b in books:
        b9 = f"{b:09d}"
        k10 = b9 + _isbn10_check(b9)
        k13 = "978" + b9 + _isbn13_check("978" + b9)
        rows.append((k10, k13))
        for key in (k10, k13):
            pos = b % len(key)
            if key[pos].isdigit():
                other = str((int(key[pos]) + 1 + b % 8) % 10)
                rows.append((key[:pos] + other + key[pos + 1:], None))
    df = spark.createDataFrame(rows, "a STRING, b STRING")
    res = df.select(
        "a", "b",
        classify_id("a").alias("va"),
        classify_id(F.concat(F.substring("a", 1, 3), F.lit("- "), F.expr("substring(a, 4)"))).alias("vh"),
        is_isbn13(isbn10_to_13("a")).alias("conv_ok"),
        classify_id("b").alias("vb"),
    ).collect()
    for r in res:
        assert r.va.type == r.vh.type
        if r.b is not None:  # a is a valid ISBN-10, b its ISBN-13
            assert r.va.type == "ISBN10" and r.vb.type == "ISBN13" and r.conv_ok
        else:
            assert r.va.type == "Invalid"
