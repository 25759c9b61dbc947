import re

import llm_cases as C
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import linededup as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(rows):
    """(doc_id, text, line_no) -> place of the line it repeats; all ids distinct."""
    occ = [((i, n), tuple(WORD.findall(x))) for i, t in rows if t is not None for n, x in enumerate(t.split("\n"))]
    occ = sorted((p, w) for p, w in occ if len(w) >= L.MIN_EXACT)
    first = {}
    for p, w in occ:
        first.setdefault(w, p)
    near = {w: min([p] + [q for v, q in first.items() if len(v) >= L.MIN_NEAR and len(w) >= L.MIN_NEAR and one(w, v)]) for w, p in first.items()}
    return {p: near[w] for p, w in occ}


def lines():
    base = "one two three four five six seven eight nine ten eleven"
    w = base.split()
    edits = [base, base.replace("four", "4"), base.replace("eleven", "x"), " ".join(w[1:]), base + " twelve", " ".join(w[:5] + ["new"] + w[5:]),
             base.replace("two", "2").replace("nine", "9"), "a b c d e", "a b c d f", "a b c d", "  one two   three four five six seven eight nine ten eleven ",
             " ".join(["r"] * 12), " ".join(["r"] * 13), " ".join(["r"] * 14), " ".join(w[::-1]), base.replace("one", "two")]
    family = [base.replace("six", f"v{i}") for i in range(300)]     # all one edit apart
    out = [(i, "\n".join([e, "", "tail of " + str(i)])) for i, e in enumerate(edits)]
    return out + [(1000 + i, e) for i, e in enumerate(family)]


@pytest.mark.parametrize("bound", [L.BROADCAST_ROWS, 0])
def test_equals_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(L, "BROADCAST_ROWS", bound)
    data = lines() + [(5000 + i, t) for i, (d, t) in enumerate(C.texts_of(C.rows())) if d is not None]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    got = {(r["doc_id"], r["line_no"]): (r["first_doc_id"], r["first_line_no"]) for r in L.line_dedup(df).collect()}
    want = brute(data)
    assert got == want
    assert {(r["doc_id"], r["line_no"]) for r in L.line_dedup(df).filter("kept").collect()} == {p for p, q in want.items() if p == q}


SHORT = [(1, "All rights reserved.\nLes.\n \nalpha beta gamma delta epsilon"), (2, "Les.\nall new here\nalpha beta gamma delta zeta"),
         (3, "  Les. \nAll rights  reserved.\none two three four"), (4, "one two three five\nalpha beta gamma delta")]


def test_lines_of_any_length(spark):
    df = spark.createDataFrame(SHORT, "doc_id bigint, text string")
    got = {(r["doc_id"], r["line_no"]): ((r["first_doc_id"], r["first_line_no"]), r["kept"]) for r in L.line_dedup(df).collect()}
    again = {(2, 0): (1, 1), (3, 0): (1, 1), (3, 1): (1, 0), (2, 2): (1, 3)}
    places = {(i, n) for i, t in SHORT for n, x in enumerate(t.split("\n")) if x.strip()}
    assert got == {p: (again.get(p, p), p not in again) for p in places}


def test_pipeline_cuts_lines_of_any_length(spark):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import corpus_pipeline

    left = corpus_pipeline.line_dedup(spark, C.frame(spark, [(i, t, "en", "s", len(t)) for i, t in SHORT]), "")
    assert {r["doc_id"]: r["text"] for r in left.collect()} == {1: SHORT[0][1], 2: "all new here", 3: "one two three four", 4: SHORT[3][1]}


def test_verified_edit_distance(spark):
    from pyspark.sql import functions as F

    texts = [t.split("\n")[0].split() for _, t in lines()[:16]]
    pairs = [(a, b) for a in texts for b in texts if a != b]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for r in df.select("a", "b", L.one_edit(F.col("a"), F.col("b")).alias("x")).collect():
        assert r["x"] == one(tuple(r["a"]), tuple(r["b"])), (r["a"], r["b"])


def test_cases(spark):
    found = L.line_dedup(C.frame(spark)).collect()
    twice = sorted((r for r in found if r["doc_id"] == 108), key=lambda r: (r["line_no"], r["kept"]))
    assert twice and twice[::2] == twice[1::2]                                  # repeated rows fare alike
    assert not any(r["doc_id"] in (102, 103, 104) for r in found)
    assert all(not r["kept"] for r in found if r["doc_id"] == 100)              # the copy of document 0
    assert L.line_dedup(C.empty(spark)).count() == 0


@pytest.mark.parametrize("bound", [L.BROADCAST_ROWS, 0])
def test_documents_without_their_duplicates(spark, monkeypatch, bound):
    monkeypatch.setattr(L, "BROADCAST_ROWS", bound)
    data = [(1, "one two three four five\nshort\nsix seven eight nine ten", "en", "s", 1), (2, "short\none two three four five\nnew words come in here", "en", "s", 1),
            (3, "one two three four five\n \nsix seven eight nine ten", "en", "s", 1), (4, None, None, None, None), (5, "", "en", "s", 0)]
    left = L.without_duplicates(C.frame(spark, data))
    assert left.columns == C.frame(spark, data).columns
    assert {r["doc_id"]: r["text"] for r in left.collect()} == {1: data[0][1], 2: "short\nnew words come in here", 4: None, 5: ""}
    assert L.without_duplicates(C.empty(spark)).count() == 0


def test_common_line_is_split(spark):
    """All places of one line, some in rows that are equal in every column, spread over tasks; the result is the same."""
    from shelfmark.llm.common import join_split, stored

    docs = spark.createDataFrame([(i % 4000, "the very same line of words\na%d b%d c%d" % ((i % 4000,) * 3)) for i in range(8000)], "doc_id bigint, text string")
    got = L.line_dedup(docs)
    assert got.count() == 16000 and got.filter("kept").count() == 8002
    rows = stored(spark.range(9000).selectExpr("1 AS k", "7 AS v").unionByName(spark.range(500).selectExpr("id + 2 AS k", "8 AS v")).repartition(4), "split-test")
    groups = rows.groupBy("k").count().withColumnRenamed("count", "n").withColumn("g", F.col("k") * 2)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = join_split(rows, groups, ["k"], "n").select("k", "v", "g", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(out) == 9500 and all(r["g"] == 2 * r["k"] for r in out)
    assert len({r["p"] for r in out if r["k"] == 1}) > 1


def test_part_hashes_are_made_once(spark, monkeypatch):
    """What the semi-join of step 2 reads on both sides is a written table, not the hashing again."""
    plans, real = {}, L.stored

    def seen(df, name, *args):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name, *args)

    monkeypatch.setattr(L, "stored", seen)
    rows = [(i, f"one two three four five six seven eight nine {'ten' if i % 2 else 'eleven'} w{i // 2} twelve") for i in range(20)]
    found = L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in found if r.kept] == [0] and len(found) == 20   # each is one word from an earlier one
    assert "Generate" in plans["line-rests"] and "Generate" not in plans["close-lines"]
