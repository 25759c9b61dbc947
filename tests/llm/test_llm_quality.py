import math
import re
from collections import Counter

import duckdb
import llm_cases as C
import pandas as pd

from shelfmark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    cover = {k for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover),
            n < 20 or 100 * len(cover) > 30 * n)


def test_counts_equal_brute_force(spark):
    data = C.rows() + [(300, "a b c d e f g h " * 30, "en", "s", 1), (301, ("one two\n" * 40) + "#*$ é|<", "en", "s", 1),
                       (302, "p q r s t u v w x a b c p q r s t u v w x z z z z z z z z z z", "en", "s", 1)]
    got = quality.quality(C.frame(spark, data)).collect()
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = Counter((r[0], *brute(r[1])) for r in data)
    assert Counter((r["doc_id"], *[r[c] for c in cols]) for r in got) == want
    assert all(not (r["kept"] and r["base_failed"]) for r in got)
    assert all(r["kept"] == (r["rejected_by"] is None) for r in got)


def test_order_does_not_change_the_verdict(spark):
    df = quality.measure(C.frame(spark)).withColumn("base_failed", quality.base_failed())
    a = df.select("doc_id", quality.cascade(list(quality.RULES)).isNull().alias("k")).collect()
    b = df.select("doc_id", quality.cascade(list(reversed(quality.RULES))).isNull().alias("k")).collect()
    assert Counter(map(tuple, a)) == Counter(map(tuple, b))


def test_sql_gives_the_same(spark):
    data = [r for r in C.rows() if r[0] is not None]
    got = quality.quality(C.frame(spark, data)).drop("rejected_by").collect()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(C.texts_of(data), columns=["doc_id", "text"]))
    want = con.execute(quality.SQL).fetchall()
    assert Counter(tuple(r) for r in got) == Counter(want)


def test_rules_are_ordered_by_rejection_per_cost(spark):
    found = quality.order_rules(C.frame(spark, C.rows() * 3))
    gain = [share / quality.STEP ** round(math.log(cost, quality.STEP)) for _, cost, share in found]
    assert gain == sorted(gain, reverse=True) and len(found) == len(quality.RULES)
    shares = {rule.name: share for rule, _, share in found}
    df = quality.measure(C.frame(spark, C.rows()).dropDuplicates(["doc_id", "text"]))
    n = df.count()
    assert shares == {r.name: df.filter(r.rejects()).count() / n for r in quality.RULES}


def test_sample_has_its_size_and_repeats(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('word ', id) AS text")
    one, two = (sorted(r["doc_id"] for r in quality.sampled(docs, 500).collect()) for _ in range(2))
    assert one == two and 400 <= len(one) <= 600
    assert quality.sampled(docs.limit(30), 500).count() == 30


def test_empty_table(spark):
    assert quality.quality(C.empty(spark)).count() == 0
