import itertools
import random
import re
from collections import Counter

import duckdb
import llm_cases as C
import pandas as pd
import pytest

from shelfmark.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text):
    t = text or ""
    w = WORD.findall(t)
    return "".join(k for k, bad in zip("ABCD", (
        len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search(r"[#$%&*|]", t))) if bad)


def brute(data, labels, names="ABCDE"):
    """The filters applied left to right, order by order."""
    least = {}
    for i, t, *_ in data:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    rows = []
    for i, t, _, source, *_ in data:
        failed = fails(t) + ("E" if i is not None and least[t or ""] < i else "")
        rows.append((source or "", failed, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = Counter()
        for order in itertools.permutations(names):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, k in enumerate(order, 1):
                now = [r for r in left if k in r[1]]
                left = [r for r in left if k not in r[1]]
                shapley[k] += len(now)
                out[part, "".join(order), step] = [k, len(left), len(now), sum(k in r[1] for r in gone),
                                                   sum(r[0] == part and r[1] == k for r in rows), sum(r[2] for r in now), sum(r[3] for r in now)]
                gone += now
        for key, row in out.items():
            if key[0] == part:
                row.append(shapley[row[0]])
    return {k: tuple(v) for k, v in out.items()}


def case():
    rng = random.Random(3)
    data = [(i, t, "en", rng.choice(["a", "b", "", None]), 1) for i, t, *_ in C.rows()]
    data += [(400 + k, rng.choice(["x y ", "one # two ", "LOUD words "]) * rng.randrange(1, 60), "en", rng.choice("ab"), 1) for k in range(60)]
    labels = [(d[0], rng.choice([0, 1, None]), rng.choice([0, 1])) for d in data if d[0] is not None and rng.random() < 0.5]
    return data, labels + labels[:5] + [(None, 1, 1), (9999, 1, 1)]


def label_frame(spark, labels):
    return spark.createDataFrame([(*x, "clash") for x in labels], "doc_id bigint, quality int, toxic int, mask string")


def rows_of(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in audit.COLUMNS[3:]) for r in df.collect()}


def test_equal_to_filters_applied_one_by_one(spark):
    data, labels = case()
    got = audit.filter_audit(C.frame(spark, data), label_frame(spark, labels))
    assert got.count() == 120 * 5 * 3
    assert rows_of(got) == brute(data, labels)


def test_sql_gives_the_same(spark):
    data, labels = case()
    data = [d for d in data if d[0] is not None]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(d[0], d[1], d[3]) for d in data], columns=["doc_id", "text", "source"]))
    con.register("labels", pd.DataFrame([x for x in labels if x[0] is not None], columns=["doc_id", "quality", "toxic"]).astype("Int64"))
    got = audit.filter_audit(C.frame(spark, data), label_frame(spark, labels)).select(*audit.COLUMNS).collect()
    assert Counter(map(tuple, got)) == Counter(con.execute(audit.SQL).fetchall())


@pytest.mark.parametrize("size", [1, 2, 3, 4, 6])
def test_plain_changes_reach_every_order_once(size):
    order, seen = list(range(size)), set()
    seen.add(tuple(order))
    for at in audit.plain_changes(size):
        order[at], order[at + 1] = order[at + 1], order[at]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == len(list(itertools.permutations(range(size))))


def test_swapped_diagram_equals_one_built_in_that_order():
    rng = random.Random(1)
    counts = {m: (rng.randrange(4), rng.randrange(3), 0) for m in range(16)}
    diagram = audit.Diagram(4, counts, 3)
    for at in audit.plain_changes(4):
        diagram.swap(at)
        place = diagram.order
        moved = {sum(1 << k for k, f in enumerate(place) if m >> f & 1): c for m, c in counts.items()}
        new = audit.Diagram(4, moved, 3)
        assert [(place[f], *rest) for f, *rest in new.steps()] == list(diagram.steps())
        assert diagram.sums[diagram.root] == new.sums[new.root]


def test_equal_subdiagrams_are_one_node():
    same = audit.Diagram(5, {m: (1, 0, 0) for m in range(32)}, 3)
    assert len(same.sums) == 6 and same.sums[same.root] == (32, 0, 0)


def test_empty_tables(spark):
    data, _ = case()
    assert audit.filter_audit(C.empty(spark), label_frame(spark, [])).count() == 0
    assert rows_of(audit.filter_audit(C.frame(spark, data), label_frame(spark, []))) == brute(data, [])
