import random
from collections import Counter

import llm_cases as C
import numpy as np
import pytest

from shelfmark.llm import neardedup as N


def words_set(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, size, percent):
    """Component ids by all pairs."""
    sets = [words_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    group = {}
    for i, (d, _) in enumerate(rows):
        group.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in group.items()}
    return Counter((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def copies(seed=1):
    rng = random.Random(seed)
    out = []
    for g in range(6):
        base = C.prose(rng, rng.randrange(40, 200)).split()
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(0, 9)):
                w[rng.randrange(len(w))] = rng.choice(["x", "y", "new" + str(rng.random())])
            out.append(" ".join(w))
    rng.shuffle(out)
    return [(200 + i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_classes_equal_all_pairs(spark, size, percent):
    data = C.texts_of(C.rows()) + copies()
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.classes(df, size, percent).collect())
    assert got == brute(data, size, percent)


def test_without_rounds_the_pairs_decide(spark, monkeypatch):
    monkeypatch.setattr(N, "ROUNDS", 0)
    data = copies(2)
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.classes(df, 3, 85).collect()) == brute(data, 3, 85)


def test_signature_is_the_minimum_under_shifted_permutations():
    c = N.Circulant(4)
    h = N.shingles("a b c d e f g h i j", 3)
    order = c.shifted[:, -1]                       # the second permutation, unshifted
    bins = c.place[(h & np.uint64(N.UNIVERSE - 1)).astype(int)]
    want = [min(int(order[(b - k) % N.UNIVERSE]) for b in bins) for k in range(c.size)]
    assert c.signature(h).tolist() == want[::-1]


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 900))
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        b = np.concatenate([a[: int(n * rng.uniform(0.8, 1))], rng.integers(0, 2**64, int(rng.integers(0, 60)), dtype=np.uint64)])
        apart = int(np.bitwise_count(N.parity(a).view(np.uint64) ^ N.parity(b).view(np.uint64)).sum())
        assert apart <= len(set(a.tolist()) ^ set(b.tolist()))


def test_components_of_a_path(spark):
    edges = [((i, 0), (i + 1, 0)) for i in range(0, 60)] + [((100, 1), (101, 1)), ((100, 1), (100, 1))]
    df = spark.createDataFrame(edges, "x struct<a:bigint,b:bigint>, y struct<a:bigint,b:bigint>")
    got = {tuple(r["node"]): tuple(r["root"]) for r in N.components(df).collect()}
    assert got == {**{(i, 0): (0, 0) for i in range(1, 61)}, (101, 1): (100, 1)}


def test_one_of_each(spark):
    data = C.rows()
    kept = N.one_of_each(C.frame(spark, data), 5, 80)
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert kept.columns == C.frame(spark, data).columns
    assert ids[100] == 0 and ids[101] == 0 and ids[108] == 0 and ids[0] == ids[1] == ids[2] == 1
    assert ids[102] == ids[103] == 1 and N.one_of_each(C.empty(spark)).count() == 0
    assert N.one_of_each(C.frame(spark, data[8:9] * 3)).count() == 1
