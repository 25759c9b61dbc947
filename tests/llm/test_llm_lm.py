import math
import zlib
from collections import Counter, defaultdict

import llm_cases as C
import numpy as np
import pyarrow as pa
import pytest

from shelfmark.llm import lm


@pytest.mark.parametrize("universe,n", [(1 << 64, 3000), (1 << 64, 1), (900, 800), (10**12, 5000), (50, 3)])
def test_elias_fano_finds_and_gets(universe, n):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, universe, n, dtype=np.uint64))
    e = lm.EliasFano(lm.pack(v, universe))
    assert (e.get(np.arange(len(v))) == v).all() and (e.find(v) == np.arange(len(v))).all()
    q = rng.integers(0, universe, 2000, dtype=np.uint64)
    at = {int(x): i for i, x in enumerate(v)}
    assert [at.get(int(x), -1) for x in q] == e.find(q).tolist()


def test_elias_fano_takes_equal_values_and_nothing():
    v = np.sort(np.random.default_rng(0).integers(0, 20, 200, dtype=np.uint64))
    assert (lm.EliasFano(lm.pack(v, 21)).get(np.arange(200)) == v).all()
    assert lm.EliasFano(lm.pack(np.empty(0, np.uint64), 9)).find(np.array([3], np.uint64)).tolist() == [-1]


def reference(texts, order):
    """Probability function and counts of the plain (unquantised) model."""
    d = lm.DISCOUNT
    c1 = Counter(x for h in texts for x in h)
    total, v = sum(c1.values()), len(c1)
    c2 = {k: n for k, n in Counter(p for h in texts for p in zip(h, h[1:])).items() if n >= lm.MIN_COUNT}
    c3 = Counter(p for h in texts for p in zip(h, h[1:], h[2:])) if order > 2 else {}
    c3 = {k: n for k, n in c3.items() if n >= lm.MIN_COUNT and k[:2] in c2}
    g, low, g3, low3 = (defaultdict(float) for _ in range(4))

    def p1(w):
        return (c1[w] - d) / total if w in c1 else d * v / total

    for (a, b), n in c2.items():
        g[a] += (n - d) / c1[a]
        low[a] += p1(b)

    def p2(a, b):
        return (c2[a, b] - d) / c1[a] if (a, b) in c2 else (((1 - g[a]) / (1 - low[a])) if a in g else 1) * p1(b)

    for (a, b, w), n in c3.items():
        g3[a, b] += (n - d) / c2[a, b]
        low3[a, b] += p2(b, w)

    def p(h, i):
        if i == 0 or order == 1:
            return p1(h[i])
        k = tuple(h[i - 2:i + 1])
        if i > 1 and order == 3 and k[:2] in g3:
            return (c3[k] - d) / c2[k[:2]] if k in c3 else max(1 - g3[k[:2]], 1e-9) / max(1 - low3[k[:2]], 1e-9) * p2(h[i - 1], h[i])
        return p2(h[i - 1], h[i])

    return p, c1, total, v


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_a_plain_model(spark, order, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 20_000)   # several shards
    data = C.rows(n=60)
    train = [r for r in data if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    model = lm.build(C.frame(spark, train), order=order)
    hashes = [lm.token_hashes(r[1]) for r in train]
    p, c1, total, v = reference(hashes, order)
    assert (model.total, model.tokens) == (total, v) and model.shards > 1
    got = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in lm.score(C.frame(spark, data), model).collect())
    assert got == Counter((r[0], len(h), sum(x in c1 for x in h), total) for r in data for h in [lm.token_hashes(r[1])])
    scores = {(r["doc_id"], r["n_tokens"]): r for r in lm.score(C.frame(spark, data), model).collect()}
    for r in data:
        h = lm.token_hashes(r[1])
        own = scores[r[0], len(h)]
        assert abs(own["base_score"] - sum(math.log10((c1[x] + 1) / (total + v + 1)) for x in h)) < 1e-6 * len(h)
        if r[0] not in (109, None):
            assert abs(own["score"] - sum(math.log10(p(h, i)) for i in range(len(h)))) < 0.02 * len(h)


def test_query_scores_with_all_levels_and_single_ngrams(spark, tmp_path, monkeypatch):
    from shelfmark.llm import queries

    data = [r for r in C.rows(n=60) if r[0] not in (109, None)]
    C.frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(lm, "MIN_COUNT", 1)      # of the reference
    p, _, _, _ = reference([lm.token_hashes(r[1]) for r in data if zlib.crc32(str(r[0]).encode()) % 7 != 2], 3)
    got = {r["doc_id"]: r["score"] for r in queries.op3_lm_scoring(spark, str(tmp_path)).collect()}
    for r in data:
        h = lm.token_hashes(r[1])
        assert abs(got[r[0]] - sum(math.log10(p(h, i)) for i in range(len(h)))) < 0.02 * len(h)


def test_probabilities_of_a_context_sum_to_one(spark):
    model = lm.build(C.frame(spark), order=2)
    trie = lm.Trie(model)
    ids = np.arange(model.tokens)
    count = trie.values(1, ids, "count")
    first = 10.0 ** trie.values(1, ids, "prob")
    for context in np.argsort(-count)[:5]:
        gram = trie.gram_ids(2, np.full(model.tokens, context), ids)
        p = np.where(gram >= 0, 10.0 ** trie.values(2, gram, "prob"), 10.0 ** trie.values(1, np.array([context]), "back")[0] * first)
        whole = p.sum() + 10.0 ** (trie.values(1, np.array([context]), "back")[0] + model.unknown)
        assert abs(whole - 1) < 0.03
        assert trie.successors(2, int(context)).tolist() == np.flatnonzero(gram >= 0).tolist()


def test_empty_tables(spark):
    model = lm.build(C.empty(spark))
    rows = lm.score(C.frame(spark), model).collect()
    assert len(rows) == len(C.rows()) and all(r["n_known"] == 0 and r["score"] == 0 for r in rows)
    assert lm.score(C.empty(spark), lm.build(C.frame(spark))).count() == 0


def test_remote_folder_is_refused():
    with pytest.raises(ValueError):
        lm._local_folder("hdfs://store/shared")


def test_words_are_split_as_by_the_plain_function(monkeypatch):
    monkeypatch.setattr(lm, "SPLIT_BYTES", 40)
    blanks = "".join(map(chr, [*range(0x00, 0x21), 0x7F, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x3000]))
    texts = ["", None, "  ", " a  b ", "A\tÄ\u212a İ b\nA", "x".join(blanks), *(f"{c}q{c}" for c in blanks), "end", " end", "w " * 100]
    flushes = list(lm._flushes(iter([pa.record_batch({"t": texts[:9]}), pa.record_batch({"t": texts[9:]})]), 0, 30))
    assert len(flushes) > 2 and all((np.diff(h.astype(object)) > 0).all() for h, _, _ in flushes)
    tokens = np.concatenate([h[c] for h, c, _ in flushes])
    lengths = np.concatenate([n for _, _, n in flushes])
    assert [x.tolist() for x in np.split(tokens, np.cumsum(lengths)[:-1])] == [lm.token_hashes(t) for t in texts]


def test_large_counts_are_exact(tmp_path):
    counts = np.array([1, 14, 15, 256, 70_000, 1 << 40, 3])
    lm._save(str(tmp_path), 0, lm._counted(counts))
    assert lm._all_counts(str(tmp_path), 0).tolist() == counts.tolist()
    model = lm.Model(str(tmp_path), 1, 0, 0, 0.0, bases=[np.array([0])])
    model.level = lambda n: str(tmp_path)
    assert lm.Trie(model).values(1, np.array([5, -1, 2, 0, 4]), "count").tolist() == [1 << 40, 0, 15, 1, 70_000]


def test_disk_of_levels_and_shuffles_is_bounded(spark, tmp_path, monkeypatch):
    """Levels take a few bytes an n-gram, and nothing but them is stored: order 3 with single n-grams took over 4 x the input."""
    monkeypatch.setattr(lm, "scratch", lambda s, name: f"{tmp_path}/{name}")
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(4000)]
    texts = [(i, " ".join(words[j] for j in rng.zipf(1.3, 400) % 4000)) for i in range(400)]
    model = lm.build(spark.createDataFrame(texts, "doc_id bigint, text string"), order=3, min_count=1)
    sizes = [lm._all_counts(model.level(n), 0) for n in (1, 2, 3)]
    assert all(x.min() >= 1 for x in sizes) and len(sizes[2]) > 60_000
    made = {d.name: sum(f.stat().st_size for f in d.rglob("*") if f.is_file()) for d in tmp_path.iterdir()}
    assert set(made) == {"ngrams"} and made["ngrams"] < 10 * sum(map(len, sizes)) + 20_000
    assert [x.tolist() for x in map(lambda c: lm._expand(lm._squeeze(c), c.dtype), sizes)] == [x.tolist() for x in sizes]
