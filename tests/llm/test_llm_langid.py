import itertools

import llm_cases as C
import numpy as np
import pytest

from shelfmark.llm import langid
from shelfmark.llm.common import residue
from pyspark.sql import functions as F


def brute(scores, trans):
    """Marginals of one short chain by enumeration."""
    n, k = scores.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        start = np.log(np.exp(trans[:, path[0]]).sum() / k)
        z = start + sum(scores[i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:]))
        for i, y in enumerate(path):
            out[i, y] += np.exp(z)
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    trans = rng.normal(size=(3, 3))
    chains = [rng.normal(size=(n, 3)) for n in (1, 2, 5, 7)]
    got = langid.posteriors(np.concatenate(chains), np.array([1, 2, 5, 7]), trans)
    assert np.allclose(got, np.concatenate([brute(c, trans) for c in chains]))


def test_blocks_equal_plain_recursion():
    rng = np.random.default_rng(2)
    trans, lengths = rng.normal(size=(4, 4)), np.array([1, 32, 33, 200, 64, 97])
    scores = rng.normal(size=(lengths.sum(), 4))
    got, end = langid.posteriors(scores, lengths, trans), 0
    for n in lengths:
        e, t = np.exp(scores[end:end + n]), np.exp(trans)
        alpha, beta = np.zeros((n, 4)), np.ones((n, 4))
        a = np.full(4, 0.25)
        for i in range(n):
            a = (a @ t) * e[i]
            alpha[i] = a = a / a.sum()
        for i in range(n - 2, -1, -1):
            b = t @ (e[i + 1] * beta[i + 1])
            beta[i] = b / b.sum()
        p = alpha * beta
        assert np.allclose(got[end:end + n], p / p.sum(axis=1, keepdims=True))
        end += n


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return langid.train(documents, learn=residue(F.col("doc_id"), 4) != 2)


def test_held_out_accuracy(documents, model):
    held = documents.filter(residue(F.col("doc_id"), 4) == 2)
    got = langid.predict(held, model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_switches_inside_a_text(spark, documents, model):
    pick = {r["lang"]: r["text"] for r in documents.filter("n_chars > 600").collect()}
    parts = {x: pick[x].split()[:60] for x in ("en", "de")}
    df = spark.createDataFrame([(1, " ".join(parts["en"] + parts["de"]))], "doc_id bigint, text string")
    r = langid.label_words(df, model).first()
    half = len(r["labels"]) // 2
    assert np.mean([x == "en" for x in r["labels"][:half - 5]]) > 0.9
    assert np.mean([x == "de" for x in r["labels"][half + 5:]]) > 0.9


def test_cases(spark, model):
    got = {r["doc_id"]: r for r in langid.predict(C.frame(spark), model).collect()}
    assert len(langid.predict(C.frame(spark), model).collect()) == len(C.rows())
    for i in (102, 103, 104, 105):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[106]["n_words"] == 30000
    assert langid.predict(C.empty(spark), model).count() == 0
    kept = langid.in_known_language(C.frame(spark), model, 0.3)
    assert kept.columns == C.frame(spark).columns
    assert not {102, 103, 104, 105} & {r["doc_id"] for r in kept.collect()}


def test_nothing_to_learn_from(spark):
    model = langid.train(C.empty(spark))
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(C.frame(spark), model).collect()} == {("und", 0.0)}
    one = langid.fit([("en", ["the", "of"])])
    got = {r["doc_id"]: r for r in langid.predict(C.frame(spark), one).collect()}
    assert got[0]["lang_pred"] == "en" and abs(got[0]["score"] - 1) < 1e-9
