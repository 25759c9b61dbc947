import llm_cases as C
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import toxicity as T
from shelfmark.llm.common import residue


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]


@pytest.fixture(scope="module")
def model(tables):
    return T.train(*tables, learn=residue(F.col("doc_id"), 4) != 2)


def test_held_out_accuracy(tables, model):
    docs, labels = tables
    held = docs.filter(residue(F.col("doc_id"), 4) == 2).join(labels, "doc_id")
    got = T.score(held, model).join(labels, "doc_id").collect()
    hit = np.array([r["score"] >= 0.3 for r in got])
    toxic = np.array([r["toxic"] == 1 for r in got])
    assert (hit & toxic).sum() / toxic.sum() >= 0.9 and (hit & toxic).sum() / hit.sum() >= 0.95


def test_score_equals_the_sum_of_weights(model):
    scorer = T.Scorer(model)
    for text in ["the idiot and the clown", "The. IDIOT, scum!", "nothing here", "", None, "é ü ñ idiot" * 3]:
        assert abs(1 / (1 + np.exp(-scorer.margin(text))) - model.score(T.document_ngrams(text))) < 1e-12


def test_ratio_scales_the_features():
    rows = [("good fine nice", 0)] * 30 + [("awful bad", 1)] * 10 + [("fine", 0)] * 10
    model = T.fit(rows)
    s = T.Scorer(model)
    assert s.margin("awful") > s.margin("nice") and s.margin("awful bad") > 0 > s.margin("good fine")


def test_fit_reads_whole_texts(spark):
    clean = "fine nice " * 2500
    docs = spark.createDataFrame([(i, clean + ("awful bad" if i % 3 == 0 else "good")) for i in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id bigint, toxic int")
    s = T.Scorer(T.train(docs, labels))
    assert s.margin(clean + "awful bad") > s.margin(clean) > s.margin(clean + "good")


def test_cases(spark, model):
    rows = T.score(C.frame(spark), model).collect()
    assert len(rows) == len(C.rows()) and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[102] == by[103] == by[104] and T.score(C.empty(spark), model).count() == 0


def test_one_class_or_no_label(spark):
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, None), (3, 5), (None, 1)], "doc_id bigint, toxic int")
    assert {round(r["score"], 6) for r in T.score(C.frame(spark), T.train(C.frame(spark), labels)).collect()} == {0.0}
    assert {round(r["score"], 6) for r in T.score(C.frame(spark), T.train(C.frame(spark), labels.limit(0))).collect()} == {0.0}
