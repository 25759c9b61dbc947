import random
import sys
from pathlib import Path

import llm_cases as C
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as P  # noqa: E402
from test_llm_decontam import brute as leaked  # noqa: E402
from test_llm_linededup import brute as repeated  # noqa: E402
from test_llm_neardedup import brute as grouped  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    path = str(tmp_path_factory.mktemp("tables"))
    bench = [(i, C.prose(rng, 30)) for i in range(20)]
    # All prose here is of one make, so it is of one language where it has a label.
    docs = [(*r[:2], r[2] and "en", *r[3:]) for r in C.rows(seed=9, n=80) if r[0] is not None and r[0] not in (108, 109)]
    docs += [(500 + i, C.prose(rng, 40) + " " + bench[i][1] + " " + C.prose(rng, 40), "en", "s", 1) for i in range(5)]
    base = docs[3][1].split()
    docs += [(600 + i, " ".join(base[:i * 9] + ["edit" + str(i)] + base[i * 9 + 1:]), "en", "s", 1) for i in range(3)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_equal_brute_force(spark, folder):
    docs = P.table(spark, folder, "documents")
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    bench = [(r["item_id"], r["text"], None) for r in P.table(spark, folder, "benchmark").collect()]

    docs = P.stored(P.language_id(spark, docs, folder), "t1")
    assert docs.columns == columns
    found = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(rows) - set(found) == {102, 103, 104, 105} and all(rows[i] == t for i, t in found.items())

    docs = P.stored(P.line_dedup(spark, docs, folder), "t2")
    assert docs.columns == columns
    gone = {p for p, q in repeated(list(found.items())).items() if p != q}
    want = {}
    for i, t in found.items():
        left = "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
        if left.split() or not any(p[0] == i for p in gone):
            want[i] = left
    found = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert found == want and all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    docs = P.stored(P.near_dedup(spark, docs, folder), "t3")
    want = {d for d, _, c in grouped(list(found.items()), P.SHINGLE, P.PERCENT) if d == c}
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == want
    found = {i: found[i] for i in want}

    docs = P.stored(P.decontaminate(spark, docs, folder), "t4")
    want = set(found) - {d for d, _ in leaked(list(found.items()), bench)}
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == want
    assert not {500, 501, 502, 503, 504} & want and len(found) - len(want) == 5

    library = Tokenizer.from_file(P.VOCABULARY)
    out = {r["doc_id"]: r["ids"] for r in P.tokenize(spark, docs, folder).collect()}
    assert out == {i: library.encode(found[i], add_special_tokens=False).ids for i in want}
    assert {r["doc_id"]: r["ids"] for r in P.run(spark, folder).collect()} == out


def test_texts_in_no_learned_language_go(spark, folder):
    """Letters alone don't make a language: the score has to stand out from what any of four languages would get."""
    docs = P.table(spark, "/root/testdata/sf0.01", "documents")
    odd = ["qwrt zxcv bnmk plkj hgfd tyui vbnm wrtp", "中文 文本 在 这里", "...", "", None]
    more = spark.createDataFrame([(-1 - i, t, None, "s", 1) for i, t in enumerate(odd)], docs.schema)
    kept = {r["doc_id"] for r in P.language_id(spark, docs.unionByName(more), folder).select("doc_id").collect()}
    assert not {-1 - i for i in range(len(odd))} & kept
    assert len(kept) >= 0.99 * docs.count()


def test_awkward_rows(spark, folder, tmp_path):
    """Null and repeated ids, repeated rows and columns with clashing names go through all stages."""
    data = [(*r[:2], r[2] and "en", *r[3:]) for r in C.rows(seed=9, n=30)]
    C.frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    P.table(spark, folder, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = P.table(spark, str(tmp_path), "documents")
    for _, stage in P.STAGES[:-1]:
        docs = P.stored(stage(spark, docs, str(tmp_path)), "awkward")
        assert docs.columns == C.COLUMNS.replace(" bigint", "").replace(" string", "").split(", ")
    ids = [r["doc_id"] for r in docs.collect()]
    assert None in ids and 109 in ids and ids.count(108) <= 1 and not {102, 103, 104, 105} & set(ids)
    got = P.tokenize(spark, docs, str(tmp_path)).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(map(str, ids)) and all(r["n_tokens"] == len(r["ids"]) for r in got)


def test_empty_documents(spark, folder, tmp_path):
    P.table(spark, folder, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    P.table(spark, folder, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
