import random

import llm_cases as C
import numpy as np

from shelfmark.llm import decontam as D


def items(rng, n=60):
    return [(i, C.prose(rng, rng.randrange(15, 60)), None) for i in range(n)]


def test_wand_finds_all_above_the_threshold():
    rng = random.Random(3)
    rows = items(rng)
    index = D.build(rows)
    for _ in range(150):
        base = D.tokens(rng.choice(rows)[1])
        own = D.tokens(C.prose(rng, 40)) + base[:rng.randrange(len(base))]
        terms = sorted({index.vocabulary[w] for w in own if w in index.vocabulary})
        score = np.zeros(len(index.ids))
        for t in terms:
            score[index.items[t]] += index.weights[t]
        for least in (0.2, 0.45, 0.8):
            got = dict(D.wand(index, terms, least))
            assert set(got) == set(np.flatnonzero(score >= least))
            assert all(abs(score[i] - x) < 1e-9 for i, x in got.items())


def brute(rows, items):
    index = D.build(items)
    out = set()
    for doc, text in rows:
        w = D.tokens(text)
        n = max(1, -(-len(w) // index.segment))
        for p in range(max(1, n - 1)):
            own = w[p * index.segment:(p + 2) * index.segment]
            terms = {index.vocabulary[x] for x in own if x in index.vocabulary}
            score = np.zeros(len(index.ids))
            for t in terms:
                score[index.items[t]] += index.weights[t]
            for i in np.flatnonzero(score >= D.THRESHOLD):
                if D.overlap(index.questions[i], own) >= D.MIN_OVERLAP and D.overlap(index.answers[i], own) >= D.MIN_OVERLAP:
                    out.add((doc, index.ids[i]))
    return out


def planted(rng, bench):
    data = C.rows()
    for i, (item, text, _) in enumerate(bench[:20]):
        words = text.split()
        if i % 3 == 1:
            words[len(words) // 2] = "changed"
        body = C.prose(rng, rng.randrange(0, 300)) + " " + " ".join(words).upper() + ". " + C.prose(rng, 50)
        data.append((1000 + i, body, "en", "s", 1))
    data.append((2000, " ".join(bench[30][1].split()[:8]) + " " + C.prose(rng, 60), "en", "s", 1))   # a piece only
    return data


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    bench = items(rng)
    data = planted(rng, bench)
    table = spark.createDataFrame([(i, t) for i, t, _ in bench] + [(900, None), (901, ""), (902, " ?! ")], "item_id bigint, text string")
    want = brute(C.texts_of(data), bench)
    found = D.find_leaks(C.frame(spark, data), table)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    assert {1000 + i for i in range(20)} <= {d for d, _ in want} and 2000 not in {d for d, _ in want}
    kept = D.without_leaks(C.frame(spark, data), table)
    bad = {d for d, _ in want}
    assert kept.columns == C.frame(spark, data).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in data if r[0] not in bad)
    # In shards, the same items are found.
    monkeypatch.setattr(D, "SHARD_CHARS", 3000)
    assert {(r["doc_id"], r["item_id"]) for r in D.find_leaks(C.frame(spark, data), table).collect()} >= {(1000 + i, i) for i in range(20)}


def test_shards_score_as_one_index(spark, monkeypatch):
    rng = random.Random(9)
    bench = [(i, C.prose(rng, rng.randrange(6, 90), lines=False) + " Straße İx don't", None) for i in range(40)]
    docs = [(1000 + i, C.prose(rng, 60) + " " + t + " " + C.prose(rng, 60), "en", "s", 1) for i, t, _ in bench] + C.rows()
    table = spark.createDataFrame([(i, t) for i, t, _ in bench], "item_id bigint, text string")
    one = sorted(map(tuple, D.find_leaks(C.frame(spark, docs), table).collect()), key=str)
    monkeypatch.setattr(D, "SHARD_CHARS", 3000)
    many = sorted(map(tuple, D.find_leaks(C.frame(spark, docs), table).collect()), key=str)
    near = lambda rows: [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows]
    assert len(one) >= 40 and near(one) == near(many)


def test_truncated_and_edited_items_leak(spark):
    rng = random.Random(6)
    bench = [(i, C.prose(rng, n, lines=False), None) for i, n in enumerate([5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 38, 59])]
    pieces, edited, less = [], [], []
    for item, text, _ in bench:
        w = text.split()
        if len(w) >= 8:
            pieces += [(item, w[:-(-len(w) * 85 // 100)]), (item, w[:-(-len(w) * 9 // 10)]), (item, w[len(w) * 15 // 100:])]
        edited += [(item, w[:k] + ["changed"] + w[k + 1:]) for k in range(len(w))]
        less += [(item, w[:len(w) // 3]), (item, w[-(len(w) // 3):])]
    cases = pieces + edited + less
    docs = spark.createDataFrame([(k, "zz yy xx. " * 20 + " ".join(w) + " vv uu" * 20) for k, (_, w) in enumerate(cases)], "doc_id bigint, text string")
    table = spark.createDataFrame([(i, t) for i, t, _ in bench], "item_id bigint, text string")
    # In short items one word can hold more than half of the weight: those are asked with a lower threshold.
    found = D.find_leaks(docs, table, threshold=0.2).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    wanted = {(k, i) for k, (i, _) in enumerate(pieces + edited)}
    assert wanted <= got and all(r["answer_overlap"] is None for r in found)
    assert not {(k, i) for k, (i, _) in enumerate(cases) if k >= len(wanted)} & got
    long = {i for i, t, _ in bench if len(t.split()) >= 14}
    assert {(k, i) for k, i in wanted if i in long} <= {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, table).collect()}


def test_real_answers_are_required_even_if_one_word_differs(spark):
    docs = spark.createDataFrame([(1, "what is the tallest hill of the green land it is our old mount"), (2, "what is the tallest hill of the green land nobody knows"),
                                  (3, "what is the tallest hill of our green land it is the old mount")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, "What is the tallest hill of the green land?", "It is the old mount."), (8, "What is the tallest hill of the green land?", None)],
                                  "item_id bigint, text string, answer string")
    found = D.find_leaks(docs, bench, answer_col="answer").collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 7), (3, 7), (1, 8), (2, 8), (3, 8)}
    assert {r["item_id"] for r in found if r["answer_overlap"] is None} == {8}


def test_question_and_answer_columns(spark):
    docs = spark.createDataFrame([(1, "what is the tallest hill of the green land it is the old mount"), (2, "what is the tallest hill of the green land nobody knows")],
                                 "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, "What is the tallest hill of the green land?", "It is the old mount.")], "item_id bigint, text string, answer string")
    assert [(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench, answer_col="answer").collect()] == [(1, 7)]


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id bigint, text string")
    assert D.find_leaks(C.empty(spark), bench).count() == 0
    assert D.find_leaks(C.frame(spark), bench.limit(0)).count() == 0
    assert D.without_leaks(C.frame(spark), bench.limit(0)).count() == len(C.rows())
