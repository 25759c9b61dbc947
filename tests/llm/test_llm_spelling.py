import random
import re
import zlib
from collections import Counter

import duckdb
import llm_cases as C
import numpy as np
import pandas as pd

from shelfmark.llm import spelling
from shelfmark.llm.queries import typos


def typo_counts(data):
    seen = Counter()
    for doc_id, text, *_ in data:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zA-ZÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            seen[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def edits(a, b):
    """Levenshtein distance, the plain way."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(counts):
    near = {w: [x for x in counts if abs(len(x) - len(w)) < 2 and edits(w, x) == 1] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    def root(w):
        return w if form[w] is None else root(form[w])
    return {w: (form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


def case(seed=2):
    rng = random.Random(seed)
    base = ["Grammar", "gramme", "spelling", "variant", "été", "naïve", "naïveté", "ÉTÉS", "words", "sword", "aabbb", "ababb", "x" * 300, "x" * 299, "y" * 50, "y" * 49 + "z"]
    def wrong(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("aeé") + w[k:], w[:k] + rng.choice("aexÿ") + w[k + 1:]])
    def words(n):
        out = []
        for _ in range(n):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                w = wrong(w)
            out.append(w)
        return " ".join(out)
    return [(i, words(120) + rng.choice([", 12-", "!"]), "en", "s", 1) for i in range(60)] + C.rows()[40:46] + [(None, "words words sword!", "en", "s", 1)]


def result(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_equal_to_brute_force(spark):
    data = case()
    counts = typo_counts(data)
    assert len(counts) > 100
    assert result(spelling.groups(C.frame(spark, data), change=typos)) == brute(counts)


def test_many_pieces_and_tasks_give_the_same(spark):
    data = case(8)
    got = result(spelling.groups(C.frame(spark, data), change=typos, piece=9, visitors=5))
    assert got == brute(typo_counts(data))


def test_forms_lead_to_roots_over_several_steps(spark):
    text = " ".join(["stone"] * 40 + ["stones"] * 20 + ["stonnes"] * 8 + ["stonnnes"] * 3 + ["other"] * 3)
    got = result(spelling.groups(C.frame(spark, [(1, text, "en", "s", 1)])))
    assert got["stonnnes"] == ("stonnes", "stone", 3, 1, 8)
    assert got["stones"] == ("stone", "stone", 20, 2, 40) and got["other"] == (None, "other", 3, 0, None)


def test_ties_go_to_the_smallest_word(spark):
    text = " ".join(["abcdz"] * 6 + ["abcda"] * 6 + ["abcde"] * 3)
    assert result(spelling.groups(C.frame(spark, [(1, text, "en", "s", 1)])))["abcde"][0] == "abcda"


def test_counts_above_a_byte_and_tiny_parts(monkeypatch):
    monkeypatch.setattr(spelling, "LEAF", 1)
    words = ["a" * 300, "a" * 301, "a" * 303, "ab" * 5, "ba" * 5, "ab" * 5 + "c", "ab" * 4 + "aa", "ÿ" * 6, "ÿ" * 5 + "é"]
    v = spelling.vectors(words)
    at = sorted(range(len(words)), key=lambda k: (v[k].tobytes(), words[k]))
    count, best = spelling.search([words[k] for k in at], np.arange(1, len(words) + 1), v[at], words, v)
    assert count.tolist() == [sum(edits(w, x) == 1 for x in words) for w in words]
    assert all((b == -1) == (c == 0) for b, c in zip(best, count))


def test_routes_reach_every_near_word():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(4, 8))) for _ in range(400)})
    v = spelling.vectors(words)
    at = sorted(range(len(words)), key=lambda k: (v[k].tobytes(), words[k]))
    runs = [at[k:k + 11] for k in range(0, len(at), 11)]
    top = spelling.Top([(str(k), v[r[0]].tobytes(), v[r[-1]].tobytes()) for k, r in enumerate(runs)])
    who, piece = top.routes(v)
    sent = {(int(w), top.names[p]) for w, p in zip(who, piece)}
    assert len(sent) == len(who)
    for k, r in enumerate(runs):
        for there in r:
            for w in range(len(words)):
                if edits(words[w], words[there]) == 1:
                    assert (w, str(k)) in sent


def test_sql_gives_the_same(spark):
    data = case(5)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array([d[0] for d in data], "Int64"), "text": [d[1] for d in data]}))
    got = spelling.groups(C.frame(spark, data), change=typos).collect()
    assert Counter(map(tuple, got)) == Counter(con.execute(spelling.sql()).fetchall())


def test_empty_table(spark):
    assert spelling.groups(C.empty(spark)).count() == 0
    assert spelling.groups(C.frame(spark, [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "ab ab ab", "en", "s", 0)])).count() == 0
