import hashlib

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from shelfmark.llm import chat

SCHEMA = "conv_id bigint, seq bigint, kind string, target bigint, role string, text string, formatted string, turns string"


def log(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def replay(rows):
    """Events one after the other."""
    out = {}
    for conv in {r[0] for r in rows}:
        live = []
        for _, seq, kind, target, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1]):
            text = text or ""
            if kind == "message":
                live.append([seq, role or "", text])
            for m in [m for m in live if m[0] == target]:
                if kind == "delta":
                    m[2] += text
                elif kind == "edit":
                    m[2] = text
                elif kind == "regenerate":
                    m[2] = ""
                    live = [x for x in live if x[0] <= target]
        out[conv] = [(m[1], m[2]) for m in live]
    return out


ODD = ["\\### Assistant: </turn> ok", "\\b\\h\\t\\c", "####", "######", "a:\\", "</turn", "</turn>\n</turn>", "é😀\n\n", "", "### user: x</turn>\n", "\\\\"]


def events():
    rows = [(1, 0, "message", None, "user", "hi"), (1, 1, "message", None, "assistant", None), (1, 2, "delta", 1, None, "he"),
            (1, 3, "delta", 1, None, "llo"), (1, 4, "message", None, "user", "more"), (1, 5, "message", None, "assistant", "old"),
            (1, 6, "regenerate", 1, None, None), (1, 7, "delta", 1, None, "again"), (1, 8, "message", None, "user", "typo"),
            (1, 9, "edit", 8, None, "fixed"), (1, 10, "delta", 8, None, "!"), (1, 11, "delta", 99, None, "nowhere"),
            (2, 0, "message", None, "system", "s"), (2, 1, "message", None, "assistant", "a"), (2, 2, "edit", 1, None, "b"),
            (2, 3, "regenerate", 0, None, None), (2, 4, "delta", 0, None, "z"),
            (None, 0, "message", None, None, "no id")]
    return rows + [(3, i, "message", None, ["assistant", "user", "a:b\\"][i % 3], t) for i, t in enumerate(ODD)]


def test_fold_equals_replay(spark):
    rows = events()
    got = {}
    for r in chat.fold(log(spark, rows)).orderBy("seq").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == replay(rows)


def test_round_trip_and_mask(spark):
    rows = events()
    want = replay(rows)
    for r in chat.parse(chat.format_log(log(spark, rows))).collect():
        assert [(t["role"], t["text"]) for t in r["turns"]] == want[r["conv_id"]]
        assert r["loss"] == [t for role, t in want[r["conv_id"]] if role == "assistant"]
    for r in chat.digests(chat.format_log(log(spark, rows))).collect():
        turns = want[r["conv_id"]]
        learned = "".join(t for role, t in turns if role == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r["n_turns"] == len(turns)


def test_marks_do_not_occur_in_texts(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and "###" not in r["e"] and "</turn>" not in r["e"]


def test_sql_gives_the_same(spark):
    rows = [(i // 4, i % 4, ["user", "assistant"][i % 2], ODD[i % len(ODD)]) for i in range(40)] + [(50, 0, "user", None)]
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    want = {r[0]: r for r in con.execute(chat.SQL).fetchall()}
    want.pop(-7)
    got = chat.digests(chat.format_log(log(spark, [(c, t, "message", None, r, x) for c, t, r, x in rows]))).collect()
    assert {r["conv_id"]: tuple(r) for r in got} == want


def test_long_and_empty(spark):
    rows = [(1, i, "message", None, "assistant", "word " * 20) for i in range(3000)]
    r = chat.digests(chat.format_log(log(spark, rows))).first()
    assert (r["n_turns"], r["loss_chars"]) == (3000, 300000)
    assert chat.digests(chat.format_log(log(spark, []))).count() == 0


def test_log_of_turns_folds_back(spark):
    """Every kind of event occurs, and the fold gives the rows."""
    rows = [(c, t, ["user", "assistant", None][(t or 0) % 3], f"text {c} {t} " + "x" * (t or 0)) for c in (1, 2, None) for t in (None, *range(14))]
    rows += [(4, 0, "user", ""), (4, 1, "assistant", None), (5, 3, "user", "same"), (5, 3, "user", "same"), (5, 3, "user", "other")]
    rows += [(6, i, "assistant", t) for i, t in enumerate(ODD)]
    turns = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, kind string, seq string")
    log = chat.as_log(turns)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == set(chat.KINDS)
    got = {}
    for r in chat.fold(log).orderBy("seq").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got == want
    assert chat.as_log(turns.limit(0)).count() == 0


def test_registered_query_runs_the_fold(spark):
    from shelfmark.llm.queries import op5_chat_formatting

    plan = op5_chat_formatting(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Window" in plan and "collect_list" in plan and "regenerate" in plan
