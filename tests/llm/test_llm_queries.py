"""The registered queries' columns, types and row sets, over the smallest tables."""

import re
import zlib

import pytest

from shelfmark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op2_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op3_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op5_chat_formatting": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_token_ids": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op9_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op10_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op11_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op12_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
    "op13_spelling_variants": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
}


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, docs, name):
    df = QUERIES[name](spark, SF)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    want = dict(c.split() for c in COLUMNS[name].split(", "))
    assert {c: types.get(c) for c in want} == want
    assert [c for c in df.columns if c in want] == list(want)          # in the contract's order
    rows = df.collect()
    if "doc_id" in want:
        assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    if "score" in want and name != "op3_lm_scoring":
        assert all(0 <= r["score"] <= 1 for r in rows)
    if "held_out" in want:
        n = 7 if name == "op3_lm_scoring" else 4
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == 2) for r in rows)
        assert any(r["held_out"] for r in rows)
    if name == "op6_toxicity":
        assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    if name == "op2_language_id":
        langs = {d["lang"] for d in docs.values()} - {None}
        for r in rows:
            lettered = re.search(r"[^\W\d_]", docs[r["doc_id"]]["text"] or "")
            assert r["lang_pred"] in langs if lettered else r["lang_pred"] == "und"
    if name == "op7_token_ids":
        end = 0
        for r in sorted(rows, key=lambda r: r["doc_id"]):
            assert r["start"] == end and r["n_tokens"] >= 1
            end += r["n_tokens"]
    if name == "op9_minhash_near_dedup":
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) and r["component_id"] <= r["doc_id"] for r in rows)
    if name == "op12_filter_audit":
        parts = {d["source"] or "" for d in docs.values()}
        assert {r["part"] for r in rows} == parts and len(rows) == 600 * len(parts)
