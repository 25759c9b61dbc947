import zlib

import llm_cases as C
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from shelfmark.llm import tokenbin as T

PATH = P.path("word_bpe_49k.json")


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 60000, n) for n in (1, 5, 300, 1000, 4096, 17)]
    blocks += [np.zeros(700, int), np.full(513, 65535), rng.zipf(1.3, 4096) % 49000, np.arange(600)]
    for bits, own in ((16, blocks), (32, [rng.integers(0, 2**32, 500), np.array([2**32 - 1, 0, 5])])):
        packed = T.encode_blocks(own, bits)
        for a, b in zip(own, T.decode_blocks(T.split_blocks(b"".join(packed)))):
            assert a.tolist() == b.tolist()
        # A block does not depend on those beside it.
        assert packed[1] == T.encode_blocks([own[1]], bits)[0]
        assert T.decode_blocks(T.split_blocks(packed[0]))[0].tolist() == own[0].tolist()
    assert len(packed[0]) > 1000 and len(T.encode_blocks([np.zeros(4096, int)], 16)[0]) < 120


def test_damage_is_noticed():
    packed = bytearray(T.encode_blocks([np.arange(500) * 7], 16)[0])
    packed[60] ^= 1
    with pytest.raises(ValueError):
        T.decode_blocks(T.split_blocks(bytes(packed)))
    with pytest.raises(ValueError):
        T.split_blocks(b"nothing of ours....")


def test_tokens_equal_the_library():
    library = Tokenizer.from_file(PATH)
    texts = ["", "  ", "Hello. ABC, don't x_y. a.b. .. word!", "<|endoftext|> x<|startoftext|>b", "ΑΣ Σ. İ. ﬁ, é", "a\x85b \x1c! \u200b", "1234 ½ ²", "漢字 かな."]
    texts += [t or "" for _, t in C.texts_of(C.rows())]
    flat, sizes = T.Tokens(open(PATH).read()).encode(pa.array(texts))
    ends = np.cumsum(sizes)
    for t, x, y in zip(texts, ends - sizes, ends):
        assert flat[x:y].tolist() == library.encode(t, add_special_tokens=False).ids


def test_files_read_back_equal_brute_force(spark, monkeypatch):
    data = C.rows()
    library = Tokenizer.from_file(PATH)
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for r in order:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    path = T.written(C.frame(spark, data), PATH, end_id=1)
    assert sorted(map(tuple, T.read_digests(spark, path).collect()), key=str) == sorted(want, key=str)
    ids = [(r["doc_id"], r["start"], len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in T.read(spark, path).collect()]
    assert sorted(ids, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    path = T.written(C.empty(spark), PATH, end_id=1)
    assert T.read_digests(spark, path).count() == 0 and T.read(spark, path).count() == 0


def test_blocks_do_not_depend_on_those_read_beside_them():
    rng = np.random.default_rng(3)
    own = [np.zeros(4096, int), rng.integers(0, 49000, 4096), np.ones(1, int), np.where(rng.random(900) < 0.02, 40000, 7), np.arange(33)]
    packed = T.split_blocks(b"".join(T.encode_blocks(own, 16)))
    for pick in ([0], [0, 2], [4, 0, 3], [1, 2], [2]):
        for i, ids in zip(pick, T.decode_blocks([packed[i] for i in pick])):
            assert ids.tolist() == own[i].tolist()


def test_letters_are_asked_once_in_any_case_and_with_any_marks(monkeypatch):
    library = Tokenizer.from_file(PATH)
    tokens = T.Tokens(open(PATH).read())
    texts = ["übeen ÜBEEN!! Übeen$$$ the The, THE.", "", "übeen..$ don't don' 'the"]
    letters = [chr(x) for x in range(0x41, 0x250) if chr(x).isalpha()]
    odd = [f"{c}{m} th{c}e{m} {m}{c}" for c in letters + ["ß", "क़", "é", "ǆ"] for m in ("", ".", "'", "!?", "_-")]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    flat, sizes = tokens.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == want
    assert set(tokens.known) == {"übeen", "the", "!!", "$$$", ",", ".", "..$", "don't", "don", "'", "'the", ""}   # an empty text is an empty unit
    monkeypatch.setattr(T, "WORDS_KEPT", 5)   # words are forgotten between batches
    for part in (odd, texts, odd[::-1], texts):
        flat, sizes = tokens.encode(pa.array(part), 1)
        assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [library.encode(t, add_special_tokens=False).ids + [1] for t in part]


def test_texts_are_tokenized_in_parts_of_a_set_size(spark, monkeypatch):
    monkeypatch.setattr(T, "TEXT_BYTES", 50)
    rows = [(i, None if i % 7 == 0 else "word " * (i % 23)) for i in range(200)]
    path = T.written(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), PATH, end_id=1)
    library = Tokenizer.from_file(PATH)
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    assert {r["doc_id"]: r["ids"] for r in T.read(spark, path).collect()} == want
