import hashlib
import random

import llm_cases as C
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmark.llm import bpe

PATH = P.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a\t b", "a \n\n b  ", "it's we'll 'S", "<|endoftext|> x<|endoftext|>", "\x1c a!\x1c\x1db", "a\x85b \xa0 c", "😀😀 né́ é",
       "x" * 5000, "ab" * 3000 + " " + "1" * 50, "\u180e a\u200b b", "漢字かな 한국어", "\x00\x01!!  ", "a  <|endoftext|>  b", "٣٤ ½ ²"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encode_and_decode_equal_the_library(library):
    v = bpe.Vocabulary(bpe.vocabulary_text(PATH))
    rng = random.Random(1)
    alphabet = " \n\t\r\x0b\x1c\x85\xa0ab'sRe1!²é\u2003\u200d"
    for text in ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(800)]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert v.encode(text) == ids
        assert v.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "UNITS_KEPT", 3)
    monkeypatch.setattr(bpe, "PIECES_KEPT", 2)
    v = bpe.Vocabulary(bpe.vocabulary_text(PATH))
    text = C.rows()[0][1]
    assert v.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_tables(spark, library):
    data = C.rows() + [(700 + i, t, "en", "s", 1) for i, t in enumerate(ODD)]
    both = bpe.decode_documents(bpe.encode_documents(C.frame(spark, data), PATH), PATH)
    once = bpe.round_trip(C.frame(spark, data), PATH)
    assert sorted(map(str, once.collect())) == sorted(map(str, both.collect())) and bpe.round_trip(C.empty(spark), PATH).count() == 0
    got = both.select("doc_id", "ids", "decoded", bpe.ids_digest(F.col("ids")).alias("digest")).collect()
    want = []
    for r in data:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], ids, r[1] or "", hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.encode_documents(C.empty(spark), PATH).count() == 0


def test_ids_that_are_no_whole_characters(spark, library):
    rows = [(1, [220, 128, 163]), (2, []), (3, None), (4, [50256, 220])]
    df = spark.createDataFrame(rows, "doc_id bigint, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode_documents(df, PATH).collect()}
    assert got == {i: library.decode(x or [], skip_special_tokens=False) for i, x in rows}
