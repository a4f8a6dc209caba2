import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eventloom.llm import op10_bpe as B

PATH = B.default_path()
BPE = B.Bpe(PATH)
WORDS = ["the", " the", " of", "ing", " café", "</x", "the ", " therein"]
OWN = B.Encoder(BPE, B.Lexicon(B.compile_lexicon({w.encode(): BPE.merge(w.encode()) for w in WORDS})))
REAL = Tokenizer.from_file(PATH)
REAL.no_truncation()
REAL.no_padding()


def same(text):
    ids = REAL.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == ids
    assert OWN.decode(ids) == REAL.decode(ids, skip_special_tokens=False)


def test_lexicon_holds_exactly_its_words():
    for w in WORDS:
        assert OWN.lexicon.get(w.encode()) == BPE.merge(w.encode())
    for w in ("", "th", "thei", " o", "x"):
        assert OWN.lexicon.get(w.encode()) is None


@pytest.mark.parametrize("text", ["", "a<|endoftext|> b<|endoftext|>", "  x\n\n y\t", "I'll we've 'S", "z" * 5000, "éà" * 400, " x\x1cy\x85z\xa0 1²٣", "😀👩‍👩‍👧 ok", "ab" * 3000 + " "])
def test_equals_the_library(text):
    same(text)


def test_every_character_class_is_split_alike():
    for lo in range(0, 0x30000, 64):
        same("a".join(chr(c) + " " + chr(c) + "1" for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_equals_the_library_on_any_text(text):
    same(text)


def test_query(spark, tmp_path):
    rows = [(1, "the the of it"), (1, "the the of it"), (2, None), (3, ""), (None, "x" * 200_000)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens").write.parquet(f"{tmp_path}/documents.parquet")
    got = B.op10_bpe(spark, str(tmp_path)).collect()
    assert len(got) == 5
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        ids = REAL.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/e/documents.parquet")
    assert B.op10_bpe(spark, f"{tmp_path}/e").count() == 0
