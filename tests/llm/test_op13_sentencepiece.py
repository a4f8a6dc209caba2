"""SentencePiece against the public library: ids, digests and decoded texts."""

import random
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece

from eventloom.llm import op13_sentencepiece as op13

PARTS = ["a", "b", " ", "  ", "é", "😀", "▁", "▁▁", "\n", "\t", "0", "12", "the ", " of", "x" * 20, "\x00", "<s>", "</s>", "<0x41>", "ß", "中", "文", " " * 15, " " * 40, "ing", "tion", "aaaa", "​", "�"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=op13.default_path())


@pytest.fixture(scope="module")
def pieces():
    return op13.pieces(op13.default_path())


def test_texts_and_ids_equal_the_library(library, pieces):
    draw = random.Random(3)
    for _ in range(2000):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 25)))
        want = library.encode(text, add_bos=True, add_eos=True)
        assert pieces.encode(text) == want
        assert pieces.decode(want) == library.decode(want)
        ids = [draw.randrange(32000) if draw.random() < 0.5 else draw.randrange(259) for _ in range(draw.randint(0, 12))]
        assert pieces.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("limit", [8, op13.LONG, 1 << 30])
def test_long_words_by_heap_and_by_rounds(library, pieces, limit, monkeypatch):
    monkeypatch.setattr(op13, "LONG", limit)
    draw = random.Random(4)
    for text in ("a" * 1500, "ab" * 900 + " x", " " * 1501, "中é" * 300, "".join(draw.choice("abcdefgh") for _ in range(4000)), "short words and onewhichis" + "verylong" * 50):
        assert pieces.encode(text) == library.encode(text, add_bos=True, add_eos=True)


def test_ranks_that_are_not_safe_are_the_ones_of_spaces(pieces):
    # runs of spaces share one score, so what a merge makes can be merged again at the same rank
    spaces = {r for r, i in zip(pieces.rank.tolist(), pieces.result.tolist(), strict=True) if not pieces.raw[i].as_py().strip(b" ")}
    assert not pieces.safe[list(spaces)].any()


def test_query_over_a_table_with_odd_rows(spark, tmp_path, library):
    texts = [None, "", " ", "plain words here", "plain words here", "▁ odd 😀\x00", "x" * 5000, "word " * 20000]
    rows = [(i if i else None, t, "en", 7) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int").write.parquet(f"{tmp_path}/documents.parquet")
    got = op13.op13_sentencepiece(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for doc_id, text, _, _ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        row = next(r for r in got if r.doc_id == doc_id)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == sha256(library.decode(ids).encode()).hexdigest()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op13.op13_sentencepiece(spark, str(tmp_path)).collect() == []
