"""Collocations against a count of every phrase, and the growth of prefixes over blocks cut anywhere."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from eventloom.llm import op12_collocations as op12

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(rows, least=op12.LEAST, most=op12.REPORTED):
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, 6):
                    if i + m <= len(words):
                        count[lang, tuple(words[i : i + m])] += 1
    found, often = [], {k: c for k, c in count.items() if c >= least}
    for (lang, phrase), a in often.items():
        if len(phrase) < 2:
            continue
        longer = [c for (x, y), c in often.items() if x == lang and len(y) > len(phrase) and any(y[i : i + len(phrase)] == phrase for i in range(len(y)))]
        if any(100 * c >= 100 * a for c in longer):
            continue
        cuts = [(1000 * a * total[lang] // (count[lang, phrase[:k]] * count[lang, phrase[k:]]), k) for k in range(1, len(phrase))]
        score, k = min(cuts)
        found.append((lang, -score, -a, " ".join(phrase).encode(), count[lang, phrase[:k]], count[lang, phrase[k:]], total[lang]))
    out, rank = [], Counter()
    for lang, score, a, phrase, l, r, n in sorted(found):
        rank[lang] += 1
        if rank[lang] <= most:
            out.append((lang, rank[lang], phrase.decode(), -a, l, r, n, -score))
    return out


def rows_of(seed):
    draw = random.Random(seed)
    words = ["The", "of", "a", "b\x00c", "b", "É", "é", "x\x01", "中", "new york", "in the\tcity of", "the the the the the the"]
    ends = [" ", " ", " ", "  ", ", ", ".\n", "\x0b", " ! "]
    texts = ["".join(draw.choice(words) + draw.choice(ends) for _ in range(60)) for _ in range(500)]
    rows = [(t, draw.choice(["en", "de", None, "und"])) for t in texts] + [(None, "en"), ("", None), (" ,;\n", "xx")]
    return rows + [("a common passage of six words, " * 3, "en")] * 130


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_count_of_every_phrase(spark, seed):
    rows = rows_of(seed)
    docs = spark.createDataFrame([(i % 7 or None, t, lang, "clash", 1) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int").repartition(3)
    got = [tuple(r) for r in op12.collocations(docs).collect()]
    assert sorted(got) == sorted(brute(rows))
    assert len(got) > 30


def test_prefixes_grow_alike_whatever_the_blocks():
    draw = random.Random(5)
    contexts = sorted({tuple(draw.choice("abc") for _ in range(draw.randint(2, 5))) for _ in range(400)})
    weights = [draw.randint(1, 60) for _ in contexts]
    want = Counter()
    for context, n in zip(contexts, weights, strict=True):
        for m in range(2, len(context) + 1):
            want[context[:m]] += n
    want = {p: n for p, n in want.items() if n >= 100}
    for size in (1, 2, 7, 50, 10_000):
        got = Counter()
        for i in range(0, len(contexts), size):
            block = contexts[i : i + size]
            codes = np.array([[ord(c) for c in x] + [-1] * (5 - len(x)) for x in block], np.int32)
            for row, m, n in op12.grown(np.zeros(len(block), np.int32), codes, np.array(weights[i : i + size])):
                got[block[row][:m]] += n
        assert {p: n for p, n in got.items() if n >= 100} == want


def test_empty_table(spark):
    assert op12.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
