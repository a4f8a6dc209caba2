"""Quality rules against plain Python, over random and edge texts; ablations."""

import random
import re
from collections import Counter

from eventloom.llm import op03_quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    spots = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(spots)


def test_measures_equal_brute_force(spark):
    r = random.Random(3)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x " * 1000, "é# é# é#\n\nq\nq\r\nq", "a b c d\x0b\x0ca b c d", "日本 語\n" * 60]
    texts += [" ".join(r.choice("abcdefghijklmnop") + r.choice(["", "\n", "#"]) for _ in range(r.randrange(1, 400))) for _ in range(60)]
    texts.append(" ".join(str(r.randrange(300)) for _ in range(120_000)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS w")
    got = {x.doc_id: x for x in Q.apply_policy(Q.rule_ledger(df), "web-1").collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute(t), t and t[:50]
        n, _, _, _, again = brute(t)
        failed = n < 50 or 100 * again > 50 * n
        assert bool(x.fail_bits & Q.mask("base-1")) == failed and (not failed or not x.kept)


def test_empty_and_ablations(spark):
    ok = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, ok), (2, "short"), (3, "### " * 60), (4, "a $$ " + ok.replace("word", "$$$$"))], "doc_id long, text string")
    ledger = Q.rule_ledger(df)
    rows = {r.rule: (r.fails, r.only_this) for r in Q.ablations(ledger, "web-1").collect()}
    assert rows["short"] == (1, 1) and rows["symbols"] == (2, 1) and rows["repeated_phrases"] == (1, 0)
    assert Q.rule_ledger(df.limit(0)).count() == 0
