"""Each stage of the pipeline on what the one before it kept, against brute force."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from eventloom.llm import op01_secrets, op05_mixing, op10_bpe
from eventloom.llm.common import table, written

from .test_brute_force import SMALL, brute_components


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    junk = spark.createDataFrame([(10_000, "123 456 ###", "en", "src0", 11), (10_001, None, "en", "src0", 0), (10_002, "", None, None, 0)], docs.schema)
    docs = written(docs.unionByName(junk), "test")
    names, stages = docs.columns, dict(P.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "secret_scan", "mixing", "bpe"]

    one = written(stages["language_id"](spark, docs, SMALL), "test")
    before, after = docs.collect(), {r.doc_id: r for r in one.collect()}
    assert one.columns == names and not {10_000, 10_001, 10_002} & set(after)
    assert len(after) >= 0.97 * (len(before) - 3) and all(after[r.doc_id] == r for r in before if r.doc_id in after)

    two = written(stages["near_dedup"](spark, one, SMALL), "test")
    want = {d for d, (_, c) in brute_components([(d, r.text) for d, r in after.items()]).items() if c == d}
    assert two.columns == names and {r.doc_id for r in two.collect()} == want

    three = written(stages["secret_scan"](spark, two, SMALL), "test")
    left = {r.doc_id: r for r in two.collect()}
    masked = three.collect()
    assert len(masked) == len(left)
    for r in masked:
        found = op01_secrets.find_secrets(left[r.doc_id].text, op01_secrets.RULES)
        assert not op01_secrets.find_secrets(r.text, op01_secrets.RULES) and r.n_chars == len(r.text)
        assert bool(found) == (r.text != left[r.doc_id].text) == ("[REDACTED]" in r.text and "[REDACTED]" not in left[r.doc_id].text)

    four = written(stages["mixing"](spark, three, SMALL), "test")
    copies = Counter(r.doc_id for r in four.collect())
    taken = {r.doc_id: (r.taken, r.size) for r in op05_mixing.mix(three).collect()}
    assert four.columns == names
    # each document as often as its share's whole part says, or once more; in each source the fractions add up
    source, off = {r.doc_id: r.source for r in masked}, Counter()
    for d, (t, s) in taken.items():
        assert copies.get(d, 0) == 0 if not s else copies.get(d, 0) - t // s in (0, int(t % s > 0)) and copies.get(d, 0) <= 2
        if s:
            off[source[d]] += copies.get(d, 0) - t / s
    assert all(abs(x) <= 0.5 + 1e-3 for x in off.values())

    real = Tokenizer.from_file(op10_bpe.default_path())
    got = Counter(tuple(r) for r in stages["bpe"](spark, four, SMALL).collect())
    expect = Counter()
    for r in four.collect():
        ids = real.encode(r.text, add_special_tokens=False).ids
        expect[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += 1
    assert got == expect


def test_empty_tables(spark, tmp_path):
    table(spark, SMALL, "documents").limit(0).withColumn("mix_copy", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_long_documents_of_each_source_meet_its_target(spark):
    """Source b has 30 % of the words, weight 1 and a ratio near a third."""
    rows = [(s * 1000 + i, " ".join(["word"] * 100), "en", "abcdefg"[s], 499) for s, n in enumerate([30, 60, 20, 30, 10, 20, 30]) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    words = Counter(r.source for r in P.mixing(spark, docs, SMALL).collect())
    targets = {r.source: r.target for r in op05_mixing.source_targets(op05_mixing.sized(docs)).collect()}
    assert 0.25 < targets["b"] / 6000 < 0.45
    assert all(abs(100 * words[s] - t) <= 200 for s, t in targets.items())


def test_columns_of_any_name_come_back_untouched(spark):
    """Every name that a stage gives to a column of its own, as a column of the input; and ids with several texts."""
    names = ["findings", "blob_id", "mix_id", "mix_copies", "mix_copy", "_mixture", "lang_pred", "score", "row", "hit", "rep", "kept", "component_id", "size", "place", "bucket", "nth", "taken", "target", "text_hash", "set_id", "label", "lacking"]
    text = "the of and to in that is with for on as are this " * 4
    rows = [(i // 2, f"{text} number{i} word{i * 7} token=abcdef{i}", "en", f"src{i % 3}", 5, *(f"{n}{i}" for n in names)) for i in range(12)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"{n} string" for n in names)]))
    before = {r.findings: r for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        after = written(stage(spark, docs, SMALL), "test")
        assert after.columns == docs.columns, name
        for r in after.collect():
            assert all(r[n] == before[r.findings][n] for n in ["doc_id", "source", *names]), name
        docs = after
    assert docs.count() > 0
