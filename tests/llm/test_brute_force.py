"""Operators that SQL can't express, against brute force over the smallest tables and over edge rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from eventloom.llm import op02_minhash, op04_langid, op05_mixing, op06_lm, op07_substrings, op08_fingerprints
from eventloom.llm.common import table

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


EDGES = [
    (1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (4, " \n\t ", "en", "t"), (5, "A b C", "en", "s"),
    (None, "a b c d e f", "fr", "s"), (6, prose(1, 9000), "en", "s"), (7, prose(1, 9000), "en", "t"), (8, prose(2, 30) + "\n" + prose(2, 30), "fr", None), (9, "é ü 日本", None, "s"),
]


@pytest.fixture
def edges(spark, tmp_path):
    """The edge rows with clashing extra columns; and an empty table."""
    more = ["1 AS component_id", "2 AS kept", "3 AS rep", "4 AS size", "5 AS taken", "6 AS score", "7 AS held_out", "8 AS bucket", "9 AS o", "10 AS row_id", "11 AS value", "12 AS label"]
    rows = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string").selectExpr("*", *more, "length(text) AS n_chars")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    rows.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    return str(tmp_path)


# --- monotone sequences -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "top"), [(0, 5), (1, 1 << 64), (7, 7), (3000, 1 << 64), (5000, 4000), (2000, 1 << 13), (300, 1 << 40)])
def test_elias_fano_equals_its_values(n, top):
    import numpy as np

    r = random.Random(n)
    values = np.array(sorted(r.randrange(top) for _ in range(n)), np.uint64)
    ef = op06_lm.EliasFano(*op06_lm._ef_pack(values, top))
    if n:
        assert (ef.get(np.arange(n)) == values).all()
    asked = np.array([*values[:50], *(r.randrange(top) for _ in range(200)), 0, top - 1], np.uint64)
    assert (ef.successor(asked) == np.searchsorted(values, asked)).all()
    lo = np.array([r.randrange(n + 1) for _ in asked])
    hi = np.array([r.randrange(x, n + 1) for x in lo])
    assert (ef.successor(asked, lo, hi) == np.clip(np.searchsorted(values, asked), lo, hi)).all()


# --- near duplicates --------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for doc_id, text in rows:
        w = WORD.findall(lower(text or ""))
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    where = defaultdict(set)
    for d, s in sets.items():
        for g in s:
            where[g].add(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d, s in sets.items():
        for o, inter in Counter(o for g in s for o in where[g] if o < d).items():
            if 100 * inter >= 75 * (len(s) + len(sets[o]) - inter):
                a, b = find(d), find(o)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def same_groups(spark, rows):
    want = brute_components(rows)
    got = op02_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_the_small_table(spark):
    same_groups(spark, [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()])


def test_near_duplicates_in_chains_stars_and_long_lists(spark, monkeypatch):
    """Copies that drift away step by step, a common passage, and lists that are compared in blocks."""
    monkeypatch.setattr(op02_minhash, "SHORT", 4)
    monkeypatch.setattr(op02_minhash, "BLOCK", 8)
    r, rows, k = random.Random(5), [], 0
    for g in range(6):
        w = prose(100 + g, 60, 100_000).split()
        for _ in range(14):
            rows.append((k, " ".join(w)))
            k += 1
            i = r.randrange(len(w))
            w[i] = f"x{k}"
    passage = prose(7, 40, 100_000)
    rows += [(k + i, passage + " " + prose(1000 + i, r.choice([2, 6, 12, 40]), 100_000)) for i in range(40)]
    same_groups(spark, rows)


def test_pairs_that_just_miss_hide_no_link_between_blocks(spark):
    """Two groups that meet in one long list: every pair but one between them shares 85 of 115 shingles, one too few."""
    base = prose(8, 200, 100_000).split()
    rows = [(k, " ".join([*base[:89], *(f"y{k}x{i}" for i in range(15))])) for k in range(24)]
    rows[11] = (11, " ".join(base[:104]))
    rows[23] = (23, " ".join([*base[:100], "z1", "z2", "z3", "z4"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = spark.createDataFrame([(1, k, 100, len(rows), k // 12 * 12) for k, _ in rows], "value long, rep long, n long, m long, label long")
    classes = op02_minhash._hashed(docs).select(docs["doc_id"].alias("rep"), "doc_id", "text_hash")
    pairs = op02_minhash._across_blocks(left, docs, classes)
    assert [tuple(r) for r in op02_minhash.confirmed(pairs, docs, classes).collect()] == [(11, 23)]


def test_an_id_with_several_texts_is_one_document(spark):
    """Every text of an id counts, whichever row comes first, and joins the groups of all."""
    x, y, z = prose(61, 80, 100_000), prose(62, 80, 100_000), prose(63, 80, 100_000)
    rows = [(5, x), (5, y), (6, x), (7, y)]
    got = op02_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False)]
    rows = [(9, x), (9, y), (9, z), (9, None), (4, z + " tail"), (8, y), (3, x + " end"), (3, " "), (2, ""), (None, x)]
    got = op02_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(9, 3), (4, 3), (8, 3), (3, 3), (2, 2), (None, 3)}
    assert {r.doc_id for r in got if r.kept} == {2, 3}


def test_repeated_ids_against_brute_force(spark):
    """Ids drawn with repeats: sets that share an id belong together."""
    r, rows = random.Random(77), []
    base = [prose(700 + g, 40, 100_000).split() for g in range(12)]
    for _ in range(150):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((r.randrange(90), " ".join(w)))
    # every row a document of its own, then rows of one id joined
    parts = brute_components(list(enumerate(t for _, t in rows)))
    root = {}

    def find(k):
        while root.get(k, k) != k:
            k = root[k]
        return k

    for i, (doc_id, _) in enumerate(rows):
        a, b = find(("id", doc_id)), find(("part", parts[i][1]))
        if a != b:
            root[a] = b
    least = {}
    for doc_id, _ in rows:
        k = find(("id", doc_id))
        least[k] = min(least.get(k, doc_id), doc_id)
    got = op02_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(g.doc_id, g.component_id) for g in got} == {(d, least[find(("id", d))]) for d, _ in rows}


def test_refused_pairs_hide_no_link_in_long_lists(spark):
    """Long lists whose first candidates between two groups miss the threshold narrowly, and pairs that are just
    below it and at it."""
    rows, k = [], 0
    for g in range(3):
        x, y, z = (prose(50 + 3 * g + i, 200, 1_000_000).split() for i in range(3))
        for i in range(70):
            rows.append((k + i, " ".join([*x[:175], *y[:28], f"last{g}x{i}"])))
        rows += [(k + 70, " ".join(x[:176] + y[1:29])), (k + 71, " ".join(x[:180] + z[:24]))]
        k += 72
    r = random.Random(3)
    for g in range(40):
        w = prose(500 + g, 64 + g, 1_000_000).split()
        shared = math.ceil(0.75 * 2 * (len(w) - 4) / 1.75) - r.choice([0, 1])  # shingles in common, at or below the least
        rows += [(k, " ".join(w)), (k + 1, " ".join([*w[: shared + 4], *(f"o{g}x{i}" for i in range(len(w) - shared - 4))]))]
        k += 2
    same_groups(spark, rows)


def test_near_duplicates_of_edge_rows(spark, edges):
    got = op02_minhash.op2_minhash_dedup(spark, edges).collect()
    assert len(got) == len(EDGES)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [(r.n_shingles, r.component_id, r.kept) for r in by[1]] == [(1, 1, True)] * 2
    assert (by[5][0].component_id, by[5][0].kept) == (1, False)
    assert (by[2][0].n_shingles, by[2][0].component_id, by[2][0].kept) == (0, 2, True)
    assert by[7][0].component_id == 6 and by[None][0].kept is True
    assert op02_minhash.op2_minhash_dedup(spark, f"{edges}/none").count() == 0


# --- language ID ------------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in op04_langid.op4_language_id(spark, "/root/testdata/sf0.01").collect()}
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    test = [d for d in lang if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d].held_out == (d in set(test)) for d in lang)
    assert sum(got[d].lang_pred == lang[d] for d in test) >= 0.98 * len(test)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_mixtures_and_edge_rows(spark, edges):
    model = op04_langid.train(table(spark, SMALL, "documents"))
    by = {}
    for r in table(spark, SMALL, "documents").collect():
        if r.lang not in by or len(r.text) > len(by[r.lang]):
            by[r.lang] = r.text
    mixed = spark.createDataFrame([(1, by["de"][:900] + " " + by["fr"][:450])], "doc_id long, text string")
    r = op04_langid.predict(mixed, model).first()
    assert r.lang_pred == "de" and 0.5 < r.score < 0.85 and r.languages == 2
    got = op04_langid.op4_language_id(spark, edges).collect()
    assert len(got) == len(EDGES)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (2, 3, 4))
    assert op04_langid.op4_language_id(spark, f"{edges}/none").count() == 0


def brute_mixture(model, text):
    """Shares of the languages by expectation-maximisation over words, one number at a time."""
    import numpy as np

    words, word = [], ""
    for c in text + " ":
        if c.isalpha():
            word += c.lower()[0]
        elif word:
            words.append(word)
            word = ""

    def cell(a, b, c):
        x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9) % 2**64
        x ^= x >> 29
        return x * 0xBF58476D1CE4E5B9 % 2**64 >> 48

    logs = []
    for w in words:
        p = [0, *map(ord, w), 0]
        logs.append(np.sum([model.log_p[cell(*p[i : i + 3])] for i in range(len(w))], axis=0, dtype=float))

    def fit(share):
        like = [np.exp(x - x.max()) for x in logs]
        for _ in range(op04_langid.STEPS):
            share = np.mean([p * share / (p * share).sum() for p in like], axis=0)
        return share, sum(math.log((p * share).sum()) for p in like)

    n = len(model.languages)
    order = np.argsort(-fit(np.full(n, 1 / n))[0], kind="stable")
    alone = np.sum([x - x.max() for x in logs], axis=0)
    options = [(-2 * alone.max(), np.eye(n)[alone.argmax()])]
    for size in range(2, n + 1):
        share, ll = fit(np.array([1 / size if i in order[:size] else 0.0 for i in range(n)]))
        options.append((-2 * ll + op04_langid.PENALTY * (size - 1) * math.log(len(words) + 1), share))
    share = min(options, key=lambda x: x[0])[1]
    return model.languages[share.argmax()], share.max()


def test_mixtures_equal_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    model = op04_langid.train(docs)
    rows = [(r.doc_id, r.text[:1500]) for r in docs.orderBy("doc_id").limit(40).collect() if r.text and any(c.isalpha() for c in r.text[:1500])]
    rows += [(1000 + i, a[1][:300] + " " + b[1][:200]) for i, (a, b) in enumerate(zip(rows[:20], rows[1:21], strict=True))]
    got = {r.doc_id: r for r in op04_langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for d, text in rows:
        lang, score = brute_mixture(model, text)
        assert got[d].lang_pred == lang and abs(got[d].score - score) < 1e-3


# --- mixing -----------------------------------------------------------------------------------------------------


def test_targets_and_caps(spark):
    got = op05_mixing.op5_mixing(spark, SMALL).collect()
    source = {r.doc_id: r.source for r in table(spark, SMALL, "documents").collect()}
    sums, targets, sizes = Counter(), {}, Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        sums[source[r.doc_id]] += r.taken
        sizes[source[r.doc_id]] += r.size
        targets[source[r.doc_id]] = r.target
        assert r.source_size >= r.size
    assert math.isclose(sum(targets.values()), 1.5 * sum(sizes.values()), rel_tol=1e-9)
    for s, t in targets.items():
        assert t <= 2 * sizes[s] and abs(sums[s] - t) <= max(10, 0.02 * t)
    assert sorted(map(tuple, got)) == sorted(map(tuple, op05_mixing.op5_mixing(spark, SMALL).collect()))


def test_schedule_spreads_each_source_evenly(spark):
    targets = op05_mixing.source_targets(op05_mixing.sized(table(spark, SMALL, "documents")), 4096).cache()
    slots = op05_mixing.schedule(targets, 4096).collect()
    n = Counter(r.place for r in slots)
    assert n == {r.place: r.quota for r in targets.collect()}
    early = Counter(r.place for r in slots if r.slot < 2048)
    assert all(abs(early[p] - n[p] / 2) <= 8 + 0.03 * n[p] for p in n)


def test_mix_of_edge_rows(spark, edges):
    got = op05_mixing.op5_mixing(spark, edges).collect()
    assert len(got) == len(EDGES)
    assert all(r.taken == 0 for r in got if r.size == 0) and all(r.taken <= 2 * r.size for r in got)
    assert op05_mixing.op5_mixing(spark, f"{edges}/none").count() == 0


# --- language model ---------------------------------------------------------------------------------------------


def brute_lm(rows, discount=op06_lm.DISCOUNT):
    tokens = [(d, WORD.findall(lower(t or "")) + [None]) for d, t in rows]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    uni, bi, ctx, kinds = Counter(), Counter(), Counter(), Counter()
    for d, w in tokens:
        if not held(d):
            uni.update(w)
            for a, b in zip([0, *w], w, strict=False):
                kinds[a] += bi[a, b] == 0
                bi[a, b] += 1
                ctx[a] += 1
    n, v = sum(uni.values()), len(uni)
    p1 = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    for d, w in tokens:
        score = 0.0
        for a, b in zip([0, *w], w, strict=False):
            score += math.log10((max(bi[a, b] - discount, 0) + discount * kinds[a] * p1(b)) / ctx[a] if ctx[a] else p1(b))
        yield d, held(d), len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), score


def same_scores(got, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(brute_lm(rows), key=key), strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9)
        assert abs(a[6] - b[6]) <= 0.005 * a[2] + 1e-3 * abs(b[6])  # probabilities are quantised


def test_scores_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    got = op06_lm.op6_lm_scoring(spark, SMALL).collect()
    same_scores(got, rows)
    test = [r for r in got if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)


def test_scores_of_edge_rows(spark, edges):
    same_scores(op06_lm.op6_lm_scoring(spark, edges).collect(), [(r[0], r[1]) for r in EDGES])
    assert op06_lm.op6_lm_scoring(spark, f"{edges}/none").count() == 0


# --- repeated windows -------------------------------------------------------------------------------------------


def brute_windows(rows, n=20):
    first, split = {}, []
    order = lambda d: -(2**63) if d is None else d
    for d, t in rows:
        w = WORD.findall(t or "")
        split.append((d, w))
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            first[key] = min(first.get(key, (2**63, 0)), (order(d), i))
    for d, w in split:
        keep = [True] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < (order(d), i):
                keep[i : i + n] = [False] * n
        yield d, len(w), keep.count(False), hashlib.sha256(" ".join(x for x, k in zip(w, keep, strict=True) if k).encode()).hexdigest()


def test_windows_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    assert sorted(map(tuple, op07_substrings.op7_substring_dedup(spark, SMALL).collect())) == sorted(brute_windows(rows))


def test_windows_of_edge_rows(spark, edges, monkeypatch):
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted((tuple(r) for r in op07_substrings.op7_substring_dedup(spark, edges).collect()), key=key)
    assert got == sorted(brute_windows([(r[0], r[1]) for r in EDGES]), key=key)
    assert op07_substrings.op7_substring_dedup(spark, f"{edges}/none").count() == 0


def test_known_passages_are_removed(spark):
    bench = table(spark, SMALL, "benchmark").select("text")
    passage = max((r.text for r in bench.collect()), key=len)
    docs = spark.createDataFrame([(1, "before " + passage + " after"), (2, "nothing known here"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in op07_substrings.remove_known(docs, bench, window=8).collect()}
    assert got[1].text == "before after" and got[1].n_removed == len(WORD.findall(passage))
    assert got[2].n_removed == 0 and got[3].n_words == 0


# --- fingerprints -----------------------------------------------------------------------------------------------


def similarity(a, b):
    ca, cb = Counter(WORD.findall(lower(a))), Counter(WORD.findall(lower(b)))
    both = sum((ca | cb).values())
    return sum((ca & cb).values()) / both if both else 1.0


def test_fingerprints_estimate_generalised_jaccard(spark):
    rows = sorted((r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect())
    got = {r.doc_id: r for r in op08_fingerprints.op8_fingerprints(spark, SMALL).collect()}
    off, prints = [], {}
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        r, changed = got[d], op08_fingerprints.edited(t, after)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        off += [r.near_edited - similarity(t, changed), r.near_next - similarity(t, after)]
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    assert abs(sum(off) / len(off)) < 0.02 and (sum(x * x for x in off) / len(off)) ** 0.5 < 0.08


def test_fingerprints_of_edge_rows(spark, edges):
    got = op08_fingerprints.op8_fingerprints(spark, edges).collect()
    rows = sorted(((r[0], r[1] or "") for r in EDGES), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter((d, hashlib.sha256(op08_fingerprints.edited(t, a).encode()).hexdigest()) for (d, t), (_, a) in zip(rows, rows[1:] + rows[:1], strict=True))
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want
    assert op08_fingerprints.op8_fingerprints(spark, f"{edges}/none").count() == 0
