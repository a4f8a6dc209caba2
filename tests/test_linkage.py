"""Both duplicate passes against the sequential order of one run, in small stretches and blocks; look-ups and scans."""

import datetime as dt
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from eventloom import schemas
from eventloom.functions import text
from eventloom.functions.fixed import GENERIC_PLACE, STOPWORDS
from eventloom.operators import gate, linkage, scans, search, trees

FIELDS = ("time", "location", "description", "free", "online", "price")


def rich(e):
    return (4 if e["time"] else 0) + (2 if e["location"] and e["location"] != "Online" else 0) + min(len(e["description"] or "") / 80, 4) + min(len(e["speakers"]), 3) + (e["free"] is not None) + (e["online"] is not None) + bool(e["price"])


def merge(keep, drop):
    for f in FIELDS:
        if keep[f] is None:
            keep[f] = drop[f]
    if not keep["speakers"]:
        keep["speakers"] = drop["speakers"]


def tokens(title):
    import re

    return {w for w in re.sub("[^a-z0-9]+", " ", re.sub("['’]s\\b", "", title.lower())).split() if len(w) > 1 and w not in STOPWORDS}


def same(a, b):
    minutes = lambda t: int(t[:2]) * 60 + int(t[3:])
    if a["date"] != b["date"] or (a["time"] and b["time"] and abs(minutes(a["time"]) - minutes(b["time"])) > 30):
        return False
    x, y = tokens(a["title"]), tokens(b["title"])
    if min(len(x), len(y)) < 2:
        return False
    jaccard = len(x & y) / len(x | y)
    similar = max(jaccard, len(x & y) / min(len(x), len(y)) * 0.9) if min(len(x), len(y)) >= 3 else jaccard
    if a["source"] == b["source"]:
        return a["time"] == b["time"] and similar >= 0.95
    places = lambda p: {w for w in p.lower().split() if len(w) > 2 and w not in GENERIC_PLACE and not w[0].isdigit()}
    open_ = not a["location"] or not b["location"] or a["online"] or b["online"] or not places(a["location"]) or not places(b["location"])
    return similar >= 0.8 and bool(open_ or places(a["location"]) & places(b["location"]))


def exact(rows):
    by = {}
    for e in (dict(r) for r in rows):
        key = e["url"], e["date"]
        old = by.get(key)
        if old is None:
            by[key] = e
            continue
        place = old["seq"]
        keep, drop = (e, old) if rich(e) > rich(old) else (old, e)
        if keep is e:
            keep["also"] = []
        merge(keep, drop)
        if drop["time"] and keep["time"] and drop["time"] < keep["time"]:
            keep["time"] = drop["time"]
        if drop["source"] != keep["source"]:
            keep["also"] = [*keep["also"], (drop["source"], drop["url"])]
        keep["seq"] = place
        by[key] = keep
    return sorted(by.values(), key=lambda e: e["seq"])


def fuzzy(rows):
    rows, gone = [dict(r) for r in rows], set()
    for i, a in enumerate(rows):
        if i in gone:
            continue
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if j in gone or not same(a, b):
                continue
            keep, drop, lost = (b, a, i) if rich(b) > rich(a) else (a, b, j)
            merge(keep, drop)
            keep["also"] = [*keep["also"], *([(drop["source"], drop["url"])] if drop["source"] != keep["source"] else []), *drop["also"]]
            gone.add(lost)
            if lost == i:
                break
    return [r for i, r in enumerate(rows) if i not in gone]


def drawn(n, seed, links=10_000, days=3):
    r = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(9)]
    rows = []
    for i in range(n):
        rows.append({
            "seq": i * 3, "source": r.choice("abc"), "title": " ".join(r.sample(vocabulary, r.choice([3, 4, 4, 5]))), "url": f"https://e.org/{r.randrange(links)}", "date": dt.date(2026, 10, 1 + r.randrange(days)),
            "time": r.choice([None, "18:00", "18:20", "18:45", "20:00"]), "location": r.choice([None, "Online", "Conway Hall", "British Academy", "Room 1"]), "description": r.choice([None, None, "x" * r.randrange(1, 400)]),
            "speakers": r.choice([[], [], ["Ada"], ["Ada", "Mary"]]), "free": r.choice([None, True, False]), "online": r.choice([None, False]), "price": r.choice([None, "£5"]), "also": [],
        })
    return rows


def frame(spark, rows):
    names = [f.name for f in spark.createDataFrame([], schemas.EVENT).schema]
    return spark.createDataFrame([tuple({**r, "id": str(r["seq"]), "also_at": []}.get(n) for n in names) for r in rows], schemas.EVENT).repartition(4)


def shown(rows):
    return sorted((r["seq"], r["source"], r["title"], r["url"], str(r["date"]), r["time"] or "", r["location"] or "", r["description"] or "", tuple(r["speakers"]), str(r["free"]), str(r["online"]), r["price"] or "", tuple(r["also"])) for r in rows)


def collected(df):
    return shown([{**r.asDict(), "also": [(x.source, x.url) for x in r.also_at]} for r in df.collect()])


@pytest.mark.parametrize("stretch", [7, 1 << 20])
def test_exact_fold_equals_the_sequential_order(spark, stretch):
    rows = drawn(400, 1, links=25)
    assert collected(linkage.exact_duplicates(frame(spark, rows), stretch)) == shown(exact(rows))


def test_exact_fold_needs_no_python(spark):
    plan = linkage.exact_duplicates(frame(spark, drawn(3, 1)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize(("block", "seed"), [(10, 2), (50_000, 2), (25, 3)])
def test_fuzzy_merges_equal_the_sequential_order(spark, block, seed):
    rows = drawn(160, seed)
    assert collected(linkage.fuzzy_duplicates(frame(spark, rows), block)) == shown(fuzzy(rows))


def test_a_filled_gap_opens_a_match(spark):
    """Records of one source match at equal times, and any place matches an online one: also if a merge has filled these in."""
    one = {**drawn(1, 1)[0], "title": "maps talk old", "date": dt.date(2026, 10, 1), "time": "18:00", "location": None, "description": None, "speakers": [], "free": None, "online": None, "price": None}
    rows = [{**one, "time": None, "description": "d" * 400, "source": "a"}, {**one, "source": "b"}, {**one, "source": "a"}]
    rows += [{**one, "date": dt.date(2026, 10, 2), "source": s, "location": where, "online": online, "description": "d" * said} for s, where, online, said in (("a", "Conway Hall", None, 400), ("b", None, True, 0), ("c", "British Academy", None, 0))]
    rows = [{**r, "seq": i, "url": f"https://e.org/{i}"} for i, r in enumerate(rows)]
    assert len(fuzzy(rows)) == 2
    for block in (1, 50_000):
        assert collected(linkage.fuzzy_duplicates(frame(spark, rows), block)) == shown(fuzzy(rows))


def test_fuzzy_merges_list_no_pairs_of_copies(spark, monkeypatch):
    """What is stored on the way grows with the records, not with the pairs of those that have one title."""
    sizes = []
    for name in ("cut_lineage", "written"):
        monkeypatch.setattr(linkage, name, lambda df, *a, keep=getattr(linkage, name): [sizes.append((out := keep(df, *a)).count()), out][1])
    rows = [{**drawn(1, 1)[0], "seq": i, "source": "abcdefgh"[i % 8], "url": f"https://e.org/{i}", "title": "maps talk old", "date": dt.date(2026, 10, 1), "time": f"{10 + i % 9}:00", "location": None, "speakers": []} for i in range(300)]
    assert collected(linkage.dedupe(frame(spark, rows))) == shown(fuzzy(rows))
    assert 300 <= max(sizes) <= 600


def test_counts_of_both_passes(spark):
    """Two copies of a page, then three listings of an event, the last of which matches by a time that a merge fills in."""
    one = {**drawn(1, 1)[0], "title": "maps talk old", "date": dt.date(2026, 10, 1), "time": "18:00", "location": None, "description": None, "speakers": [], "free": None, "online": None, "price": None}
    rows = [{**one, "time": None, "description": "d" * 400, "source": "a", "url": "https://e.org/0"}, {**one, "time": None, "source": "a", "url": "https://e.org/0"}]
    rows += [{**one, "source": "b", "url": "https://e.org/1"}, {**one, "source": "a", "url": "https://e.org/2"}, {**one, "title": "other", "url": "https://e.org/3"}]
    rows = [{**r, "seq": i} for i, r in enumerate(rows)]
    left = exact(rows)
    (got,) = linkage.dedupe_counts(frame(spark, rows)).collect()
    assert tuple(got) == (len(rows) - len(left), len(left) - len(fuzzy(left)), len(rows) - len(fuzzy(left))) == (1, 2, 3)


def test_a_long_chain_of_titles(spark):
    """Each title is like the next one only: one group, merged in rounds."""
    n = 3000
    rows = [{**drawn(1, 1)[0], "seq": i, "source": "ab"[i % 2], "url": f"https://e.org/{i}", "title": " ".join(f"chain{k}" for k in range(i, i + 9)), "date": dt.date(2026, 10, 1), "time": "18:00", "location": None, "description": None, "speakers": [], "also": []} for i in range(n)]
    want = []
    # neighbours share eight of ten words: the first of a pair takes the second, which leaves the third alone
    for i in range(0, n, 2):
        want.append(i)
    got = linkage.fuzzy_duplicates(frame(spark, rows), 1200)
    assert sorted(r.seq for r in got.select("seq").collect()) == want


def test_fold_equals_unicodedata(spark):
    # the JVM may know letters that Python's tables don't assign yet
    points = [p for p in range(0x110000) if unicodedata.category(chr(p)) not in ("Cn", "Cs")]
    rows = [("a" + chr(p) + "b",) for p in points] + [("Ünïted ﬁre … ½ 한국어 Ångström ΣΑΣ ΑΣ",), (None,), ("",), ("é" * 3 + "한",)]
    df = spark.createDataFrame(rows, "s string").repartition(4)
    wrong = [r for r in df.select("s", text.fold(F.col("s")).alias("f")).toLocalIterator() if r.f != (None if r.s is None else text._unaccented(r.s))]
    assert wrong == []


def test_nearest_ancestors_and_descendants_of_drawn_trees(spark):
    r, rows, want, below = random.Random(4), [], {}, set()
    for page in range(6):
        parent = [None]
        for i in range(1, 120 if page else 1):
            parent.append(r.choice([i - 1, parent[i - 1] if parent[i - 1] is not None else i - 1, i - 1]))
        # ids in document order: children follow their parents
        last = list(range(len(parent)))
        for i in range(len(parent) - 1, 0, -1):
            last[parent[i]] = max(last[parent[i]], last[i])
        tags = [r.choice(["a", "b", "x"]) for _ in parent]
        rows += [(page, i, last[i], tags[i]) for i in range(len(parent))]
        for i, p in enumerate(parent):
            up = p
            while up is not None and tags[up] != "b":
                up = parent[up]
            if tags[i] == "a":
                want[page, i] = up
                while p is not None:
                    if tags[p] == "b":
                        below.add((page, p, i))
                    p = parent[p]
    nodes = spark.createDataFrame(rows, "page int, node_id int, last_id int, tag string").repartition(3)
    got = trees.nearest_ancestor(nodes, "page", F.col("tag") == "a", F.col("tag") == "b").collect()
    assert {(x.page, x.node_id): x.ancestor for x in got} == want and len(got) == len(want)
    pairs = [tuple(x) for x in trees.descendants(nodes, "page", F.col("tag") == "b", F.col("tag") == "a").collect()]
    assert set(pairs) == below and len(pairs) == len(below)


def test_fill_forward_and_order_across_stretches(spark):
    r = random.Random(9)
    rows = [(k, at, r.choice([None, None, None, at * 10])) for k in "ab" for at in r.sample(range(300), 120)] + [("c", 5, None)]
    want, last = {}, {}
    for k, at, v in sorted(rows):
        last[k] = v if v is not None else last.get(k)
        want[k, at] = last[k]
    df = spark.createDataFrame(rows, "k string, at long, v long").repartition(3)
    assert {(x.k, x.at): x.f for x in scans.fill_forward(df, ["k"], "at", F.col("v"), "f", stretch=10).collect()} == want
    starts = [(p, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=r.randrange(400)) if r.random() < 0.9 else None) for p in r.sample(range(1000), 200)]
    ordered = sorted(starts)
    late = {p for (_, s), (p, t) in zip(ordered, ordered[1:], strict=False) if s is not None and t is not None and t < s}
    events = spark.createDataFrame(starts, "position long, start timestamp")
    for stretch in (7, 1 << 20):
        assert {x.position for x in gate.out_of_order(events, stretch).collect()} == late


def rows_made(df):
    """The most rows that a join or an aggregate of a collected plan made."""

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            yield from walk(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            yield from walk(node.plan())
        count = node.metrics().get("numOutputRows")
        if ("Join" in kind or "Aggregate" in kind) and count.isDefined():
            yield count.get().value()
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))

    return max(walk(df._jdf.queryExecution().executedPlan()))


@pytest.mark.parametrize("part", [7, 256])
def test_equal_titles_are_paired_without_a_join(spark, part):
    """Copies meet in every word: as pairs they are many, but no join or aggregate makes them."""
    rows = [(i, "d", ["map", "talk", "old"] if i % 2 else ["old", "map", "talk"]) for i in range(300)] + [(1000 + i, "de"[i % 2], ["old", "map", "talk", "new"]) for i in range(4)] + [(2000, None, ["map", "talk", "old"]), (2001, "d", ["one", "other"])]
    df = linkage.similar_pairs(spark.createDataFrame(rows, "seq long, day string, tokens array<string>"), "day", part=part)
    got = df.collect()
    alike = lambda a, b: text_similarity(set(a), set(b)) >= 0.8
    want = {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[1] is not None and a[1] == b[1] and alike(a[2], b[2])}
    assert len(got) == len(want) and {tuple(sorted((r.a.seq, r.b.seq))) for r in got} == want
    assert rows_made(df) < 4000 < len(want)


def test_similar_sets_of_drawn_words(spark):
    r = random.Random(8)
    sets = {tuple(sorted(r.sample([f"w{i}" for i in range(14)], r.randrange(1, 13)))) for _ in range(400)}
    rows = [(i, "d", list(s), len(s)) for i, s in enumerate(sorted(sets))]
    got = linkage._similar_sets(spark.createDataFrame(rows, "id long, day string, tokens array<string>, n int"), "day").collect()
    want = {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if text_similarity(set(a[2]), set(b[2])) >= 0.8}
    assert len(got) == len(want) > 500 and {tuple(sorted((x.a, x.b))) for x in got} == want


def text_similarity(x, y):
    jaccard = len(x & y) / len(x | y)
    return max(jaccard, len(x & y) / min(len(x), len(y)) * 0.9) if min(len(x), len(y)) >= 3 else jaccard


def test_positions_over_buckets(spark):
    r = random.Random(6)
    rows = [(i, r.choice([None, 1, 2, 5]), r.randrange(5)) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, day int, v int").repartition(4)
    want = {x[0]: i for i, x in enumerate(sorted(rows, key=lambda x: (-1 if x[1] is None else x[1], x[2], x[0])))}
    assert {x.id: x.p for x in scans.positions(df, F.col("day"), [F.col("v"), F.col("id")], "p").collect()} == want


def test_trigram_search_equals_a_scan(spark):
    rows = [(1, "Élan vital"), (2, "elan"), (3, "a vi"), (4, None), (5, "vitaelan ﬁne"), (6, "el an vital")]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("t", F.coalesce("t", F.lit("")))
    postings = search.index(df, "id", "t")
    for terms in (["elan"], ["elan", "vi"], ["vi"], ["vital", "el"], ["fine"], ["zzz"], []):
        want = {i for i, t in rows if all(x in text._unaccented(t or "") for x in terms)}
        assert {r.id for r in search.search(df, postings, "id", "t", terms).collect()} == want


@pytest.mark.parametrize("chars", [3, 50, 1 << 20])
def test_trigram_index_has_a_row_for_many_texts(spark, chars):
    """Every text's trigrams, whatever stretches they were listed in; one row for each trigram of a stretch, not of a text."""
    r = random.Random(7)
    rows = [(i, "".join(r.choice("abc\U0001f600\ud7ff ") for _ in range(r.choice([0, 1, 2, 3, 4, 40])))) for i in range(300)] + [(300, None), (301, "Ébène À l’eau"), (302, "x" * 120 + "abc")]
    postings = search.index(spark.createDataFrame(rows, "id int, t string").coalesce(1), "id", "t", chars)
    got = postings.collect()
    folded = [(i, text._unaccented(t or "")) for i, t in rows]
    want = {(t[k : k + 3], i) for i, t in folded for k in range(len(t) - 2)}
    assert {(p.gram, k) for p in got for k in p["keys"]} == want and all(len(set(p["keys"])) == len(p["keys"]) for p in got)
    if chars == 1 << 20:
        assert len(got) == len({g for g, _ in want}) < len(want) / 5
    long = spark.createDataFrame(rows, "id int, t string").withColumn("t", F.coalesce("t", F.lit("")))
    assert {x.id for x in search.search(long, postings, "id", "t", ["xxxabc"]).collect()} == {302}


def test_trigrams_of_very_many_letters():
    """Codes of trigrams and texts that don't fit a number together."""
    texts = ["".join(map(chr, range(0x10000, 0x10000 + 400_000))), *["ab", "", "abcabc"] * 70]
    grams, starts, of = search._listed(texts)
    got = {(g, int(i)) for g, a, b in zip(grams, starts, starts[1:]) for i in of[a:b]}
    assert len(set(grams)) == len(grams) and got == {(t[k : k + 3], i) for i, t in enumerate(texts) for k in range(len(t) - 2)}


def test_run_violations(spark):
    totals = spark.createDataFrame([(3, 1, 5)], "sources int, ok int, events int")
    health = spark.createDataFrame([("a",), ("b",)], "id string")
    events = spark.createDataFrame([(0, dt.date(2026, 9, 1))], "position long, date date")
    got = gate.run_violations(totals, health, events, F.lit("2026-09-25 09:00:00").cast("timestamp"))
    assert {r.rule for r in got.collect()} == {"sources-disagree", "events-disagree", "few-sources-ok", "few-events", "starts-in-the-past"}
    fine = gate.run_violations(spark.createDataFrame([(2, 2, 1)], "sources int, ok int, events int"), health, events.withColumn("date", F.lit("2026-09-24").cast("date")), F.lit("2026-09-25 09:00:00").cast("timestamp"), least_events=1)
    assert fine.collect() == []


def test_carry_forward_takes_the_last_good_run_of_seven_days(spark):
    from eventloom.operators.runs import last_good

    ts = lambda s: dt.datetime.fromisoformat(s)
    failed = spark.createDataFrame([("a", ts("2026-10-10 09:00")), ("b", ts("2026-10-10 09:00")), ("c", ts("2026-10-10 09:00")), ("d", ts("2026-10-10 09:00"))], "source string, at timestamp")
    snaps = spark.createDataFrame([("a", ts("2026-10-03 08:00")), ("a", ts("2026-10-01 08:00")), ("a", ts("2026-10-11 08:00")), ("b", ts("2026-10-02 08:00")), ("c", ts("2026-10-10 08:59")), ("c", ts("2026-10-09 08:59"))], "source string, scraped_at timestamp")
    assert {r.source: str(r.scraped_at) for r in last_good(failed, snaps).collect()} == {"a": "2026-10-03 08:00:00", "c": "2026-10-10 08:59:00"}
