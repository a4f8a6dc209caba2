"""Near-duplicate groups by bottom-k sketches of one hash function.

A document's sketch is the `K` least hashes of its set of 5-word shingles. Inverted lists of retained values
generate overlaps, the union of two sketches estimates a pair's similarity, and the exact Jaccard similarity of
the full sets confirms it. Linked documents form groups; the least id of a group stays.

How the work stays in proportion to the input:
* Equal sets are one class, and only classes are compared, so exact copies cost nothing further.
* Two sketches of similar sets share at least `SHARED` values (all but about 1e-8 of pairs at the threshold
  itself share more), so a list holds only the K - SHARED + 1 rarest values of each sketch; values of passages
  that many documents carry are the commonest and fall out.
* First every class is compared with the least class of each of its lists. Classes that this joins need no
  further comparison among themselves. What is left in a list, pairs of different groups, is compared in full:
  short lists by a join, the classes of long ones in blocks that are dealt over tasks; pairs there are found by an
  index inside the task and never become rows, except those that join two groups.

Defined cases: a text without words has an empty set and is linked with nothing; a text of fewer than five
words has its whole sequence as its only shingle; rows of one id count as one document, linked by the texts of all
its rows, and share its fate; rows without an id are in the group of their exact copies only; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, mapped, table, written
from .tokens import mix, pieces, text_bytes, window_hashes, word_hashes

K, SHINGLE, PERCENT, SHARED = 32, 5, 75, 10
#: Lists up to this length are compared by a join; the classes of longer ones in blocks of about so many classes
#: and shingles at most (a larger set is a block of its own).
SHORT, BLOCK, BLOCK_SHINGLES = 64, 2048, 1 << 20
#: Ids of texts that are sent to every task, at most.
SENT_IDS = 1_000_000


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct 63-bit shingle hashes of each text, one text after the other."""
    data, at = text_bytes(column)
    for _, _, some, own in pieces(data, at):
        words, of = word_hashes(some, own, lower=True)
        grams, gram_of = window_hashes(words, of, SHINGLE)
        grams >>= np.uint64(1)
        for i in range(len(own) - 1):
            n = of[i + 1] - of[i]
            if 0 < n < SHINGLE:
                whole, _ = window_hashes(words[of[i] : of[i + 1]], np.array([0, n]), int(n))
                yield mix(whole + np.uint64(n)) >> np.uint64(1)
            else:
                yield np.unique(grams[gram_of[i] : gram_of[i + 1]])


def signatures(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to doc_id, text_hash, n_shingles, set_id (a 128-bit digest of the set) and sketch."""

    def run(batches):
        for batch in batches:
            sizes, ids, least = [], [], []
            for s in shingle_sets(batch.column("text")):
                sizes.append(len(s))
                ids.append(b"".join(int(mix(s + np.uint64(c)).sum(dtype=np.uint64)).to_bytes(8, "big") for c in (1, 2**63)) if len(s) else None)
                least.append(s[:K].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(least, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n_shingles", "set_id", "sketch"])

    return mapped(_hashed(docs), run, "doc_id long, text_hash long, n_shingles long, set_id binary, sketch array<long>", tidy=True)


def _hashed(docs: DataFrame) -> DataFrame:
    """docs with a hash that tells the texts of one id apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def classes_of(sigs: DataFrame) -> DataFrame:
    """(rep, doc_id, text_hash, set_id, n_shingles, sketch): a row for each set, numbered by rep, with its least id and
    one text of it."""
    own = sigs.filter("doc_id IS NOT NULL AND set_id IS NOT NULL")
    first = own.groupBy("set_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("set_id", "first.*")
    one = own.join(first, ["set_id", "doc_id", "text_hash"], "left_semi").dropDuplicates(["set_id"])
    return written(one.withColumn("rep", F.monotonically_increasing_id()), "near-classes")


def least_overlap(n):
    """Values that the sketch of a set of n shares, at least, with the sketch of any set that is similar enough."""
    small = F.ceil(n * PERCENT / 100) - F.greatest(F.lit(0), F.floor(n * 100 / PERCENT) - K)
    return F.when(n >= K, F.lit(SHARED)).otherwise(F.greatest(F.lit(1), F.least(small, F.lit(K)))).cast("int")


def inverted_lists(classes: DataFrame) -> DataFrame:
    """(value, rep, n, m): the rarest values of each class's sketch that other classes retain too; m is the list's length."""
    values = classes.select("rep", F.col("n_shingles").alias("n"), F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    common = values.groupBy("value").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    of = values.join(common, "value")
    own = W.partitionBy("rep")
    rank = F.col("s") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("f", "value"))
    rare = of.withColumn("rank", rank).filter(F.col("rank") <= F.col("s") - least_overlap(F.col("n")) + 1).select("value", "rep", "n")
    rare = written(rare, "near-values")
    length = rare.groupBy("value").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    lists = written(rare.join(length, "value"), "near-lists")
    forget(rare)
    return lists


def _similar_size(a: str, b: str):
    return (F.col(a) * 100 >= F.col(b) * PERCENT) & (F.col(b) * 100 >= F.col(a) * PERCENT)


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose union sketch has enough values in common."""
    own = classes.select("rep", "sketch")
    both = pairs.join(own.select(F.col("rep").alias("a"), F.col("sketch").alias("x")), "a").join(own.select(F.col("rep").alias("b"), F.col("sketch").alias("y")), "b")
    union = F.slice(F.array_sort(F.array_union("x", "y")), 1, K)
    same = F.size(F.array_intersect(union, F.array_intersect("x", "y")))
    return both.filter(same >= F.least(F.lit(SHARED), F.ceil(F.size(union) * PERCENT / 100) - 1)).select("a", "b")


def _texts(docs: DataFrame, classes: DataFrame, reps: DataFrame) -> DataFrame:
    """rep and text of the given distinct classes (rep), one row each. The keys of few classes go to where the texts
    are; more meet them in a shuffle."""
    keys = classes.select("rep", "doc_id", "text_hash").join(reps, "rep", "left_semi")
    if reps.count() <= SENT_IDS:
        keys = F.broadcast(keys)
    return _hashed(docs).join(keys, ["doc_id", "text_hash"]).select("rep", "text").dropDuplicates(["rep"])


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose full sets are similar enough. Only texts of the pairs travel."""
    needed = written(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "near-ids")
    texts = written(_texts(docs, classes, needed), "near-texts")
    forget(needed)
    one = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a")
    both = one.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            # rows come in runs of equal b: its set is made once a run
            new = np.concatenate([[True], b[1:] != b[:-1]]) if len(b) else np.zeros(0, bool)
            rights = shingle_sets(batch.column("tb").take(pa.array(np.flatnonzero(new))))
            ok = np.zeros(len(a), bool)
            for i, x in enumerate(shingle_sets(batch.column("ta"))):
                if new[i]:
                    y = next(rights)
                inter = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * inter >= PERCENT * (len(x) + len(y) - inter)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok], pa.int64()), pa.array(b[ok], pa.int64())], names=["a", "b"])

    links = written(mapped(both, run, "a long, b long", tidy=True), "near-links")
    forget(texts)
    return links


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, label): the least id reachable from each linked id, by label propagation with pointer jumping."""
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    edges = written(links.union(links.select("b", "a")).distinct(), "near-edges")
    labels = written(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("label")), "near-labels")
    while True:
        near = edges.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("other"))
        new = labels.join(near, "v").select("v", F.least("label", "other").alias("new"), F.col("label").alias("old"))
        up = new.select(F.col("v").alias("new"), F.col("new").alias("up"))
        new = written(new.join(up, "new").select("v", F.least("new", "up").alias("label"), "old"), "near-labels")
        forget(labels)
        labels = new
        if new.filter("label <> old").isEmpty():
            forget(edges)
            return labels


def _across_blocks(left: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that join the groups of classes which share long lists: a spanning set of them, not all.

    Classes of lists that hang together are a family. Its members' full sets are dealt out in blocks; a task
    compares two blocks by an index over one, and hands on a pair only if its groups aren't joined yet. The test is
    the one of confirmed(), so no pair that it would refuse joins two groups here and hides a true one."""
    least = left.groupBy("value").agg(F.min("rep").alias("least"))
    hang = components(left.join(least, "value").select("rep", "least").distinct(), "rep", "least")
    members = written(left.select("rep", "n", "label").distinct().join(hang.select(F.col("v").alias("rep"), F.col("label").alias("family")), "rep"), "near-members")

    def run(batches):
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary())], names=["rep", "hashes"])

    texts = _texts(docs, classes, members.select("rep"))
    sets = mapped(texts, run, "rep long, hashes binary", tidy=True)
    # the largest group of a family needs no comparison with itself: one side leaves it out
    size = members.groupBy("family", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    most = F.max(F.struct("c", "label", "s")).alias("most")
    top = size.groupBy("family").agg(most, F.sum("c").alias("m"), F.sum("s").alias("ms")).select("family", F.col("most.label").alias("top"), "m", "ms", (F.col("m") - F.col("most.c")).alias("f"), (F.col("ms") - F.col("most.s")).alias("fs"))
    rows = members.join(top.filter("f > 0"), "family").join(sets, "rep")
    blocks = lambda many, shingles: F.greatest(F.ceil(F.col(many) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")
    n_all, n_few = blocks("m", "ms"), blocks("f", "fs")
    mine, same = F.xxhash64("rep"), ["family", "rep", "n", "label", "hashes"]
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    every = rows.select(F.pmod(mine, n_all).cast("int").alias("i"), spread(n_few).alias("j"), F.lit(False).alias("few"), *same)
    few = rows.filter("label <> top").select(spread(n_all).alias("i"), F.pmod(mine, n_few).cast("int").alias("j"), F.lit(True).alias("few"), *same)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        one, other, out = pdf[pdf["few"]], pdf[~pdf["few"]], []
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        if len(one) and len(other):
            sets_ = [np.frombuffer(x, np.uint64) for x in other["hashes"]]
            values, owner = np.concatenate(sets_), np.repeat(np.arange(len(sets_), dtype=np.int32), [len(x) for x in sets_])
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            rep, n, label = (other[c].to_numpy() for c in ("rep", "n", "label"))
            for a, na, la, x in zip(one["rep"], one["n"], one["label"], one["hashes"], strict=True):
                x = np.frombuffer(x, np.uint64)
                lo, hi = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
                many = hi - lo
                at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
                shared = np.bincount(owner[at], minlength=len(rep))
                for k in np.flatnonzero((100 * shared >= PERCENT * (n + na - shared)) & (label != la)):
                    p, q = find(int(la)), find(int(label[k]))
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        out.append((min(a, rep[k]), max(a, rep[k])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    found = written(every.unionByName(few).groupBy("family", "i", "j").applyInPandas(compare, "a long, b long").distinct(), "near-joins")
    forget(members, hang)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_shingles, component_id and kept."""
    docs = docs.select("doc_id", "text")
    sigs = written(signatures(docs), "near-signatures")
    classes = classes_of(sigs)
    lists = inverted_lists(classes)

    # round 1: each class with the least class of each of its lists
    least = lists.groupBy("value").agg(F.min(F.struct("rep", "n")).alias("p"))
    star = lists.join(least, "value").select(F.col("rep").alias("a"), F.col("p.rep").alias("b"), "n", F.col("p.n").alias("pn"))
    star = star.filter((F.col("a") != F.col("b")) & _similar_size("n", "pn")).select("a", "b").distinct()
    pairs = written(likely(star, classes), "near-pairs")
    links = confirmed(pairs, docs, classes)
    labels = components(links)
    forget(pairs)

    # round 2: what is left of each list is compared in full, except within a group
    def with_label(rows: DataFrame) -> DataFrame:
        return rows.join(labels.select(F.col("v").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))

    left = with_label(lists)
    split = left.groupBy("value").agg((F.max("label") != F.min("label")).alias("split")).filter("split").select("value")
    left = written(left.join(split, "value"), "near-left")
    x = left.filter(F.col("m") <= SHORT).select("value", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    y = x.select("value", F.col("a").alias("b"), F.col("na").alias("nb"), F.col("la").alias("lb"))
    short = x.join(y, "value").filter((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & _similar_size("na", "nb")).select("a", "b").distinct()
    short = short.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    joins = _across_blocks(left.filter(F.col("m") > SHORT), docs, classes)
    pairs = written(likely(short, classes).union(joins).distinct(), "near-pairs")
    forget(joins)
    more = confirmed(pairs, docs, classes)
    # the texts of one id are one document: its sets belong together
    several = written(_ids_of_several_texts(sigs), "near-several")
    some = not several.isEmpty()
    of_id = several.join(classes.select("set_id", "rep"), "set_id")
    same = of_id.join(of_id.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").select(F.col("rep").alias("a"), "b")
    if some or not more.isEmpty():
        before, labels = labels, components(links.union(more).union(same))
        forget(before)
    forget(lists, left, pairs, links, more)
    member = classes.select("set_id", "rep", "doc_id").join(labels.select(F.col("v").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    least = member.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = written(member.join(least, "label").select("set_id", "component_id"), "near-components")
    out = sigs.filter("set_id IS NOT NULL").select("doc_id", "n_shingles", "set_id").join(found, "set_id", "left").drop("set_id")
    out = out.unionByName(sigs.filter("set_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))
    if some:  # a row without words goes with its id's others
        by_id = several.join(found, "set_id").groupBy("doc_id").agg(F.min("component_id").alias("of_id"))
        out = out.join(by_id, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "of_id"))
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _ids_of_several_texts(sigs: DataFrame) -> DataFrame:
    """(doc_id, set_id): the sets of ids that have more than one, or rows without words beside one."""
    own = sigs.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("set_id", F.lit(b"")).alias("set_id"))
    several = own.groupBy("doc_id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b")).filter("a <> b").select("doc_id")
    return own.join(several, "doc_id", "left_semi").filter(F.length("set_id") > 0).distinct()


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
