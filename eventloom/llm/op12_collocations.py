"""Phrase collocations by contiguous pattern growth.

Passes over the texts, each some texts at a time:
1. Words are counted exactly, and adjacent pairs by a 64-bit hash. Pairs seen often enough are set in a filter of a
   fixed number of bits, so it holds every frequent pair (and a few others by collision): it only saves work.
2. At each occurrence of a pair in the filter, the context is projected: the words from there on, `LONGEST` at most,
   as long as each next pair is in the filter too. A longer phrase is frequent only if all its pairs are, so no
   occurrence of a frequent phrase is lost. Equal contexts of texts that are read together are one row with a weight.

Contexts are dealt out in ranges of their order, so one task has whole prefixes and a very common prefix has as many
tasks as its share asks for. A task takes blocks of sorted contexts: the occurrences of a prefix are a range of
rows, and a prefix grows to the right depth-first inside its own range, only while it is frequent. Prefixes at a
block's edge may go on in the next block or task: these are handed on with their partial counts, and the sums
decide. All counts are of whole words, never of hashes.

Scores use decimals of 38 digits. A phrase inside a longer one has the count of the longer one at least, so it is
enough to look at the phrases that are one word longer.

Defined cases: null texts are empty, a null lang is `und`; rows of one doc_id, null ids and repeated rows each count;
other columns are ignored; an empty table gives an empty result; ties in score are broken by count, then by the
phrase's bytes; a very long text is read alone, and memory grows with it only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, mapped, table, written
from .tokens import mix, text_bytes

LEAST, LONGEST, REPORTED = 100, 5, 2000
#: Bits of the filter of frequent pairs (16 MB whatever the input); hashes, and rows of words or contexts, that a task
#: holds before it adds them up; bytes of text that it reads together (a longer text is read alone).
FILTER_BITS, HELD, HELD_ROWS, TOGETHER = 1 << 27, 1 << 20, 1 << 18, 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[9, 32]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[10, 11, 12, 13, *b".,;:!?"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Between the words of a context: sorts before all that a word holds. A zero byte inside a word stands as a tab.
_SEP, _ZERO = 0, 9


class Words:
    """The words of a batch's texts in order: a code each, the distinct words, and where pieces begin."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, at = text_bytes(texts)
        data = _LOWER[data]
        broken, inside = _BREAK[data], ~(_BREAK | _SPACE)[data]
        data[data == _SEP] = _ZERO
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = at[1:] > at[:-1]
        first[at[:-1][full]] |= inside[at[:-1][full]]
        last[at[1:][full] - 1] |= inside[at[1:][full] - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        text = np.searchsorted(at, starts, side="right") - 1
        breaks = np.cumsum(broken)[starts]
        #: Whether each word and the next one stand in one piece.
        self.next = np.zeros(len(starts), bool)
        if len(starts):
            self.next[:-1] = (breaks[1:] == breaks[:-1]) & (text[1:] == text[:-1])
        sizes = ends - starts
        self.at = np.append(0, np.cumsum(sizes))
        self.bytes = data[inside]
        words = _strings(self.at, self.bytes).dictionary_encode()
        self.words, self.code = words.dictionary, words.indices.to_numpy()
        langs = pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
        self.langs = langs.dictionary
        self.lang = langs.indices.to_numpy()[text]

    def counts(self) -> dict:
        """The number of each word of each language."""
        many = max(len(self.words), 1)
        key, n = np.unique(self.lang.astype(np.int64) * many + self.code, return_counts=True)
        return {"lang": self.langs.take(pa.array(key // many)), "word": self.words.take(pa.array(key % many)), "n": n}

    def totals(self) -> dict:
        """The number of words of each language."""
        n = np.bincount(self.lang, minlength=len(self.langs))
        return {"lang": self.langs, "word": pa.nulls(len(n), pa.large_binary()), "n": n}

    def pairs(self) -> np.ndarray:
        """A hash of each word, the one after it and their language; the last word of all has none."""
        word, lang = _hashes(self.words)[self.code], _hashes(self.langs.cast(pa.large_binary()))[self.lang]
        return mix(mix(word[:-1] + _STEP) + word[1:] + lang[:-1] * _STEP)

    def contexts(self, frequent: np.ndarray) -> dict:
        """The number of each context of at least two words. frequent: whether a word and the next one are a pair of
        the filter."""
        n, length = len(self.code), np.ones(len(self.code), np.int64)
        going = np.ones(n, bool)
        for k in range(min(LONGEST - 1, n)):
            going[: n - k] &= frequent[k:]
            going[n - k :] = False
            length += going
        start = np.flatnonzero(length > 1)
        # the words with a separator after each; a context is a stretch of this
        sizes = np.diff(self.at) + 1
        at = np.append(0, np.cumsum(sizes))
        data = np.full(at[-1], _SEP, np.uint8)
        data[np.arange(len(self.bytes)) + np.repeat(np.arange(n), sizes - 1)] = self.bytes
        size = at[start + length[start]] - 1 - at[start]
        out = np.append(0, np.cumsum(size))
        data = data[np.repeat(at[start] - out[:-1], size) + np.arange(out[-1])]
        found = _strings(out, data).dictionary_encode()
        many = max(len(self.langs), 1)
        key, weight = np.unique(found.indices.to_numpy().astype(np.int64) * many + self.lang[start], return_counts=True)
        return {"lang": self.langs.take(pa.array(key % many)), "context": found.dictionary.take(pa.array(key // many)), "n": weight}


def _strings(at: np.ndarray, data: np.ndarray) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _hashes(column: pa.LargeBinaryArray) -> np.ndarray:
    """A 64-bit hash of each value."""
    at = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[: at[-1]]
    place = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix((place.astype(np.uint64) << np.uint64(8)) + data + _STEP), out=total[1:])
    return mix(total[at[1:]] - total[at[:-1]])


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[Words]:
    """The words of some texts at a time."""
    for batch in batches:
        _, at = text_bytes(batch.column("text"))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + TOGETHER, side="right")) - 1)
            some = batch.slice(i, j - i)
            yield Words(some.column("text"), some.column("lang"))
            i = j


class Sums:
    """Rows of keys and n: equal keys are added up, `most` rows at a time at least; little is held."""

    def __init__(self, *keys: str, most: int = HELD_ROWS):
        self.keys, self.most, self.held, self.rows = [*keys], most, [], 0

    def add(self, columns: dict, last: bool = False) -> Iterator[pa.Table]:
        if columns:
            self.held.append(pa.table(columns))
            self.rows += self.held[-1].num_rows
        if self.held and (last or self.rows > 2 * self.most):
            found = pa.concat_tables(self.held).group_by(self.keys).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
            self.held, self.rows = [found], found.num_rows
            if last or self.rows > self.most:
                self.held, self.rows = [], 0
                yield found

    def rest(self) -> Iterator[pa.Table]:
        return self.add({}, True)


def _batches(tables: Iterable[pa.Table], schema: pa.Schema, **more) -> Iterator[pa.RecordBatch]:
    """The tables' rows, some at a time; columns that they lack are null, or the one value given."""
    for own in tables:
        for batch in own.to_batches(1 << 16):
            lacking = lambda f: pa.repeat(pa.scalar(more[f.name], f.type), batch.num_rows) if f.name in more else pa.nulls(batch.num_rows, f.type)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) if f.name in batch.schema.names else lacking(f) for f in schema], schema=schema)


_COUNTS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("pair", pa.int64()), ("n", pa.int64())])
_CONTEXTS = pa.schema([("lang", pa.string()), ("context", pa.string()), ("n", pa.int64()), ("salt", pa.int64())])


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, word, pair, n): frequent words of each language (pair is null), frequent pairs' hashes (lang and word are
    null), and all words of each language (word and pair are null)."""

    def pair_counts(held):
        key, n = np.unique(np.concatenate(held), return_counts=True)
        return _batches([pa.table({"pair": key.view(np.int64), "n": n})], _COUNTS)

    def run(batches):
        words, held, size = Sums("lang", "word"), [], 0
        for found in _texts(batches):
            yield from _batches(words.add(found.counts()), _COUNTS)
            yield from _batches(words.add(found.totals()), _COUNTS)
            held.append(found.pairs()[found.next[:-1]])
            size += len(held[-1])
            if size > HELD:
                yield from pair_counts(held)
                held, size = [], 0
        yield from _batches(words.rest(), _COUNTS)
        if held:
            yield from pair_counts(held)

    # what the tasks have added up is hardly fewer rows for another sum on their side
    counts = mapped(docs.select("text", "lang"), run, "lang string, word string, pair long, n long").repartition("lang", "word", "pair")
    counts = counts.groupBy("lang", "word", "pair").agg(F.sum("n").alias("n"))
    return counts.filter((F.col("n") >= LEAST) | F.col("word").isNull() & F.col("pair").isNull())


def pair_filter(pairs: DataFrame) -> np.ndarray:
    """FILTER_BITS bits as bytes, those of the pairs' hashes set. Bitmaps of 32,768 bits come to the driver, of which
    there are FILTER_BITS / 32,768 at most."""
    place = F.col("pair").bitwiseAND(FILTER_BITS - 1) + 1
    bits = pairs.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        part = np.frombuffer(bytes(row.bits), np.uint8)
        out[(row.bucket - 1) * len(part) : row.bucket * len(part)] = part
    return out


def projected(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, context, n, salt): every occurrence of a frequent pair with what may follow it, equal ones of a batch as
    one row."""
    bits = docs.sparkSession.sparkContext.broadcast(pair_filter(pairs))

    def run(batches):
        for found in _texts(batches):
            place = found.pairs() & np.uint64(FILTER_BITS - 1)
            frequent = found.next.copy()
            frequent[:-1] &= (bits.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            yield from _batches([pa.table(found.contexts(frequent))], _CONTEXTS, salt=zlib.crc32(found.bytes[: 1 << 16]))

    return mapped(docs.select("text", "lang"), run, "lang string, context string, n long, salt long")


def grown(lang: np.ndarray, words: np.ndarray, n: np.ndarray, least: int = LEAST) -> Iterator[tuple[int, int, int]]:
    """(a row that begins with it, words, count) of each prefix of two words or more in a block of sorted contexts, if
    it is frequent or at an edge of the block. words: a row of word codes for each context, -1 behind the last."""
    total, end = np.append(0, np.cumsum(n)), len(n)
    grow = [(0, end, 0)]
    while grow:
        low, high, depth = grow.pop()
        column = lang if not depth else words[:, depth - 1]
        first = np.append(low, np.flatnonzero(column[low + 1 : high] != column[low : high - 1]) + low + 1)
        last = np.append(first[1:], high)
        count = total[last] - total[first]
        keep = (column[first] >= 0) & ((count >= least) | (first == 0) | (last == end))
        for a, b, c in zip(first[keep].tolist(), last[keep].tolist(), count[keep].tolist(), strict=True):
            if depth > 1:
                yield a, depth, c
            if depth < words.shape[1]:
                grow.append((a, b, depth + 1))


def frequent_phrases(contexts: DataFrame) -> DataFrame:
    """(lang, phrase, words, f): all phrases of two to LONGEST words that occur LEAST times or more."""

    def blocks(batches):
        held, rows, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= 1 << 17 or size >= 8 << 20:
                yield pa.Table.from_batches(held)
                held, rows, size = [], 0, 0
        if rows:
            yield pa.Table.from_batches(held)

    def run(batches):
        for block in blocks(batches):
            lang = block.column("lang").combine_chunks().dictionary_encode().indices.to_numpy()
            context = block.column("context").combine_chunks()
            split = pc.split_pattern(context, chr(_SEP))
            sizes = pc.list_value_length(split).to_numpy().astype(np.int64)
            words = np.full((len(sizes), LONGEST), -1, np.int32)
            words[np.arange(LONGEST) < sizes[:, None]] = split.flatten().dictionary_encode().indices.to_numpy()
            found = list(grown(lang, words, block.column("n").to_numpy()))
            at = pa.array([a for a, _, _ in found], pa.int64())
            phrases = [chr(_SEP).join(x[:m]) for x, (_, m, _) in zip(split.take(at).to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays([block.column("lang").combine_chunks().take(at), pa.array(phrases, pa.string()), pa.array([m for _, m, _ in found], pa.int32()), pa.array([c for _, _, c in found], pa.int64())], names=["lang", "phrase", "words", "f"])

    dealt = contexts.repartitionByRange("lang", "context", "salt").sortWithinPartitions("lang", "context")
    found = mapped(dealt.select("lang", "context", "n"), run, "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter(F.col("f") >= LEAST)


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """Each phrase that no longer one stands for, with its lowest-scoring cut."""
    part = lambda begin, size: F.array_join(F.slice("parts", begin, size), chr(_SEP))
    split = phrases.withColumn("parts", F.split("phrase", chr(_SEP)))
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("c")).union(words)
    cuts = split.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "f", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("part").alias("first"), F.col("c").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("part").alias("rest"), F.col("c").alias("r")), ["lang", "rest"]).join(totals, "lang")
    wide = lambda name: F.col(name).cast("decimal(15,0)")
    cuts = cuts.withColumn("above", F.lit(1000).cast("decimal(4,0)") * (wide("f") * wide("n"))).withColumn("below", wide("l") * wide("r"))
    best = cuts.select("lang", "phrase", "f", "n", F.struct(F.expr("above div below").alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "f", "n").agg(F.min("cut").alias("cut"))
    inside = split.filter("words > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase"), F.col("f").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = best.join(inside, ["lang", "phrase"], "left").filter("longer IS NULL OR longer < f")
    shown = F.replace(F.replace("phrase", F.lit(chr(_SEP)), F.lit(" ")), F.lit(chr(_ZERO)), F.lit(chr(0)))
    return left.select("lang", shown.alias("phrase"), F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def collocations(docs: DataFrame, reported: int | None = REPORTED) -> DataFrame:
    """docs(text, lang) to lang, rank, phrase, a, l, r, n and score; each language's first `reported`, or all."""
    counts = written(_counted(docs), "phrase-counts")
    contexts = written(projected(docs, counts.filter("pair IS NOT NULL").select("pair")), "phrase-contexts")
    phrases = written(frequent_phrases(contexts), "phrase-phrases")
    forget(contexts)
    words = counts.filter("word IS NOT NULL").select("lang", F.col("word").alias("part"), F.col("n").alias("c"))
    totals = counts.filter("word IS NULL AND pair IS NULL").select("lang", "n")
    found = scored(phrases, words, totals)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order))
    if reported is not None:
        ranked = ranked.filter(F.col("rank") <= reported)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents
), q AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda w: w <> '') AS ws FROM p
), g AS (
  SELECT lang, m, ws[i : i + m - 1] AS phrase, count(*) AS f FROM (SELECT lang, m, ws, unnest(range(1, len(ws) - m + 2)) AS i FROM q, range(1, 6) AS t(m)) GROUP BY ALL HAVING count(*) >= 100
), t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM q GROUP BY lang),
cuts AS (
  SELECT g.lang, g.phrase, g.m, g.f AS a, k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * g.f * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM g WHERE m > 1) g
  JOIN g x ON x.lang = g.lang AND x.phrase = g.phrase[1 : k] JOIN g y ON y.lang = g.lang AND y.phrase = g.phrase[k + 1 : g.m] JOIN t ON t.lang = g.lang
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase[s : s + w - 1] AS phrase, max(f) AS longer FROM (SELECT *, unnest(range(1, m - w + 2)) AS s FROM g, range(2, 5) AS v(w) WHERE w < m) GROUP BY ALL
), kept AS (
  SELECT best.lang, array_to_string(best.phrase, ' ') AS phrase, a, l, r, n, score FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept
QUALIFY rank <= 2000
"""
