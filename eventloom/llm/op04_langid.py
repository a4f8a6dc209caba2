"""Language identification by multilingual mixture inference.

A language is a distribution over character trigrams of words (hashed to `GRAMS` cells). A document's words are
drawn from a mixture of languages: expectation-maximisation estimates the proportions from each word's trigram
likelihoods, and the set of languages is the one of least penalised likelihood among the leading 1, 2, ... ones, up
to all.
The prediction is the language of the largest proportion, and its proportion is the score.

The classifier is fitted on at most `PER_LANGUAGE` labelled documents of each language, those of the smallest
hashed ids; every text is predicted whole. The model has GRAMS numbers for each of at most `LANGUAGES`
languages: that bounds what is collected and sent to the workers.

Defined cases: a null text, or one without a letter, is `und` with score 0, and so is every text if nothing
could be learned; rows with a null lang teach nothing; repeated rows are predicted alike; ties go to the
language that sorts first; a null doc_id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, mapped, small_batches, table

GRAMS, PER_LANGUAGE, LANGUAGES = 1 << 16, 2000, 200
#: Added to every count; steps of expectation-maximisation; weight of the penalty log(words) per language.
SMOOTH, STEPS, PENALTY = 0.1, 8, 4.0
#: Code points worked on at once.
PIECE = 1 << 17

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Code point to its lower-case letter; 0 for all that aren't letters."""
    if not _letters:
        t = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                t[c] = ord(s.lower()[0])
        _letters.append(t)
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram cells of all words of the texts, where each word begins among them, and the text of each word."""
    joined = "\n".join(texts)
    points = _letter_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    at = np.flatnonzero(points)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none
    padded = np.concatenate([[0], points, [0]]).astype(np.uint64)
    x = padded[at] * np.uint64(0x9E3779B97F4A7C15) + padded[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + padded[at + 2] * np.uint64(0x165667B19E3779F9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    cells = (x >> np.uint64(48)).astype(np.int64)
    first = np.flatnonzero(padded[at] == 0)
    return cells, first, np.searchsorted(begin, at[first], side="right") - 1


def _pieces(texts: list[str]):
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= PIECE):
            size += len(texts[j])
            j += 1
        yield i, texts[i:j]
        i = j


def _fit(p: np.ndarray, of: np.ndarray, start: np.ndarray, count: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after the steps, and each document's log-likelihood under them. Languages of share 0 stay out."""
    for _ in range(steps):
        r = p * share[of]
        r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
        share = np.add.reduceat(r, start, axis=0) / count[:, None]
    return share, np.add.reduceat(np.log(np.maximum((p * share[of]).sum(1), 1e-300)), start)


def mixture(log_p: np.ndarray, cells: np.ndarray, first: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Proportions [n, languages] of n texts by the chosen set of languages; rows of zeros for texts without words."""
    out = np.zeros((n, log_p.shape[1]))
    if not len(first):
        return out
    words = np.add.reduceat(log_p[cells], first, axis=0)
    top = words.max(1, keepdims=True)
    p = np.exp(words - top)
    start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    docs = of[start]
    index = np.repeat(np.arange(len(docs)), np.diff(np.append(start, len(of))))
    count = np.diff(np.append(start, len(of))).astype(float)
    k = log_p.shape[1]
    full, _ = _fit(p, index, start, count, np.full((len(docs), k), 1.0 / k), STEPS)
    alone = np.add.reduceat(words - top, start, axis=0)
    order = np.argsort(-full, axis=1, kind="stable")
    best = np.zeros_like(full)
    one = alone.argmax(1)
    best[np.arange(len(docs)), one] = 1.0
    least = -2 * alone.max(1)
    for size in range(2, k + 1):
        share = np.zeros_like(full)
        np.put_along_axis(share, order[:, :size], 1.0 / size, axis=1)
        share, ll = _fit(p, index, start, count, share, STEPS)
        cost = -2 * ll + PENALTY * (size - 1) * np.log(count + 1)
        better = cost < least
        best[better], least[better] = share[better], cost[better]
    out[docs] = best
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Model:
    def __init__(self, languages: list[str], log_p: np.ndarray):
        self.languages, self.log_p = languages, log_p


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of labelled(doc_id, text, lang)."""
    labelled = labelled.filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").withColumn("draw", F.xxhash64("doc_id"))
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages; raise LANGUAGES if the model may grow so far")
    languages = sorted(r.lang for r in sizes)
    # rows below half as much again of the share that is wanted: few, and all that can be among the least draws
    share = labelled.sparkSession.createDataFrame([(r.lang, min(1.0, 1.5 * per_language / r.n)) for r in sizes], "lang string, share double")
    near = labelled.select("lang", "draw").join(F.broadcast(share), "lang").filter(F.col("draw") / 2.0**64 + 0.5 <= F.col("share"))
    nth = F.row_number().over(W.partitionBy("lang").orderBy("draw"))
    last = near.withColumn("nth", nth).filter(F.col("nth") <= per_language).groupBy("lang").agg(F.max("draw").alias("last"))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                own = sums.setdefault(lang, np.zeros(GRAMS, np.int64))
                for _, some in _pieces(texts):
                    own += np.bincount(grams(some)[0], minlength=GRAMS)
        for lang, own in sums.items():
            cells = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(cells), pa.string()), "cell": pa.array(cells, pa.int32()), "n": pa.array(own[cells], pa.int64())})

    sample = labelled.join(F.broadcast(last), "lang").filter("draw <= last").select("lang", "text")  # a row for each language
    counts = mapped(sample, count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    table_ = np.full((GRAMS, len(languages)), SMOOTH)
    place = {x: i for i, x in enumerate(languages)}
    table_[counts["cell"].to_numpy(int), counts["lang"].map(place).to_numpy(int)] += counts["n"].to_numpy(float)
    return Model(languages, np.log(table_ / table_.sum(0)).astype(np.float32))


def _leading(own: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Each text's leading language, its proportion, and how many languages its set has."""
    share = np.zeros((len(texts), max(len(own.languages), 1)))
    if own.languages:
        for i, some in _pieces(texts):
            share[i : i + len(some)] = mixture(own.log_p, *grams(some), len(some))
    best, score = share.argmax(1), np.clip(share.max(1), 0, 1) if len(texts) else np.zeros(0)
    return [own.languages[b] if s > 0 else "und" for b, s in zip(best, score, strict=True)], score, (share > 0.01).sum(1)


def labelled(docs: DataFrame, model: Model, name: str, score: str) -> DataFrame:
    """docs with the predicted language and its score in two more columns. Narrow: no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang:string,score:double,languages:int>")
    def predict_(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in texts:
            names, scores, many = _leading(sent.value, [t or "" for t in text])
            yield pd.DataFrame({"lang": names, "score": scores, "languages": many})
        give_back()

    small_batches(docs.sparkSession)
    # not deterministic as far as the optimizer is told: else a filter on the result would run it a second time
    found = docs.withColumn("_mixture", predict_.asNondeterministic()("text"))
    return found.select(*docs.columns, F.col("_mixture.lang").alias(name), F.col("_mixture.score").alias(score))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) to doc_id, lang_pred, score, languages (how many the chosen set has)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            names, score, many = _leading(sent.value, [t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(many, pa.int32())], names=["doc_id", "lang_pred", "score", "languages"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, languages int", tidy=True)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")
