"""Document fingerprints by consistent weighted sampling.

A document's terms are its words (A-Z as a-z), weighted by how often they occur. Sample k of a document draws,
for each term, two Gamma(2, 1) variates and a uniform one from a hash of term and k alone, rounds the term's
weight on a random grid, and keeps the term of the least value with its grid step. Two documents keep the same
sample with a probability equal to their generalised Jaccard similarity, so the share of equal samples in two
signatures estimates it, with a standard error of at most 1 / (2 * sqrt(SAMPLES)).

Neighbours in id order are found without one sorted task: ids are cut at their quantiles into buckets, each
bucket is sorted in its own task, and the first text of each bucket also goes to the bucket before it.

Defined cases: a null text counts as empty; texts without words share one signature, unlike any other; rows of
equal ids follow each other in the order of their texts, null ids come first; one row is its own successor; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mapped, table
from .tokens import mix, word_hashes

SAMPLES = 64
#: Buckets of ids for each shuffle partition.
BUCKETS = 4
_LEVELS = 1 << 16


def _gamma2() -> np.ndarray:
    """The Gamma(2, 1) quantiles at the middle of each of the levels."""
    x = np.linspace(0, 40, 1 << 20)
    return np.interp((np.arange(_LEVELS) + 0.5) / _LEVELS, -np.expm1(-x) - x * np.exp(-x), x)


_G = _gamma2().astype(np.float32)
_LOG_G = np.log(_G)
_SEEDS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOW = np.uint64(0xFFFF)


def signature(text: str) -> np.ndarray:
    """SAMPLES digests of 16 bits; all zero for a text without words."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    hashes, _ = word_hashes(data, np.array([0, len(data)]), lower=True)
    if not len(hashes):
        return np.zeros(SAMPLES, np.uint16)
    terms, counts = np.unique(hashes, return_counts=True)
    log_w = np.log(counts).astype(np.float32)
    least = np.full(SAMPLES, np.inf, np.float32)
    kept = np.zeros(SAMPLES, np.uint64)
    for i in range(0, len(terms), 2048):
        own = terms[i : i + 2048, None]
        x = mix(own ^ _SEEDS[None, :])
        r, log_c = _G[x & _LOW], _LOG_G[(x >> np.uint64(16)) & _LOW]
        beta = (x >> np.uint64(32)).astype(np.float32) * np.float32(2.0**-32)
        t = np.floor(log_w[i : i + 2048, None] / r + beta)
        value = log_c - r * (t - beta) - r
        at = value.argmin(0)
        best = value[at, np.arange(SAMPLES)]
        step = t[at, np.arange(SAMPLES)].astype(np.int64).astype(np.uint64)
        better = best < least
        least[better] = best[better]
        kept[better] = mix(terms[i + at] * np.uint64(0xD6E8FEB86659FD93) + step)[better]
    return np.maximum((kept >> np.uint64(48)).astype(np.uint16), 1)


def shown(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _in_buckets(docs: DataFrame) -> DataFrame:
    """bucket, last (1 for the first text of the next bucket), o (the id's order), doc_id, text."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("o"), F.coalesce("text", F.lit("")).alias("text"))
    n = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("o", [i / n for i in range(1, n)], 20 * n).alias("c")).first().c or []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def bucket(o: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, o.to_numpy(np.int64), side="left").astype(np.int32))

    docs = docs.withColumn("bucket", bucket("o"))
    # one row for each bucket: as many as there are cuts
    firsts = docs.groupBy("bucket").agg(F.min("o").alias("o"))
    firsts = docs.join(F.broadcast(firsts), ["bucket", "o"], "left_semi").groupBy("bucket").agg(F.min("text").alias("text"))
    order = W.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(W.partitionBy()))
    after = firsts.select(before.alias("bucket"), F.lit(1).alias("last"), F.lit(0).cast("long").alias("o"), F.lit(None).cast("long").alias("doc_id"), "text")
    return docs.select("bucket", F.lit(0).alias("last"), "o", "doc_id", "text").unionByName(after)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with the digests of each text and of its edited text. The texts are shuffled once."""
    rows = _in_buckets(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "last", "o", "text")

    def run(batches):
        from hashlib import sha256

        held = None  # (doc_id, text, signature) of the row that waits for its successor
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            out = []
            for last, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("last", "doc_id", "text")), strict=True):
                own = signature(text)
                if held is not None:
                    changed = edited(held[1], text)
                    other = signature(changed)
                    digest = sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((held[0], len(held[1]), digest, shown(held[2]), shown(other), likeness(held[2], other), likeness(held[2], own)))
                held = None if last else (doc_id, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], names=names)

    return mapped(rows, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
