"""The training-text pipeline: five stages, each over all that the one before it kept.

language_id drops documents without a letter or without a leading language; near_dedup keeps one document of
each group of near duplicates; secret_scan masks every secret in the texts; mixing repeats or drops documents
so that each source's words come near its target; bpe encodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import op01_secrets, op02_minhash, op04_langid, op05_mixing, op10_bpe
from eventloom.llm.common import packed, table, unpacked, written

#: A document goes if no language has at least this share of its words.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a leading language; a missing lang is filled in with it."""
    model = op04_langid.train(docs.select("doc_id", "text", "lang"))
    found = op04_langid.labelled(packed(docs, "text"), model, "lang_pred", "score")
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return unpacked(kept, docs.columns, lang=F.coalesce("row.lang", "lang_pred"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    kept = op02_minhash.near_duplicates(docs).filter("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return op01_secrets.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in whole copies; fractions carry over to the source's next document."""
    taken = op05_mixing.whole_copies(docs).groupBy(F.col("doc_id").alias("mix_id")).agg(F.max("copies").alias("mix_copies"))
    mixed = packed(docs, "doc_id").join(taken.filter("mix_copies > 0"), F.col("doc_id").eqNullSafe(F.col("mix_id")))
    return unpacked(mixed.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))), docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, as digests, with the round trip's digest."""
    return op10_bpe.encode(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mixing), ("bpe", bpe)]
#: The stages learn a model and walk graphs: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
