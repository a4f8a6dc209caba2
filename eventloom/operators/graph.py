"""Connected components of a pair table."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the cluster's shared folder; a folder of our own only in a session on one machine."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="eventloom-"))
    return df.checkpoint()


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(v, label): the least value reachable from each value of the pairs. Labels jump to their label's label, so
    rounds grow with the logarithm of the longest chain."""
    edges = cut_lineage(pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).union(pairs.select(b, a)).distinct())
    labels = edges.groupBy(F.col("x").alias("v")).agg(F.least(F.col("v"), F.min("y")).alias("label"))
    while True:
        near = edges.join(labels.select(F.col("v").alias("y"), "label"), "y").groupBy(F.col("x").alias("v")).agg(F.min("label").alias("near"))
        new = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("new"))
        up = new.select(F.col("v").alias("new"), F.col("new").alias("up"))
        new = cut_lineage(new.join(up, "new").select("v", "old", F.least("new", "up").alias("label")))
        labels = new.select("v", "label")
        if new.filter("label <> old").isEmpty():
            return labels
