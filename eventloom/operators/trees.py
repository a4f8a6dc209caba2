"""Relations between the nodes of trees, as equality joins.

A node's subtree is the interval [node_id, last_id] of ids in document order. An interval is a few aligned stretches of
2^k ids, and an id lies in one such stretch for each k: "inside of" becomes equality of (tree, k, stretch), so that
neither a deep nor a very long page meets itself in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of a tree's nodes are below 2 ** LEVELS.
LEVELS = 31


def _size(k: Column) -> Column:
    """2^k."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


def _stretches(low: Column, high: Column) -> Column:
    """The aligned stretches that make up [low, high]: an array of (level, stretch)."""

    def of(k: Column) -> Column:
        size = _size(k)
        a, b = F.ceil(low / size).cast("long"), F.floor((high + 1) / size).cast("long")
        piece = lambda at, there: F.when((a < b) & there, F.struct(k.cast("int").alias("level"), at.alias("stretch")))
        return F.array_compact(F.array(piece(a, a % 2 == 1), piece(b - 1, b % 2 == 1)))

    # no stretch is longer than the interval
    most = F.length(F.bin(high - low + 1)) - 1
    return F.flatten(F.transform(F.sequence(F.lit(0), most), of))


def _stretches_of_point(at: Column, most: Column) -> Column:
    """The stretches that an id lies in, up to level `most`."""
    return F.transform(F.sequence(F.lit(0), most), lambda k: F.struct(k.cast("int").alias("level"), F.floor(at / _size(k)).cast("long").alias("stretch")))


def _pieces(nodes: DataFrame, key: str, who: Column) -> DataFrame:
    """(key, level, stretch, outer): the stretches of what lies below the nodes that who selects."""
    below = nodes.filter(who & (F.col("last_id") > F.col("node_id"))).select(key, F.col("node_id").cast("long").alias("outer"), F.col("last_id").cast("long").alias("last_id"))
    return below.select(key, "outer", F.explode(_stretches(F.col("outer") + 1, F.col("last_id"))).alias("s")).select(key, "s.*", "outer")


def _points(nodes: DataFrame, key: str, who: Column) -> DataFrame:
    """(key, level, stretch, inner): the stretches of the nodes that who selects."""
    size = nodes.groupBy(key).agg((F.length(F.bin(F.max("node_id") + 1)) - 1).alias("most"))
    at = nodes.filter(who).select(key, F.col("node_id").cast("long").alias("inner")).join(size, key)
    return at.select(key, "inner", F.explode(_stretches_of_point(F.col("inner"), F.col("most"))).alias("s")).select(key, "s.*", "inner")


def nearest_ancestor(nodes: DataFrame, key: str, of: Column, among: Column) -> DataFrame:
    """(key, node_id, ancestor): for each node that `of` selects the nearest of its ancestors that `among` selects, null
    without one. Of the intervals that hold a node, the one that begins last is the innermost."""
    innermost = _pieces(nodes, key, among).groupBy(key, "level", "stretch").agg(F.max("outer").alias("outer"))
    found = _points(nodes, key, of).join(innermost, [key, "level", "stretch"]).groupBy(key, "inner").agg(F.max("outer").alias("ancestor"))
    every = nodes.filter(of).select(key, F.col("node_id").cast("long").alias("node_id"))
    return every.join(found.withColumnRenamed("inner", "node_id"), [key, "node_id"], "left")


def descendants(nodes: DataFrame, key: str, of: Column, among: Column) -> DataFrame:
    """(key, node_id, descendant): each pair of a node that `of` selects and a node below it that `among` selects, once."""
    return _points(nodes, key, among).join(_pieces(nodes, key, of), [key, "level", "stretch"]).select(key, F.col("outer").alias("node_id"), F.col("inner").alias("descendant"))
