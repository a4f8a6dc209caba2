"""Scans along an order that need no task with all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Positions in a stretch.
STRETCH = 4096


def fill_forward(rows: DataFrame, by: list[str], at: str, value: Column, name: str, stretch: int = STRETCH) -> DataFrame:
    """rows with one more column: the last value that isn't null at or before each row, in the order of `at` (unique
    numbers) within `by`.

    Rows are cut into stretches of positions. Inside one a window fills forward; a stretch hands its last value to the
    next ones by a window over one row for each stretch that has a value."""
    cut = rows.withColumns({"_value": value, "_stretch": F.floor(F.col(at) / stretch)})
    inside = W.partitionBy(*by, "_stretch").orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    filled = cut.withColumn("_own", F.last("_value", ignorenulls=True).over(inside))
    ends = cut.filter("_value IS NOT NULL").groupBy(*by, "_stretch").agg(F.max_by("_value", at).alias("_end"))
    every = cut.select(*by, "_stretch").distinct().join(ends, [*by, "_stretch"], "left")
    before = F.last("_end", ignorenulls=True).over(W.partitionBy(*by).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1))
    carried = every.select(*by, "_stretch", before.alias("_carried")).filter("_carried IS NOT NULL")
    out = filled.join(carried, [*by, "_stretch"], "left").withColumn(name, F.coalesce("_own", "_carried"))
    return out.select(*rows.columns, name)


def positions(rows: DataFrame, bucket: Column, order: list[Column], name: str) -> DataFrame:
    """rows with their position, from 0, in the order of buckets and, inside a bucket, of `order`, which must tell rows
    apart. No task sorts more than a bucket; buckets hand on their sizes."""
    cut = rows.withColumn("_bucket", bucket)
    sizes = cut.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_bucket").alias("_of"), before.alias("_before"))
    nth = F.row_number().over(W.partitionBy("_bucket").orderBy(*order)) - 1
    out = cut.withColumn("_nth", nth).join(starts, F.col("_bucket").eqNullSafe(F.col("_of")))
    return out.withColumn(name, F.col("_before") + F.col("_nth")).select(*rows.columns, name)
