"""What a run publishes, and what it leaves for the next one.

State is a folder of three tables. `snapshots` has a partition for each source and run that worked, `runs` one for
each run with its health, `commits` one for each run, written last. A run replaces its own partitions and no others, so a
failed source keeps what it had; what a broken-off run left is not read, and running it again puts the same rows in the
same places. The newest `HISTORY_RUNS` runs stay, and of each source its newest snapshot, however old.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X


def _replace(df: DataFrame, path: str, *by: str) -> None:
    """Write df's partitions in place of the ones that are there; others stay. Folders are named by digests, so names
    of any kind stay texts in their columns."""
    named = df.withColumns({f"in_{c}": F.concat(F.lit("x"), F.sha1(F.col(c).cast("binary"))) for c in by})
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*(f"in_{c}" for c in by)).parquet(path)


def _delete(spark: SparkSession, path: str, folders: list[str]) -> None:
    for name in folders:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_run(path: str, run: str, at: Column, events: DataFrame, health: DataFrame, kept_runs: int = X.HISTORY_RUNS) -> None:
    """Store a run (a name that sorts by time) of health(source, status, ...) and its events(source, ...).

    A source that worked has a row of its own beside its events, so that one without events is emptied, too."""
    spark = events.sparkSession
    worked = health.filter("status <> 'error'").select("source")
    inner = F.struct(*(c for c in events.columns if c != "source"))
    rows = events.join(worked, "source", "left_semi").select("source", F.lit(run).alias("run"), at.alias("scraped_at"), inner.alias("event"))
    head = worked.select("source", F.lit(run).alias("run"), at.alias("scraped_at"), F.lit(None).cast(rows.schema["event"].dataType).alias("event"))
    _replace(head.unionByName(rows), f"{path}/snapshots", "source", "run")
    _replace(health.withColumn("run", F.lit(run)).withColumn("at", at), f"{path}/runs", "run")
    _replace(spark.range(1).select(F.lit(run).alias("run"), at.alias("at")), f"{path}/commits", "run")
    commits = spark.read.parquet(f"{path}/commits").select("run", "in_run").distinct().orderBy(F.desc("run")).collect()  # some 90
    if old := commits[kept_runs:]:
        there = _snapshots(spark, path).filter("event IS NULL")  # a row a source and run
        newest = there.groupBy("in_source").agg(F.max("run").alias("newest"))
        stale = there.join(newest, "in_source").filter((F.col("run") < F.col("newest")) & F.col("run").isin(*(r.run for r in old)))
        _delete(spark, path, [f"snapshots/in_source={r.in_source}/in_run={r.in_run}" for r in stale.select("in_source", "in_run").collect()])  # those of a run or two
        _delete(spark, path, [f"{kind}/in_run={r.in_run}" for r in old for kind in ("runs", "commits")])


def _committed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/commits").select("run").distinct()


def _snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/snapshots").join(_committed(spark, path), "run", "left_semi")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(source, run, scraped_at, event): each source's newest committed run; a source without events has one row, its
    event null."""
    rows = _snapshots(spark, path)
    newest = rows.filter("event IS NULL").groupBy("source").agg(F.max("run").alias("run"))
    return rows.join(newest, ["source", "run"], "left_semi").select("source", "run", "scraped_at", "event")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Health rows of the runs that were committed."""
    return spark.read.parquet(f"{path}/runs").join(_committed(spark, path), "run", "left_semi").drop("in_run")


def health_json(summary: DataFrame, sources: DataFrame) -> DataFrame:
    """(name, json): a row for the run's totals, one row in summary, and one for each source. As lines of one file they
    are the published health; no task holds more than a row."""
    line = lambda df, name: df.select(name.alias("name"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
    return line(summary, F.lit("totals")).unionByName(line(sources, F.col("source")))


def published(events: DataFrame, sources: DataFrame, generated_at: Column, horizon_days: int) -> DataFrame:
    """One row: when it was made, the catalogue of sources and all records in order. Its size is that of a listing of
    a few thousand rows; larger results are stored by write_run."""
    rows = events.agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "title", F.struct(*events.columns).alias("e")))), lambda x: x["e"]).alias("events"))
    catalogue = sources.agg(F.array_sort(F.collect_list(F.struct("id", "name", "homepage"))).alias("sources"))
    return rows.withColumns({"sources": catalogue.scalar(), "generated_at": generated_at, "horizon_days": F.lit(horizon_days)})


def page_payload(row: Column) -> Column:
    """JSON that may stand inside a script element."""
    return F.replace(F.to_json(row), F.lit("<"), F.lit("\\u003c"))
