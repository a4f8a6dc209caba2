"""What the operators of this folder share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and the control characters 9 to 13. Java and RE2 read it alike.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes in an Arrow batch at most (a longer text is a batch of its own): little memory on either side of
#: the exchange, however long the texts are.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only in a session on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="eventloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that `written` made and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches within BATCH from here on, unless the session asks for still smaller ones."""
    for key, most in BATCH.items():
        now = spark.conf.get(key).rstrip("b")  # the default is shown in bytes; one with another unit was chosen
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Memory that this worker has freed goes back to the machine: workers outlive their stage, and what one stage has
    used would count beside the next one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mapped(df: DataFrame, run, schema: str, tidy: bool = False) -> DataFrame:
    """df.mapInArrow in small batches. tidy: tasks give freed memory back when they end."""
    small_batches(df.sparkSession)

    def then_tidy(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(then_tidy if tidy else run, schema)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, though body names it often (also inside lambdas)."""
    return F.transform(F.array(value), body)[0]


def packed(docs: DataFrame, *own: str) -> DataFrame:
    """docs as one struct `row` beside the named columns: a step's own columns can't clash with any of docs."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *own)


def unpacked(rows: DataFrame, names: list[str], **made: Column) -> DataFrame:
    """The columns of `row` again, with those that were made in place of their old ones."""
    return rows.select(*((made[c] if c in made else F.col("row").getField(c)).alias(c) for c in names))


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))
