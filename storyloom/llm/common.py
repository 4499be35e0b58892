"""Shared pieces of the training-data operators: row identity, words, durable intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word contract here: the ASCII set `[\x20\x09-\x0D]`.
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Spark's setting for the bytes of an Arrow batch, and what intermediate tables are written with.
BATCH_BYTES, MOST_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(12 << 20)
#: Stands for a null doc_id inside joins and sorts: below every real id.
NO_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; where that is unset and all run on one machine, our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file:///tmp/checkpoints/storyloom"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    Arrow batches hold MOST_BATCH_BYTES, so neither a task nor its Python worker holds many texts at once. The files go
    when the application ends, or with discard().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/storyloom-{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, MOST_BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_BYTES, before)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let executors delete the shuffles of finished queries: Spark does so only when the driver collects garbage."""
    spark._jvm.System.gc()


def doc_key(c: str = "doc_id") -> Column:
    """doc_id as a long that is never null."""
    return F.coalesce(F.col(c).cast("long"), F.lit(NO_ID))


def id_or_null(c: Column | str) -> Column:
    """Undo doc_key."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != NO_ID, c)


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def fingerprint(c: Column) -> Column:
    """128 bits of a string as a struct of two longs."""
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(7), c).alias("b"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Runs of `[^\\x20\\x09-\\x0D]`, in order; the empty array without any."""
    return F.array_remove(F.split(F.translate(c, SPACE, " " * len(SPACE)), " "), "")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
