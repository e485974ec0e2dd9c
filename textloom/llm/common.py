"""Small helpers that the operators of this package share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: long texts must not add up in a worker.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; one of our own only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage ends there, lost executors do not matter."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps now, and not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a worker holds a few megabytes of text at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, under fixed names: other columns cannot clash. A null text is empty."""
    return df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of their group; ``groups`` has one row per key and its number of rows in ``size``.

    Groups with a 2,000th of all rows or more are broadcast: there can be at most 2,000 of them. The rows of all other
    groups meet them by a shuffle, in which no key has more than a 2,000th of the rows.
    """
    limit = max(1000, total // 2000)
    hot = F.broadcast(groups.filter(F.col(size) >= limit))
    cold = groups.filter(F.col(size) < limit)
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(cold, key, "left"))


def key_filter(keys: DataFrame, bits: int, least: int = 1) -> DataFrame:
    """A Bloom filter with one hash over column ``h``: (word, mask) of the positions that occur ``least`` times or more.

    It has at most ``bits`` / 64 rows, whatever the number of keys. One counter per position and task is shuffled.
    """
    at = keys.select(F.pmod("h", F.lit(bits)).alias("at")).groupBy("at").agg(F.count("*").alias("n"))
    return at.filter(F.col("n") >= least).groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at % 64))")).alias("mask"))


def test_filter(rows: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """``rows`` (with a hash in ``h``) and a column ``hit``: whether the broadcast filter may hold the key."""
    at = F.pmod("h", F.lit(bits))
    placed = rows.withColumn("at", at).withColumn("word", F.expr("at div 64"))
    return placed.join(F.broadcast(words), "word", "left").withColumn("hit", F.coalesce(F.expr("(shiftright(mask, int(at % 64)) & 1L) = 1"), F.lit(False))).drop("at", "word", "mask")
