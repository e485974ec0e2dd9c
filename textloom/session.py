"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", app: str = "textloom", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let the workers import this package, wherever the driver program was started."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="textloom-")) / "textloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(here.rglob("*.py")):
            z.write(file, file.relative_to(here.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options that results depend on. Safe to repeat."""
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Attribute maps keep the last of two equal names.
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    # Key pads of keyed hashes must not show in printed plans.
    spark.conf.set("spark.sql.redaction.string.regex", "(?i)0x[0-9a-f]{128}|X'[0-9a-f]{128}'")
    return spark


def table(spark: SparkSession, folder: str, name: str):
    """One of the input tables, as a lazily read parquet scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for files all executors see; one of our own only for a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="textloom-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def job_folder(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there, so lost executors do not matter."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: for wide rows of which a job later reads a few fields at a time."""
    path = job_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def set_aside(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """``df`` written to the shared folder in compressed files and read back, for as long as the block lasts."""
    path = job_folder(df.sparkSession, label)
    folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    try:
        df.write.option("compression", "zstd").parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows of one task, for jobs that work hard on each row.
ROWS_PER_TASK = 50_000


def spread(df: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """Use all cores for a job that works hard on each row of a scan, in tasks that do not grow with the input.

    A scan that already has a partition for every core and every ``rows`` rows stays as it is; its rows are counted from the footers of its files.
    """
    parts = df.rdd.getNumPartitions()
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df if parts >= wanted else df.repartition(wanted)


#: Rows of one task, for narrow rows that are dealt by key.
ROWS_PER_SHARE = 500_000


def shares(df: DataFrame) -> int:
    """In how many parts to deal ``df`` by key, so that tasks do not grow with the input: Spark's own number of shuffle partitions is fixed."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_SHARE))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that costs much to work out. Nothing that reads it, a filter neither, works it out again."""
    return df.select("*", F.inline_outer(F.array(F.struct(value.alias(name)))))
