"""Session-level helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the path may be of any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only on a local master, as in tests."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="lexispark-")


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of one's own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` by files in the shared folder, which survive the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m"):
    """While it lasts, jobs pass texts to Python in Arrow batches of about so many bytes, so that a task holds few long texts at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def ranked(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """`df` with each row's place, from 0, in a total order.

    Range partitions are numbered by their sizes and rows within them, so no
    task has all rows, as it would with a window over everything.
    """
    x = df.repartitionByRange(*order).sortWithinPartitions(*order)
    m = F.monotonically_increasing_id()
    x = checkpointed(x.withColumn("__m", m).withColumn("__part", F.shiftright("__m", 33)).withColumn("__i", F.col("__m").bitwiseAND((1 << 33) - 1)).drop("__m"))
    sizes = x.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row for each partition
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return x.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__i")).drop("__part", "__i", "__before")


def spread(df: DataFrame) -> DataFrame:
    """`df`, whose rows are small but dear to work on, over all cores: a small file is one task or a few, however long its rows take."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


#: Rows of at most two longs that may be broadcast: about 100 MB as a hashed relation.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `limit` rows, else as it is.

    `df` should be materialised: its rows are counted (up to the limit).
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def drop_shuffles(spark) -> None:
    """Let Spark delete shuffle files that nothing refers to any more: it does so when the driver collects its garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
