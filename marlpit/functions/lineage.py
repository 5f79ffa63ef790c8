"""Fixing what later steps must see alike."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a range partition on average: few as long as there are no more partitions than are set for shuffles, then many. And partitions at most (unless more are set): the bounds are drawn
#: from a sample of a bounded number of rows.
FEW_ROWS, RANGE_ROWS, MOST_RANGES = 25_000, 250_000, 10_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one set on the context. Where neither is set, a temporary one on a single machine; on a cluster that is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="marlpit-"))
    return context.getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder for something of this application, which drop_scratch deletes."""
    return f"{shared_folder(spark)}/marlpit-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, which also reaches stores that only Spark can open."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table and saved model of this application; call when its results have been read."""
    fs, where = hadoop_path(spark, f"{shared_folder(spark)}/marlpit-{spark.sparkContext.applicationId}")
    fs.delete(where, True)


def pinned(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a table in the shared folder."""
    path = scratch_path(df.sparkSession, "pinned")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """df as pinned keeps it, until the block ends; what is used of it must have been read or written by then."""
    path = scratch_path(df.sparkSession, "kept")
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        fs, where = hadoop_path(df.sparkSession, path)
        fs.delete(where, True)


def part_count(spark: SparkSession, rows: int) -> int:
    """Parts for so many rows: RANGE_ROWS rows each, or fewer."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, min(usual, rows // FEW_ROWS), min(MOST_RANGES, -(-rows // RANGE_ROWS)))


def range_parts(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """df in range partitions of the keys, whose numbers are in a column: RANGE_ROWS rows each, or fewer. Sampled bounds differ from one evaluation to the next, so the outcome is pinned;
    df is kept until then, as sampling would compute it twice."""
    with kept(df) as rows:
        n = part_count(df.sparkSession, rows.count())
        return pinned(rows.repartitionByRange(n, *keys).withColumn(name, F.spark_partition_id()))


def in_small_parts(df: DataFrame) -> DataFrame:
    """df in partitions of RANGE_ROWS rows on average; as it is, where they hold no more already."""
    n = min(MOST_RANGES, -(-df.count() // RANGE_ROWS))
    return df.repartition(n) if n > df.rdd.getNumPartitions() else df
