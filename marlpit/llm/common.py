"""Shared helpers of the corpus operators: tables, scratch tables, word rules, skew-proof joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.functions.lineage import drop_scratch, hadoop_path, scratch_path
from marlpit.shipping import ship_package

__all__ = ["drop_scratch", "hadoop_path", "scratch_path"]  # used here, and by those who come for them here
#: Words are maximal runs of anything but space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is heavy if it holds more than one in HEAVY_SHARE of all rows, so there are at most HEAVY_SHARE heavy keys.
HEAVY_SHARE = 1000
#: Narrow rows in a file of a scratch table.
ROWS_PER_FILE = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow with a function of this package, which the executors get first."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: later steps don't recompute it and outlive lost executors.
    rows, where the caller has an idea of their number, keeps a small table of narrow rows from becoming hundreds of tiny files."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, each with as many underscores in front as it takes to differ from every column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def free_prefix(df: DataFrame) -> str:
    """As many underscores as no column of df begins with."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def heavy_bound(total: int) -> int:
    """Rows of a key that is not heavy, of so many rows."""
    return max(total // HEAVY_SHARE, HEAVY_SHARE)


def heavy_safe_join(left: DataFrame, right: DataFrame, key: str | list[str], total: int, count_col: str) -> DataFrame:
    """Inner join of left with right, whose keys are unique and whose count_col says how many left rows hold each.

    Keys over total / HEAVY_SHARE rows are at most HEAVY_SHARE in number, so they are broadcast and their rows
    stay where they are; all others meet in an ordinary join in which no key is large.
    """
    bound = heavy_bound(total)
    heavy = F.broadcast(right.filter(F.col(count_col) > bound).drop(count_col))
    light = right.filter(F.col(count_col) <= bound).drop(count_col)
    hot = left.join(heavy, key)
    cold = left.join(heavy.select(key), key, "left_anti").join(light, key)
    return hot.unionByName(cold)
