"""Collecting queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def collector() -> tuple[dict[str, Query], dict[str, str], Callable[[str | None], Callable[[Query], Query]]]:
    """(queries, SQL, decorator): a function decorated with its SQL (or None) is registered under its own name."""
    queries: dict[str, Query] = {}
    sqls: dict[str, str] = {}

    def register(sql: str | None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return keep

    return queries, sqls, register


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; timestamps without zone are taken as UTC."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines that sum in another order agree; negative zero becomes zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c, kind in df.dtypes if kind in ("double", "float")})
