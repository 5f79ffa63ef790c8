"""Column expressions that fix one meaning for cases in which engines differ: division, correlation, order of nulls, hashes, casts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    FractionalType,
    IntegralType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

#: Types that a cast may name, and the Spark type of each.
CAST_TYPES = {
    "BOOLEAN": "boolean", "TINYINT": "tinyint", "SMALLINT": "smallint", "INTEGER": "int", "BIGINT": "bigint", "FLOAT": "float",
    "DOUBLE": "double", "DECIMAL": "decimal(18,3)", "VARCHAR": "string", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "TIMESTAMPTZ": "timestamp",
}
INTEGER_TYPES = {"TINYINT", "SMALLINT", "INTEGER", "BIGINT"}


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def is_finite(x: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    d = x.cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), F.lit(False))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows in which both are given; null if either is constant."""
    a = F.when(x.isNotNull() & y.isNotNull(), x.cast("double"))
    b = F.when(x.isNotNull() & y.isNotNull(), y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def sample_skewness(x: Column) -> Column:
    """Adjusted for sample size; null for fewer than three values."""
    n = F.count(x).cast("double")
    spread = F.coalesce(F.stddev_pop(x), F.lit(0.0))
    return F.when((n > 2) & (spread > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def portable_hash(*parts: Column) -> Column:
    """A 60-bit number from md5 of the parts' text joined by '|', the same in any engine."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def order(column: str | Column, direction: str = "asc") -> Column:
    """A sort key with nulls last in either direction."""
    c = F.col(column) if isinstance(column, str) else column
    return c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last()


def orders(columns: Iterable[str]) -> list[Column]:
    return [order(c) for c in columns]


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def family(kind: DataType) -> str:
    """number, boolean, date or text."""
    if isinstance(kind, BooleanType):
        return "boolean"
    if isinstance(kind, NumericType):
        return "number"
    if isinstance(kind, DateType | TimestampType | TimestampNTZType):
        return "date"
    return "text"


def contract_family(kind: DataType) -> str:
    """Families in which a data contract lets types stand for each other."""
    if isinstance(kind, IntegralType | FractionalType):
        return "numeric"
    if isinstance(kind, TimestampType | TimestampNTZType):
        return "timestamp"
    if isinstance(kind, StringType):
        return "text"
    return kind.simpleString()


def strict_cast(column: Column, kind: str, source: DataType | None = None) -> Column:
    """A cast that fails on bad values; fractions are rounded on their way to whole numbers: binary ones half to even, decimal ones half away from zero."""
    if kind in INTEGER_TYPES and isinstance(source, FractionalType):
        column = F.round(column) if isinstance(source, DecimalType) else F.rint(column)
    return column.cast(CAST_TYPES[kind])
