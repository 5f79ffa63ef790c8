"""Places, ranks and exact quantiles by range partitions: no group of rows and no set of distinct values is ordered or held in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.functions.lineage import range_parts


def same_keys(left: Sequence[Column], right: Sequence[Column]) -> Column:
    return reduce(and_, [a.eqNullSafe(b) for a, b in zip(left, right, strict=True)])


def placed(rows: DataFrame, keys: Sequence[str], by: Sequence[Column], sums: Sequence[str]) -> DataFrame:
    """rows with, for each column of sums, <column>_before (its sum over the rows of the same keys that stand before in the order of ``by``) and <column>_all (over all of them).

    Each range partition is summed up by itself and shifted by the sums of those before it."""
    return shifted(range_parts(rows, [*map(F.col, keys), *by], "_part"), keys, by, sums).drop("_part")


def shifted(ranged: DataFrame, keys: Sequence[str], by: Sequence[Column], sums: Sequence[str]) -> DataFrame:
    """placed, for rows that are in range partitions (_part) of keys and by already."""
    per = ranged.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    mine = Window.partitionBy(*keys)  # a row for each range partition that a key reaches into
    earlier = mine.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = [F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in sums]
    side = per.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), *shifts, *[F.sum(f"_s_{c}").over(mine).alias(f"{c}_all") for c in sums])
    own = Window.partitionBy(*keys, "_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumns({f"_i_{c}": F.coalesce(F.sum(c).over(own), F.lit(0)) for c in sums})
    on = same_keys([*map(F.col, keys), F.col("_part")], [*[F.col(f"_k_{k}") for k in keys], F.col("_p")])
    joined = inside.join(side if keys else F.broadcast(side), on)  # without keys one row for each partition
    joined = joined.withColumns({f"{c}_before": F.col(f"_b_{c}") + F.col(f"_i_{c}") for c in sums})
    return joined.drop("_p", *[f"_k_{k}" for k in keys], *[f"{x}{c}" for x in ("_b_", "_i_") for c in sums])


def around(value: str, n: str, p: float, name: str) -> list[Column]:
    """Aggregates over placed distinct values with their counts: the two values that the p quantile lies between, and their number."""
    start, total = F.col(f"{n}_before"), F.col(f"{n}_all")
    ends = (("lo", F.floor(F.lit(p) * (total - 1))), ("hi", F.ceil(F.lit(p) * (total - 1))))
    return [F.max(F.when((start <= at) & (at < start + F.col(n)), F.col(value))).alias(f"{name}_{end}") for end, at in ends]


def between(lo: Column, hi: Column, total: Column, p: float) -> Column:
    """The interpolated p quantile of so many values."""
    place = F.lit(p) * (total - 1)
    return F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (place - F.floor(place)))


def picked(cells: DataFrame, keys: Sequence[str], value: str, n: str, probs: Sequence[float], name: str, *more: Column) -> DataFrame:
    """keys, an array with the interpolated quantiles, and more aggregates, of placed distinct values with their counts."""
    out = cells.groupBy(*keys).agg(*[c for i, p in enumerate(probs) for c in around(value, n, p, f"_{i}")], F.max(f"{n}_all").alias("_total"), *more)
    each = [between(F.col(f"_{i}_lo"), F.col(f"_{i}_hi"), F.col("_total"), p) for i, p in enumerate(probs)]
    return out.select(*keys, F.when(F.col("_total") > 0, F.array(*each)).alias(name), *[c for c in out.columns if c not in keys and not c.startswith("_")])


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], name: str = "q") -> DataFrame:
    """keys and an array of exact, interpolated quantiles of the values that are given; without keys one row."""
    given = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    return picked(placed(given, keys, [F.col("_v")], ["_n"]), keys, "_v", "_n", probs, name)


def with_quantiles(summary: DataFrame, rows: DataFrame, keys: Sequence[str], value: str, named: Mapping[str, float]) -> DataFrame:
    """A summary by keys (one row without them) with a column for each named quantile of value over the rows of the keys."""
    found = quantiles(rows, keys, value, list(named.values()), "_q")
    if keys:
        found = found.select(F.col("_q"), *[F.col(k).alias(f"_k_{k}") for k in keys])
        joined = summary.join(found, same_keys([*map(F.col, keys)], [F.col(f"_k_{k}") for k in keys]), "left")
    else:
        joined = summary.crossJoin(F.broadcast(found))  # one row each
    return joined.select(*[F.col(c) for c in summary.columns], *[F.get("_q", F.lit(i)).alias(c) for i, c in enumerate(named)])


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float] | None]:
    """Exact quantiles of several columns, found together."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns]))
    found = quantiles(df.select(cells.alias("c")).select("c.*"), ["name"], "x", probs)
    return {c: None for c in columns} | {r["name"]: r["q"] for r in found.collect()}  # a row for each column
