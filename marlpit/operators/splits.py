"""Deterministic splits and folds, by a hash that any engine can compute, or by time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.functions.lineage import range_parts
from marlpit.functions.semantics import portable_hash

SPLIT, FOLD = "split_role", "cv_fold"


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) of a million steps."""
    return F.pmod(portable_hash(key, F.lit(seed)), F.lit(1_000_000)) / F.lit(1_000_000.0)


def _role(score: Column, validation: float, test: float) -> Column:
    return F.when(score < test, "test").when(score < round(test + validation, 12), "validation").otherwise("training")


def random_split(df: DataFrame, key: str, validation: float = 0.1, test: float = 0.2, seed: int = 42) -> DataFrame:
    return df.withColumn(SPLIT, _role(unit_hash(F.col(key), seed), validation, test))


def group_split(df: DataFrame, group: str, validation: float = 0.1, test: float = 0.2, seed: int = 42) -> DataFrame:
    """All rows of a group share its role."""
    return random_split(df, group, validation, test, seed)


def _shares(df: DataFrame, by: Sequence[Column], keys: list[Column], name: str) -> DataFrame:
    """name: the place of a row in the order of keys within its class, from 0, over the class's size. Places are counted in range
    partitions and shifted, so a class isn't sorted in one task."""
    named = [c.alias(f"_c{i}") for i, c in enumerate(by)]
    classes = [f"_c{i}" for i in range(len(by))]
    ranged = range_parts(df.select("*", *named), keys, "_part")
    sizes = ranged.groupBy(*classes, "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*classes)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_n").over(w))
    inside = F.row_number().over(Window.partitionBy(*classes, "_part").orderBy(*keys))
    side = sizes.select(*[F.col(c).alias(f"_s{c}") for c in classes], F.col("_part").alias("_sp"), "_before", "_total")
    on = F.col("_part") == F.col("_sp")
    for c in classes:
        on = on & F.col(c).eqNullSafe(F.col(f"_s{c}"))
    placed = ranged.withColumn("_k", inside).join(side, on)
    placed = placed.withColumn(f"{name}_place", F.col("_k") + F.col("_before") - 1).withColumn(f"{name}_total", F.col("_total"))
    return placed.drop(*classes, *[f"_s{c}" for c in classes], "_part", "_sp", "_before", "_total", "_k")


def stratified_split(df: DataFrame, key: str, target: str, validation: float = 0.1, test: float = 0.2, seed: int = 42) -> DataFrame:
    """The same shares in each class, exact but for rounding."""
    h = portable_hash(F.col(key), F.lit(seed))
    placed = _shares(df, [F.col(target)], [h, F.col(key)], "_x")
    return placed.withColumn(SPLIT, _role(F.col("_x_place") / F.col("_x_total"), validation, test)).drop("_x_place", "_x_total")


def time_split(df: DataFrame, time: str, key: str, validation: float = 0.1, test: float = 0.2) -> DataFrame:
    """The latest rows are for the test, those before for validation."""
    placed = _shares(df, [], [F.col(time), F.col(key)], "_x")
    late = (F.col("_x_total") - 1 - F.col("_x_place")) / F.col("_x_total")
    return placed.withColumn(SPLIT, _role(late, validation, test)).drop("_x_place", "_x_total")


def folds(df: DataFrame, key: str, k: int = 5, method: str = "kfold", column: str | None = None, seed: int = 42) -> DataFrame:
    """cv_fold 0 to k - 1. method: kfold (by hash), unshuffled (by key in blocks), stratified (column is the target), group (column) or time (column)."""
    if method == "kfold":
        return df.withColumn(FOLD, F.pmod(portable_hash(F.col(key), F.lit(seed)), F.lit(k)).cast("int"))
    if method == "group":
        return df.withColumn(FOLD, F.pmod(portable_hash(F.col(column), F.lit(seed)), F.lit(k)).cast("int"))
    if method == "stratified":
        placed = _shares(df, [F.col(column)], [portable_hash(F.col(key), F.lit(seed)), F.col(key)], "_x")
        return placed.withColumn(FOLD, F.pmod("_x_place", F.lit(k)).cast("int")).drop("_x_place", "_x_total")
    placed = _shares(df, [], [F.col(column), F.col(key)] if method == "time" else [F.col(key)], "_x")
    # as ntile: the first total % k folds have one row more
    size, extra, at = F.floor(F.col("_x_total") / k), F.col("_x_total") % k, F.col("_x_place")
    big = extra * (size + 1)
    return placed.withColumn(FOLD, F.when(at < big, F.floor(at / (size + 1))).otherwise(extra + F.floor((at - big) / F.greatest(size, F.lit(1)))).cast("int")).drop("_x_place", "_x_total")


def split_report(df: DataFrame, role: str = SPLIT) -> DataFrame:
    return df.groupBy(role).agg(F.count("*").alias("n"))


def check_split(df: DataFrame, key: str, roles: Sequence[str] = ("training", "validation", "test")) -> None:
    """An error if a key is null or a role has no rows."""
    if df.filter(F.col(key).isNull()).limit(1).count():
        raise ValueError(f"{key} has nulls")
    met = {r[0] for r in split_report(df).collect()}  # a row per role
    if set(roles) - met:
        raise ValueError(f"no rows for {sorted(set(roles) - met)}")


def forward_chain(df: DataFrame, fold: int, column: str = FOLD) -> tuple[DataFrame, DataFrame]:
    """(rows of earlier folds, rows of this one)."""
    return df.filter(F.col(column) < fold), df.filter(F.col(column) == fold)
