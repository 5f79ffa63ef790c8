"""Data contracts: checks counted in one scan, rows accepted or rejected with reasons, schema drift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.functions.semantics import contract_family, is_finite

ROW_NUMBER, REASON = "_quality_source_row_number", "_quality_rejection_reason"


#: Frequent values that are broadcast, so that their rows stay where they are.
HOT_VALUES = 1000


@dataclass(frozen=True)
class Expectation:
    """check: nullable, unique, minimum, maximum or allowed_values; policy: fail, warn or reject."""

    column: str
    check: str
    value: Any = None
    policy: str = "reject"

    @property
    def label(self) -> str:
        return f"{self.column}.{self.check}"


def _mark_repeated(df: DataFrame, expectations: Sequence[Expectation]) -> DataFrame:
    """df with a flag for each unique check: whether the value occurs more than once. Values are counted; rows of the HOT_VALUES most frequent ones get the flag where they are,
    so a frequent value isn't gathered, and neither are nulls."""
    for e in expectations:
        if e.check == "unique":
            flag, value = f"_rep_{e.column}", F.col(e.column)
            many = df.filter(value.isNotNull()).groupBy(value.alias("_v")).agg(F.count("*").alias("_n")).filter("_n > 1")
            hot = F.broadcast(many.orderBy(F.desc("_n"), "_v").limit(HOT_VALUES).select("_v"))
            given = df.filter(value.isNotNull())
            frequent = given.join(hot, value == F.col("_v"), "left_semi").withColumn(flag, F.lit(True))
            rest = given.join(hot, value == F.col("_v"), "left_anti").join(many.select("_v", F.lit(True).alias(flag)), value == F.col("_v"), "left").drop("_v")
            df = frequent.unionByName(rest).unionByName(df.filter(value.isNull()).withColumn(flag, F.lit(None).cast("boolean")))
    return df


def violated(e: Expectation) -> Column:
    """True where a row breaks the expectation; never null."""
    c = F.col(e.column)
    test = {
        "nullable": lambda: c.isNull(),
        "unique": lambda: F.col(f"_rep_{e.column}"),
        "minimum": lambda: c < F.lit(e.value),
        "maximum": lambda: c > F.lit(e.value),
        "allowed_values": lambda: c.isNotNull() & ~c.isin(list(e.value)),
    }[e.check]()
    return F.coalesce(test, F.lit(False))


def violations(df: DataFrame, expectations: Sequence[Expectation]) -> DataFrame:
    """column_name, check, policy, violations, passed: all counted in one aggregate."""
    marked = _mark_repeated(df, expectations)
    parts = [F.struct(F.lit(e.column).alias("column_name"), F.lit(e.check).alias("check"), F.lit(e.policy).alias("policy"), F.count_if(violated(e)).alias("violations")) for e in expectations]
    return marked.agg(F.array(*parts).alias("c")).select(F.explode("c").alias("c")).select("c.*").withColumn("passed", F.col("violations") == 0)


def split(df: DataFrame, expectations: Sequence[Expectation]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with the labels of the checks that they broke)."""
    rejecting = [e for e in expectations if e.policy == "reject"]
    reason = F.concat_ws("; ", *[F.when(violated(e), F.lit(e.label)) for e in rejecting]) if rejecting else F.lit("")
    marked = _mark_repeated(df, rejecting).withColumn(REASON, reason)
    marked = marked.drop(*[f"_rep_{e.column}" for e in rejecting])
    return marked.filter(F.col(REASON) == "").drop(REASON), marked.filter(F.col(REASON) != "")


def rejected_rows(df: DataFrame, expectations: Sequence[Expectation], order_by: Sequence[str]) -> DataFrame:
    """Rejected rows with their number in the order of the source."""
    from marlpit.operators.transforms import sequence_identifier

    return split(sequence_identifier(df, ROW_NUMBER, order_by), expectations)[1]


def report(df: DataFrame, expectations: Sequence[Expectation]) -> DataFrame:
    """One row: status (passed, issues_detected or not_configured), rows checked and rejected, checks that warn."""
    if not expectations:
        return df.agg(F.lit("not_configured").alias("status"), F.count("*").alias("checked"), F.lit(0).cast("bigint").alias("rejected"), F.lit(0).cast("bigint").alias("warnings"))
    marked = _mark_repeated(df, expectations)
    rejecting = [violated(e) for e in expectations if e.policy == "reject"]
    rejected = F.count_if(reduce(or_, rejecting)) if rejecting else F.lit(0).cast("bigint")
    warned = sum(F.when(F.count_if(violated(e)) > 0, 1).otherwise(0) for e in expectations if e.policy == "warn") if any(e.policy == "warn" for e in expectations) else F.lit(0)
    any_broken = reduce(or_, [F.count_if(violated(e)) > 0 for e in expectations])
    return marked.agg(F.when(any_broken, "issues_detected").otherwise("passed").alias("status"), F.count("*").alias("checked"), rejected.alias("rejected"), warned.cast("bigint").alias("warnings"))


def enforce(df: DataFrame, expectations: Sequence[Expectation]) -> DataFrame:
    """Accepted rows; an error if a check whose policy is fail is broken."""
    hard = [e for e in expectations if e.policy == "fail"]
    if hard:
        broken = [r for r in violations(df, hard).collect() if not r.passed]  # one row for each check
        if broken:
            raise ValueError("; ".join(f"{r.column_name}.{r.check}: {r.violations}" for r in broken))
    return split(df, expectations)[0]


def schema_drift(df: DataFrame, contract: Mapping[str, str], policy: str = "warn") -> DataFrame:
    """column_name, issue (missing_column, type_mismatch, unexpected_column), expected, actual, policy."""
    spark = df.sparkSession
    expected = spark.createDataFrame([], ", ".join(f"`{c}` {k}" for c, k in contract.items())).schema
    rows = []
    for f in expected.fields:
        if f.name not in df.columns:
            rows.append((f.name, "missing_column", f.dataType.simpleString(), None, policy))
        elif contract_family(f.dataType) != contract_family(df.schema[f.name].dataType):
            rows.append((f.name, "type_mismatch", f.dataType.simpleString(), df.schema[f.name].dataType.simpleString(), policy))
    rows += [(f.name, "unexpected_column", None, f.dataType.simpleString(), policy) for f in df.schema.fields if f.name not in contract]
    if rows and policy == "fail":
        raise ValueError("; ".join(f"{r[0]}: {r[1]}" for r in rows))
    return spark.createDataFrame(rows, "column_name string, issue string, expected string, actual string, policy string")


def matrix_check(df: DataFrame, features: Sequence[str], target: str | None = None, max_classes: int = 1000) -> DataFrame:
    """One row for a training matrix: rows, rows with a feature that isn't finite, classes of the target, usable or not."""
    bad = reduce(or_, [~is_finite(F.col(c)) for c in features])
    classes = F.count_distinct(target) if target else F.lit(None).cast("bigint")
    out = df.agg(F.count("*").alias("rows"), F.count_if(bad).alias("bad_rows"), classes.alias("classes"))
    fine = (F.col("rows") >= 2) & (F.col("bad_rows") == 0)
    return out.withColumn("usable", fine & F.col("classes").between(2, max_classes) if target else fine)
