"""SELECT statements over named DataFrames, and the check that a text is one scalar expression."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of plans that do something else than select.
OTHER_PLANS = ("org.apache.spark.sql.catalyst.plans.logical.Command", "org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")


def select_over(inputs: Mapping[str, DataFrame], text: str) -> DataFrame:
    """One SELECT (or WITH ... SELECT) whose tables are the inputs; anything that would change state is refused before it runs."""
    spark = next(iter(inputs.values())).sparkSession
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    if any(spark._jvm.java.lang.Class.forName(kind).isInstance(parsed) for kind in OTHER_PLANS):
        raise ValueError("only SELECT is allowed")
    suffix = uuid.uuid4().hex[:8]
    names = {name: f"{name}_{suffix}" for name in inputs}
    for name, df in inputs.items():
        df.createOrReplaceTempView(names[name])
    try:
        ctes = ", ".join(f"`{name}` AS (SELECT * FROM `{view}`)" for name, view in names.items())
        body = text.strip().rstrip(";")
        if body[:4].lower() == "with":
            return spark.sql(f"WITH {ctes}, {body[4:]}")
        return spark.sql(f"WITH {ctes} {body}")
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)


def query(df: DataFrame, text: str, limit: int = 1000) -> tuple[DataFrame, int]:
    """(the first rows, the number of all rows) of a SELECT over the table "dataset"; repeated output names are refused."""
    out = select_over({"dataset": df}, text)
    names = [c.lower() for c in out.columns]
    if len(set(names)) < len(names):
        raise ValueError("repeated column names in the result")
    return out.limit(limit), out.count()


def is_scalar(df: DataFrame, text: str) -> bool:
    """Whether the text is one expression over a row of df: no clause, subquery, aggregate, window or generator."""
    try:
        plan = df.select(F.expr(text).alias("_x"))._jdf.queryExecution().analyzed()
    except (AnalysisException, ParseException):  # what Spark cannot read as an expression
        return False
    # a scalar adds one projection to the plan of df; anything else adds more nodes
    lines = [x for x in plan.toString().split("\n") if x.strip()]
    own = [x for x in df._jdf.queryExecution().analyzed().toString().split("\n") if x.strip()]
    return lines[0].startswith("Project") and len(lines) == len(own) + 1
