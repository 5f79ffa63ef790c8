"""The full profile against the single operators of which it is made up."""

import pytest
from pyspark.sql import functions as F

from compare import canonical
from conftest import SMALL
from marlpit.operators import profile as pr
from marlpit.operators.full_profile import full_profile
from marlpit.queries.registry import read, rounded


def same(ours, theirs):
    columns = theirs.columns
    a, b = canonical(rounded(ours.select(*columns), 5).toPandas()), canonical(rounded(theirs, 5).toPandas())
    assert a == b, (columns, [(x, y) for x, y in zip(a, b) if x != y][:3], len(a), len(b))


@pytest.fixture(scope="module")
def table(spark):
    df = read(spark, SMALL, "lineitem").select("l_orderkey", F.nullif("l_discount", F.lit(0.0)).alias("discount"), "l_quantity", "l_extendedprice", "l_linestatus", "l_linenumber", "l_returnflag", "l_shipdate")
    return df.withColumn("flag", F.when(F.col("l_orderkey") % 11 > 0, F.col("l_returnflag"))).drop("l_returnflag").persist()


ROLES = {"l_orderkey": "identifier", "l_shipdate": "timestamp", "l_linenumber": "feature_categorical"}


def test_categorical_target(table):
    out = full_profile(table, "flag", focus="R", roles=ROLES)
    same(out["columns"], pr.profile_columns(table))
    same(out["top_values"], pr.top_values(table, table.columns))
    known = table.filter("flag IS NOT NULL")
    numbers = ["l_quantity", "l_extendedprice"]
    assert {r.column_name for r in out["groups"].select("column_name").distinct().collect()} == set(numbers)
    for c in numbers:
        mine = lambda part: out[part].filter(F.col("column_name") == c)  # noqa: B023, E731
        same(mine("histograms"), pr.histogram(table, c))
        same(mine("groups"), pr.grouped_relation(known, "flag", c))
        same(mine("densities").withColumn("density", F.round(F.col("density") * 1e6, 3)), pr.density(known, c, "flag").withColumn("density", F.round(F.col("density") * 1e6, 3)))
    for c in ("l_linestatus", "l_linenumber"):
        same(out["contingencies"].filter(F.col("column_name") == c), pr.contingency(table, c, "flag"))
        same(out["trends"].filter(F.col("column_name") == c), pr.ordinal_trend(known, c, F.col("flag") == "R"))
    same(out["segments"], pr.segment_scan_categorical(table, ["discount", "l_linestatus", "l_linenumber"], "flag", "R"))
    assert ("l_shipdate", "categorical") in {tuple(r) for r in out["target_types"].collect()} and ("l_quantity", "continuous") in {tuple(r) for r in out["target_types"].collect()}


def test_continuous_target(table):
    out = full_profile(table, "l_extendedprice", "continuous", roles=ROLES)
    same(out["relations"].filter("feature = 'l_quantity'"), pr.numeric_relation(table, "l_quantity", "l_extendedprice"))
    same(out["groups"].filter("feature = 'flag'"), pr.grouped_relation(table, "flag", "l_extendedprice"))
    assert {r.feature for r in out["relations"].collect()} == {"l_quantity"}  # l_discount has 11 values and so is a category
    assert "segments" in out and {r.feature for r in out["groups"].select("feature").distinct().collect()} == {"flag", "discount", "l_linestatus", "l_linenumber"}


def test_a_measure_has_more_than_twelve_values_and_no_categorical_role(spark):
    df = spark.range(200).select(*[(F.col("id") % n).cast("double").alias(f"v{n}") for n in (12, 13, 20, 60)], F.col("id").cast("double").alias("y"))
    out = full_profile(df, "y", "continuous", roles={"v60": "feature_ordinal"})
    assert {r.feature for r in out["relations"].collect()} == {"v13", "v20"}
    jobs = lambda n: len(spark.sparkContext.statusTracker().getJobIdsForGroup(n))
    counts = []
    for n, columns in (("one", ["v13"]), ("three", ["v13", "v20", "v60"])):
        spark.sparkContext.setJobGroup(n, n)
        pr.numeric_relations(df, columns, "y").collect()
        counts.append(jobs(n))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(counts[0] - counts[1]) <= 2 and counts[0] > 0  # a stage more or less, as adaptive execution goes


def test_too_many_groups_are_refused(spark):
    df = spark.range(1500).select(F.col("id").cast("double").alias("x"), F.col("id").cast("string").alias("g"))
    with pytest.raises(ValueError, match="more than 100 groups"):
        pr.histogram(df, "x", groups=["g"])
    with pytest.raises(ValueError, match="more than 100 groups"):
        pr.density(df, "x", "g")
    with pytest.raises(ValueError, match="more than 1000 values of x"):
        pr.contingency(df, "x", "g")


def test_without_target_and_without_rows(spark, table):
    out = full_profile(table.select("l_quantity", "l_linestatus"))
    assert set(out) == {"columns", "notes", "dataset_notes", "target_types", "top_values", "histograms"}
    empty = full_profile(table.filter("l_quantity < 0"), "flag")
    assert {tuple(r) for r in empty["columns"].select("count", "missing", "distinct_values").collect()} == {(0, 0, 0)}
    assert empty["top_values"].count() == 0 and empty["histograms"].count() == 0
    one = full_profile(spark.createDataFrame([(1.0, "a"), (1.0, "b"), (None, "a")], "x double, y string"), "y")
    assert [(r.bin, r.n) for r in one["histograms"].collect()] == [(0, 2)]


def test_only_the_parts_that_are_named_are_computed(spark, monkeypatch):
    """Relations and groups of a continuous target each read all rows; one is not computed for the other."""
    from marlpit.operators import profile

    df = spark.range(200).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3).alias("g"), (F.col("id") * 2.0).alias("y"))
    made = []
    for name in ("numeric_relations", "grouped_relations"):
        monkeypatch.setattr(profile, name, lambda *a, _name=name, _real=getattr(profile, name): made.append(_name) or _real(*a))
    assert full_profile(df, "y", "continuous", parts=["groups"])["groups"].count() == 3 and made == ["grouped_relations"]
    assert full_profile(df, "y", "continuous", parts=["relations"])["relations"].count() == 1 and made == ["grouped_relations", "numeric_relations"]
