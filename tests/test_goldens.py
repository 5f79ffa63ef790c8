"""Small inputs with answers worked out by hand."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marlpit.operators import charts, contracts, evaluation, features, monitoring, profile, splits, timeseries
from marlpit.operators import transforms as t
from marlpit.plans import dag, sql
from marlpit.sources import tables


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_join_filter_derive(spark):
    customers = spark.createDataFrame([(1, "enterprise"), (2, "smb"), (3, "smb")], "customer_id long, segment string")
    orders = spark.createDataFrame([(10, 1, 100), (11, 1, 40), (12, 2, 20), (13, 3, 60)], "order_id long, customer_id long, amount long")
    definition = {
        "inputs": ["orders", "customers"],
        "steps": [
            {"id": "gross", "kind": "derive_column", "inputs": ["large"], "config": {"name": "gross", "tree": {"op": "multiply", "args": [{"column": "amount"}, {"literal": 1.23}]}}},
            {"id": "joined", "kind": "join", "inputs": ["orders", "customers"], "config": {"keys": [("customer_id", "customer_id")]}},
            {"id": "large", "kind": "filter_rows", "inputs": ["joined"], "config": {"conditions": [{"column": "amount", "operator": "gte", "value": 50}]}},
            {"id": "out", "kind": "select_columns", "inputs": ["gross"], "config": {"columns": ["order_id", "segment", "gross"]}},
        ],
        "outputs": ["out"],
    }
    out = dag.run(definition, {"orders": orders, "customers": customers})["out"]
    assert [(a, b, round(c, 6)) for a, b, c in rows(out, "order_id")] == [(10, "enterprise", 123.0), (13, "smb", 73.8)]
    definition["steps"][1]["inputs"] = ["gross", "customers"]
    with pytest.raises(ValueError, match="cycle"):
        dag.run(definition, {"orders": orders, "customers": customers})


def test_impute(spark):
    df = spark.createDataFrame([(1, 1.0, "setosa", "yes"), (2, None, "setosa", "yes"), (3, 3.0, None, "yes"), (4, 100.0, "virginica", None)], "id long, petal double, species string, required string")
    rules = [{"column": "petal", "method": "median", "add_indicator": True}, {"column": "species", "method": "mode", "add_indicator": True}, {"column": "required", "method": "drop_rows"}]
    out = t.impute_missing(df, rules).select("id", "petal", "petal__was_missing", "species", "species__was_missing")
    assert rows(out, "id") == [(1, 1.0, False, "setosa", False), (2, 2.0, True, "setosa", False), (3, 3.0, False, "setosa", True)]


def test_contract(spark):
    df = spark.createDataFrame([(1, 10, "retail"), (2, -5, "retail"), (2, 20, "unknown"), (4, None, "business")], "id long, amount long, segment string")
    e = [contracts.Expectation("id", "unique", None, "warn"), contracts.Expectation("amount", "nullable"), contracts.Expectation("amount", "minimum", 0), contracts.Expectation("segment", "allowed_values", ["retail", "business"])]
    accepted, rejected = contracts.split(df, e)
    assert rows(accepted.select("id")) == [(1,)]
    assert rows(rejected.select("id", contracts.REASON), "id", contracts.REASON) == [(2, "amount.minimum"), (2, "segment.allowed_values"), (4, "amount.nullable")]
    assert tuple(contracts.report(df, e).first()) == ("issues_detected", 4, 3, 1)
    with pytest.raises(ValueError):
        contracts.enforce(df, [contracts.Expectation("id", "unique", None, "fail")])


def test_identifiers(spark):
    df = spark.createDataFrame([("b", "2025-01-02", 10), ("a", "2025-01-01", 20), ("a", "2025-01-03", None)], "customer string, day string, value long")
    assert rows(t.sequence_identifier(df, "n", ["day"], 100).select("customer", "n"), "n") == [("a", 100), ("b", 101), ("a", 102)]
    ids = [r.h for r in t.hash_identifier(df, "h").collect()]
    assert len(set(ids)) == 3 and all(len(x) == 64 for x in ids) and sorted(ids) == sorted(r.h for r in t.hash_identifier(df, "h").collect())


def test_classification(spark):
    df = spark.createDataFrame([(0, 0, 0.05), (0, 0, 0.20), (0, 1, 0.60), (1, 0, 0.40), (1, 1, 0.80), (1, 1, 0.95)], "actual int, prediction int, p double")
    assert evaluation.classification_summary(df, "actual", "prediction").first().accuracy == pytest.approx(4 / 6)
    r = evaluation.ranking(df, "actual", "p", "1").first()
    assert (r.roc_auc, r.average_precision) == (pytest.approx(8 / 9), pytest.approx(0.9166666667))
    assert rows(evaluation.confusion(df, "actual", "prediction"), "actual", "predicted") == [("0", "0", 2), ("0", "1", 1), ("1", "0", 1), ("1", "1", 2)]
    assert evaluation.curves(df, "actual", "p", "1").count() <= 101


def test_regression(spark):
    df = spark.range(1000).select(F.col("id").alias("actual"), (F.col("id") + F.when(F.col("id") % 2 == 0, 1).otherwise(-1)).alias("prediction"))
    r = evaluation.regression_summary(df, "actual", "prediction").first()
    assert (r.mae, r.rmse) == (1.0, 1.0) and r.r2 > 0.99
    assert evaluation.residual_histogram(df, "actual", "prediction").agg(F.sum("n")).first()[0] == 1000
    q = evaluation.qq_points(df, "actual", "prediction").collect()
    assert len(q) == 99 and (q[49].residual, round(q[49].normal, 9)) == (0.0, 0.0)


def test_request_health(spark):
    at = lambda h, m: datetime(2025, 1, 1, h, m)
    log = spark.createDataFrame(
        [("r1", "a", "m", at(0, 30), "succeeded", False, 100, True), ("r1", "b", "m", at(0, 30), "succeeded", False, 100, False), ("r2", "c", "m", at(2, 15), "failed", True, 300, False)],
        "request_id string, record_id string, model_id string, scored_at timestamp, request_status string, fallback_used boolean, request_latency_ms int, served boolean",
    )
    out = monitoring.request_health(log, "2025-01-01 00:15:00", "2025-01-01 03:00:00").orderBy("bucket").collect()
    assert [(r.requests, r.executions, r.failed) for r in out] == [(1, 2, 0), (0, 0, 0), (1, 1, 1)]


def test_metrics_by_hour(spark):
    at = lambda h, m: datetime(2025, 1, 1, h, m)
    df = spark.createDataFrame([(at(0, 10), "0", "0", 0.1), (at(0, 20), "1", "1", 0.9), (at(1, 10), "0", "1", 0.9), (at(1, 20), "1", "0", 0.1)], "scored_at timestamp, actual string, prediction_value string, prediction_score double")
    out = monitoring.classification_over(monitoring.bucketed(df, "hour"), "1", ["bucket"]).orderBy("bucket").collect()
    assert [(r.evaluated, r.accuracy, r.roc_auc, r.average_precision) for r in out] == [(2, 1.0, 1.0, 1.0), (2, 0.0, 0.0, 0.5)]


def test_box_and_line(spark):
    df = spark.range(10_000).select((F.col("id") % 5).alias("bucket"), F.when(F.col("id") % 2 == 0, "setosa").otherwise("virginica").alias("species"), F.when(F.col("id") < 5000, 10).otherwise(30).alias("value"))
    line = charts.chart_aggregate(df, "bucket", "value", ["average", "median"], "species").collect()
    assert {(r.average, r.median) for r in line} == {(20.0, 20.0)} and len(line) == 10
    assert rows(charts.boxplot(df, "value", "species").select("n", "q1", "median", "q3", "low", "high", "outliers")) == [(5000, 10.0, 20.0, 30.0, 10.0, 30.0, 0)] * 2


def test_gaps_of_microseconds(spark):
    """Neighbours a microsecond apart are as regular as any: seconds since 1970 would round each distance to a multiple of 0.24 microseconds."""
    at = [datetime(2024, 1, 1) + timedelta(microseconds=i + (2 if i > 10 else 0)) for i in range(21)]
    df = spark.createDataFrame([(t, 1.0) for t in at], "ts timestamp, value double")
    assert rows(timeseries.gaps(df, "ts", "value")) == [(1, 0.95)]
    assert timeseries.cadence(df, "ts", "value").first().median == 1e-6


def test_series(spark):
    import math

    start, data, at = datetime(2025, 1, 1), [], datetime(2025, 1, 1)
    for i in range(240):
        if i:
            at += timedelta(hours=4 if i == 120 else 0 if i == 180 else 1)
        data.append((at, 20 + 4 * math.sin(2 * math.pi * i / 24) + 0.01 * i, float(i % 7), -float(i % 7)))
    df = spark.createDataFrame(data, "ts timestamp, value double, driver double, inverse double")
    assert start == data[0][0]
    assert timeseries.cadence(df, "ts", "value").first().median == 3600
    assert timeseries.gaps(df, "ts", "value").first().gaps == 1
    assert timeseries.quality(df, "ts", "value").first().duplicate_timestamps == 1
    acf = {r.lag: r.correlation for r in timeseries.acf(df, "ts", "value", 48).collect()}
    assert len(acf) == 48 and acf[24] > 0.9
    assert timeseries.suggest_period(timeseries.acf(df, "ts", "value", 30)).first().period in (23, 24, 25)
    assert timeseries.bins(df, "ts", "value").agg(F.sum("n")).first()[0] == 240
    f = timeseries.features(df, "ts", "value", 24).orderBy("position").collect()
    assert len(f) == 100 and (f[0].position, f[-1].position) == (1, 240) and f[1].lag_1 == f[0].v
    ranked = timeseries.driver_ranking(df, "ts", "value", ["driver", "inverse"], 6).collect()
    assert {r.driver for r in ranked} == {"driver", "inverse"}


def test_lags_reach_over_short_partitions(spark):
    df = spark.range(40).select((F.lit("2025-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("ts"), F.col("id").cast("double").alias("v"))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        out = timeseries.with_lags(df, "v", [1, 7, 25]).orderBy("position").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for r in out:
        assert (r.lag_1, r.lag_7, r.lag_25) == tuple(r.v - k if r.v >= k else None for k in (1, 7, 25))


def test_splits(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 2).alias("target"))
    s = splits.stratified_split(df, "id", "target", 0.1, 0.2)
    got = {(r.split_role, r.target): r["count"] for r in s.groupBy("split_role", "target").count().collect()}
    assert got == {("training", 0): 35, ("training", 1): 35, ("validation", 0): 5, ("validation", 1): 5, ("test", 0): 10, ("test", 1): 10}
    assert rows(s, "id") == rows(splits.stratified_split(df, "id", "target", 0.1, 0.2), "id")
    assert {r[0] for r in splits.folds(df, "id", 5, "stratified", "target").select("cv_fold").distinct().collect()} == set(range(5))
    with pytest.raises(ValueError):
        splits.check_split(df.withColumn("split_role", F.lit("training")), "id")


def test_target_mean(spark):
    train = spark.createDataFrame([(1, "A", 0, 0), (2, "A", 1, 1), (3, "B", 0, 2), (4, "B", 1, 0), (5, "A", 1, 1), (6, "B", 0, 2)], "id long, city string, y int, fold int")
    other = spark.createDataFrame([(7, "A"), (8, "C")], "id long, city string")
    a, b = features.encode_target_mean(train, other, "city", "y", "fold", 2.0)
    assert [(i, round(v, 6)) for i, v in rows(b.select("id", "city__target"), "id")] == [(7, 0.6), (8, 0.5)]
    by = {r.id: r.city__target for r in a.collect()}
    assert by[1] != by[2]


def test_fitted_on_training_only(spark):
    train = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 4.0), (3, 4.0, 5.0), (4, 8.0, 9.0)], "id long, x double, y double")
    far = spark.createDataFrame([(5, 100.0, 200.0)], "id long, x double, y double")
    recipe = [{"kind": "scale", "columns": ["x", "y"], "method": "minmax"}, {"kind": "pca", "columns": ["x", "y"], "n": 2}]
    state, _ = features.fit_recipe(train, recipe)
    assert state["states"][0] == {"x": [1.0, 7.0], "y": [2.0, 7.0]}
    assert features.transform(far, state, recipe).first().pc_1 > 10
    with pytest.raises(ValueError):
        features.transform(far, state, recipe[:1])
    assert features.apply_winsorize(far, features.fit_winsorize(train, ["x"], 0.0, 1.0)).first().x == 8.0


def test_profile_scans_all(spark):
    df = spark.range(60_000).select(F.when(F.col("id") < 50_000, 0).otherwise(60).alias("value"), (F.col("id") % 2).alias("target"))
    r = {x.column_name: x for x in profile.profile_columns(df).collect()}
    assert (r["value"]["count"], r["value"]["mean"]) == (60_000, 10.0)
    assert profile.histogram(df, "value").agg(F.sum("n")).first()[0] == 60_000
    assert profile.histogram(df.select(F.lit(3).alias("c")), "c").count() == 1


def test_relations_of_constants(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    r = profile.numeric_relation(df, "x", "y").first()
    assert r.pearson is None and r.spearman is None


def test_sql_is_kept_to_select(spark):
    df = spark.range(3)
    assert sql.select_over({"t": df}, "SELECT sum(id) AS s FROM t").first().s == 3
    for bad in ("DROP TABLE t", "CREATE TABLE x AS SELECT 1", "INSERT INTO t SELECT 1", "SET a=b"):
        with pytest.raises(ValueError):
            sql.select_over({"t": df}, bad)
    assert rows(t.filter_sql(df, "id > 0"), "id") == [(1,), (2,)]
    for bad in ("sum(id) > 1", "id IN (SELECT 1)", "row_number() OVER (ORDER BY id) > 1", "id > 1; DROP TABLE t"):
        with pytest.raises(ValueError):
            t.filter_sql(df, bad)


def test_csv(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("id,name,\n1,a,2.5\n2,b\n3,c,4\n")
    df = tables.read_csv(spark, str(f))
    assert len(df.columns) == 3 and rows(df, "id") == [(1, "a", 2.5), (2, "b", None), (3, "c", 4.0)]
    f.write_text("id,name\n1,a\n2,b,c,d\n")
    with pytest.raises(Exception, match="bad row"):
        tables.read_csv(spark, str(f)).collect()
    assert tables.normalize_column_names(["a", "", "A", None]) == ["a", "column_2", "A_2", "column_4"]


def test_failed_write_keeps_the_old_file(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    assert tables.write_parquet(spark.range(5), path)[0] == 5
    with pytest.raises(Exception, match="no"):
        tables.write_parquet(spark.range(5).select(F.raise_error(F.lit("no")).alias("x")), path)
    assert spark.read.parquet(path).count() == 5
    assert tables.write_parquet(spark.range(7), path)[0] == 7 and spark.read.parquet(path).count() == 7


def test_full_join_keys(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(2, "y")], "k int, v string")
    assert set(rows(t.join(a, b, [("k", "k")], "full"))) == {(1, "x", None), (None, None, "y")}
    assert set(rows(t.join(a, b, [("k", "k")], "full", coalesce_keys=True))) == {(1, "x", None), (2, None, "y")}


def test_many_to_many_is_refused(spark):
    p = spark.createDataFrame([("1", "a"), ("2", "b")], "row_id string, prediction string")
    truth = spark.createDataFrame([(1, "a"), (1, "b")], "e int, y string")
    with pytest.raises(ValueError):
        evaluation.join_actuals(p, truth, "row_id", "e", "y")


def test_spline_goes_through_its_nodes():
    import numpy as np

    x, y = np.array([0.0, 1.0, 2.5, 4.0]), np.array([1.0, 3.0, 2.0, 5.0])
    assert np.allclose(charts.natural_spline(x, y, x), y)
    assert np.allclose(charts.natural_spline(x, 2 * x + 1, np.linspace(0, 4, 9)), 2 * np.linspace(0, 4, 9) + 1)


def test_polynomial(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("x"), (3 + 2 * F.col("id") - 0.5 * F.col("id") ** 2).alias("y"))
    r = charts.trend_polynomial(df, "x", "y", 2).first()
    assert [round(c, 6) for c in r.coefficients] == [3.0, 2.0, -0.5] and r.r2 == pytest.approx(1.0)
