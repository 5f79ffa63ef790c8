"""Classes, weights and metrics of models where the answer is known."""

import math

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from marlpit.functions.lineage import hadoop_path, pinned, shared_folder, drop_scratch
from marlpit.functions.semantics import portable_hash
from marlpit.operators import models as mo


@pytest.fixture(scope="module")
def thirds(spark):
    """60 rows in three classes that x tells apart."""
    return spark.range(60).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("x"), F.floor(F.col("id") / 20).alias("target"))


def test_balanced_weights_are_those_of_all_rows(spark):
    df = spark.range(40).select(F.col("id").cast("double").alias("x"), (F.col("id") >= 30).cast("int").alias("target"))
    fitted = mo.fit(df, mo.Spec("classification", "target", ("x",), "logistic", {"maxIter": 5}, class_weight="balanced"))
    assert fitted.class_weights == pytest.approx({"0": 2 / 3, "1": 2.0})
    given = mo.fit(df, mo.Spec("classification", "target", ("x",), "decision_tree", {"maxDepth": 0}, class_weight={"0": 1, "1": 3}))
    p = mo.score(df.withColumn("row_id", F.col("x")), given, "row_id").first()
    assert p.probability_0 == p.probability_1 == 0.5
    rows = mo.fit(df.withColumn("w", F.col("target") * 2 + 1), mo.Spec("classification", "target", ("x",), "decision_tree", {"maxDepth": 0}, weight="w"))
    assert mo.score(df.withColumn("row_id", F.col("x")), rows, "row_id").first().probability_1 == 0.5


@pytest.mark.parametrize(
    "algorithm, options, message",
    [("mlp", {"class_weight": "balanced"}, "takes no weights"), ("logistic", {"class_weight": {"0": 1.0}}, "no weight for the classes"), ("logistic", {"calibrate": 0.2, "key": "row_id"}, "calibrate"), ("linear_svc", {"calibrate": 0.2}, "key")],
)
def test_what_is_refused(spark, thirds, algorithm, options, message):
    with pytest.raises(ValueError, match=message):
        mo.fit(thirds, mo.Spec("classification", "target", ("x",), algorithm, {"layers": [1, 3]} if algorithm == "mlp" else {}, **options))


def test_targets_with_too_many_classes_are_refused(spark):
    with pytest.raises(ValueError, match="more than 1000 classes"):
        mo.fit(spark.range(1001).select("id", F.col("id").cast("double").alias("x")), mo.Spec("classification", "id", ("x",), "logistic"))
    with pytest.raises(ValueError, match="at least two"):
        mo.fit(spark.range(5).select(F.lit("a").alias("t"), F.col("id").cast("double").alias("x")), mo.Spec("classification", "t", ("x",), "logistic", class_weight="balanced"))


def test_three_classes_by_learners_of_two(spark, thirds):
    boosted = mo.fit(thirds, mo.Spec("classification", "target", ("x",), "gradient_boosting", {"maxIter": 3}))
    out = mo.score(thirds, boosted, "row_id", ["target"])
    assert out.columns == ["row_id", "prediction", "prediction_score", "probability_0", "probability_1", "probability_2", "target"]
    assert out.filter("prediction <> target").count() <= 3  # thresholds lie on the edges of 32 bins
    for r in out.collect():
        shares = [r.probability_0, r.probability_1, r.probability_2]
        assert sum(shares) == pytest.approx(1) and r.prediction_score == max(shares) == shares[int(r.prediction)]
    margins = mo.fit(thirds, mo.Spec("classification", "target", ("x",), "linear_svc", {"maxIter": 10}))
    assert mo.score(thirds, margins, "row_id").columns == ["row_id", "prediction", "prediction_score"]  # margins are no probabilities
    whole = mo.fit(thirds, mo.Spec("classification", "target", ("x",), "linear_svc", {"maxIter": 10}, calibrate=0.4, key="row_id"))
    for r in mo.score(thirds, whole, "row_id").collect():
        shares = [r.probability_0, r.probability_1, r.probability_2]
        assert all(0 <= p <= 1 for p in shares) and sum(shares) == pytest.approx(1)


def test_one_metric_judges_all(spark, thirds):
    specs = [mo.Spec("classification", "target", ("x",), a, p) for a, p in (("decision_tree", {}), ("mlp", {"layers": [1, 4, 3], "maxIter": 5}))]
    best, table = mo.compare(thirds, thirds.withColumn("row_id", F.col("row_id") + 60), specs)
    rows = {r.algorithm: r for r in table.collect()}
    assert {r.metric for r in rows.values()} == {"f1_macro"} and rows["decision_tree"].score > 0.9 and best.spec.algorithm == "decision_tree"
    with pytest.raises(ValueError, match="roc_auc can't judge"):
        mo.compare(thirds, thirds, specs[:1], "roc_auc")


def test_search_works_in_a_session_that_observes(spark, thirds):
    seen = Observation("rows")
    thirds.observe(seen, F.count(F.lit(1)).alias("n")).count()
    assert seen.get["n"] == 60
    best, table = mo.search(thirds, mo.Spec("classification", "target", ("x",), "decision_tree"), {"maxDepth": [0, 3]}, folds=3)
    scores = {r.params: r for r in table.collect()}
    assert best.spec.params["maxDepth"] == 3 and scores["maxDepth=3"].score > 0.8 > scores["maxDepth=0"].score and scores["maxDepth=3"].folds == 3
    _, once = mo.search(thirds, mo.Spec("regression", "x", ("target",), "linear"), {"regParam": [0.0, 100.0]})
    found = {r.params: r for r in once.collect()}
    assert found["regParam=0.0"].score < found["regParam=100.0"].score and found["regParam=0.0"].folds == 1 and found["regParam=0.0"].sd is None
    assert not math.isnan(found["regParam=0.0"].score)


def test_nothing_is_left_behind(spark, thirds):
    mo.fit(thirds, mo.Spec("classification", "target", ("x",), "logistic", {"maxIter": 2}))
    assert pinned(thirds).count() == 60
    folder = f"{shared_folder(spark)}/marlpit-{spark.sparkContext.applicationId}"
    fs, where = hadoop_path(spark, folder)
    assert fs.exists(where)
    before = {s.getPath().getName() for s in hadoop_path(spark, shared_folder(spark))[0].listStatus(hadoop_path(spark, shared_folder(spark))[1])}
    drop_scratch(spark)
    assert not fs.exists(where)
    after = {s.getPath().getName() for s in hadoop_path(spark, shared_folder(spark))[0].listStatus(hadoop_path(spark, shared_folder(spark))[1])}
    assert before - after == {where.getName()}


def test_features_are_dealt_in_the_order_of_two_hashes(spark):
    """Places of both orders meet across blocks and cells, and a repeat keeps its rows once, however many features there are."""
    rows = spark.range(300_000).select("id", F.col("id").cast("double").alias("x"), (F.col("id") % 7).alias("t"))
    out = mo.dealt(rows, ["x"], "id", 5, ["t"]).toPandas().set_index("x")
    hashes = rows.select("id", portable_hash(F.col("id"), F.lit(5)).alias("a"), portable_hash(F.col("id"), F.lit(6)).alias("b")).toPandas()
    first, second = (hashes.sort_values([c, "id"])["id"].to_numpy() for c in "ab")
    assert len(out) == 300_000 and (out["t"] == out.index % 7).all()
    assert (out.loc[first.astype(float), "_dealt_x"].to_numpy() == second).all()
    few = spark.range(3).select("id", F.col("id").cast("double").alias("x"))
    assert sorted(r["_dealt_x"] for r in mo.dealt(few, ["x"], "id", 5).collect()) == [0.0, 1.0, 2.0]


def test_importance_leaves_no_rows_behind(spark, thirds):
    fitted = mo.fit(thirds.withColumn("z", F.lit(1.0)), mo.Spec("classification", "target", ("x", "z"), "decision_tree"))
    drop_scratch(spark)
    found = {r.feature: r.importance for r in mo.permutation_importance(thirds.withColumn("z", F.lit(1.0)), fitted, "row_id", sample=None, repeats=2).collect()}
    assert found["x"] > 0.2 and found["z"] == 0
    fs, where = hadoop_path(spark, f"{shared_folder(spark)}/marlpit-{spark.sparkContext.applicationId}")
    left = [s.getPath().getName() for s in fs.listStatus(where)]
    assert not any(n.startswith("kept") for n in left) and len(left) == 2  # how the cells of a repeat are dealt


def test_a_forest_for_importances_reads_small_partitions(spark, monkeypatch):
    from marlpit.functions import lineage
    from marlpit.operators import features as fe

    seen, real = [], fe.RandomForestRegressor.fit
    monkeypatch.setattr(lineage, "RANGE_ROWS", 50)
    monkeypatch.setattr(fe.RandomForestRegressor, "fit", lambda self, rows: seen.append((rows.rdd.getNumPartitions(), rows.count())) or real(self, rows))
    df = spark.range(0, 400, 1, 2).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("same"), (F.col("id") * 2).alias("y"))
    found = {r.feature: r.score for r in fe.importance_scores(df, ["x", "same"], "y").collect()}
    assert seen == [(8, 400)] and found["x"] == pytest.approx(1) and found["same"] == 0
    assert lineage.in_small_parts(df.limit(0)).count() == 0 and lineage.in_small_parts(spark.range(0, 40, 1, 3)).rdd.getNumPartitions() == 3


def test_training_tables_hold_what_is_learned(spark):
    """Batch scoring keeps ids, features and target only, of the rows whose keys differ."""
    from conftest import SMALL
    from marlpit.operators.transforms import hash_identifier
    from marlpit.queries.learning import learnable
    from marlpit.queries.registry import read

    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    every = hash_identifier(read(spark, SMALL, "lineitem"), "row_id", keys)
    found = learnable(spark, SMALL, "l_tax", "label")
    assert found.columns == ["row_id", "l_tax", "label"]
    assert sorted(r.row_id for r in found.select("row_id").collect()) == sorted(r.row_id for r in every.select("row_id").distinct().collect())


def test_rows_that_are_alike_are_learned_as_one(spark, monkeypatch):
    """A learner of margins and its calibration see kinds of rows, not rows, and tell the classes apart as before."""
    seen, real = [], mo.LinearSVC.fit
    monkeypatch.setattr(mo.LinearSVC, "fit", lambda self, rows: seen.append(rows.count()) or real(self, rows))
    df = spark.range(400).select("id", (F.col("id") % 2).cast("double").alias("x"), F.when(F.col("id") % 10 < 2, F.col("id") % 3 % 2).otherwise(F.col("id") % 2).alias("t"))
    fitted = mo.fit(df, mo.Spec("classification", "t", ("x",), "linear_svc", {"maxIter": 10}, calibrate=0.3, key="id"))
    assert seen == [4]
    assert mo.predicted(df, fitted).filter("prediction <> cast(cast(x AS int) AS string)").count() == 0


def test_area_under_ranges_of_scores(spark):
    """The area equals that of the ranking, with ties and missing scores, of rows and of rows that stand for several."""
    from marlpit.operators import evaluation as ev

    df = spark.range(500).select(F.when(F.col("id") % 50 != 0, F.col("id") * 7 % 30 / 30.0).alias("s"), F.when(F.col("id") * 13 % 40 < 17, "b").otherwise("a").alias("t"))
    want = ev.ranking(df, "t", "s", "b").first().roc_auc
    assert ev.roc_auc(df, "t", "s", "b").first().roc_auc == pytest.approx(want, abs=1e-12)
    assert ev.roc_auc(df.groupBy("s", "t").agg(F.count("*").alias("n")), "t", "s", "b", "n").first().roc_auc == pytest.approx(want, abs=1e-12)
    assert ev.roc_auc(df.limit(0), "t", "s", "b").first().roc_auc is None


def test_unique_keys_are_told_by_their_hashes(spark, monkeypatch):
    """Keys themselves are counted only where a hash is met twice or a key is null."""
    from marlpit.operators import transforms as tr

    calls, real = [], tr.key_check
    monkeypatch.setattr(tr, "key_check", lambda df, keys: calls.append(1) or real(df, keys))
    df = spark.range(50).select(F.col("id").cast("string").alias("k"))
    tr.assert_unique_key(df, ["k"])
    assert not calls
    with pytest.raises(ValueError, match="0 null, 1 repeated"):
        tr.assert_unique_key(df.union(df.limit(1)), ["k"])
    with pytest.raises(ValueError, match="1 null, 0 repeated"):
        tr.assert_unique_key(df.union(spark.sql("SELECT string(null)")), ["k"])
