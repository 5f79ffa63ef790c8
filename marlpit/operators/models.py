"""Training, search and batch scoring with Spark ML.

Classes are the distinct values of the target in order, as text. Learners that tell only two classes apart (boosting, linear SVC) learn one class against the rest, once for each class, where
there are more. Class weights come from the counts of all training rows. Every candidate of a search or comparison is judged by one metric over its scored rows.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, field, replace
from itertools import product
from typing import Any

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    GeneralizedLinearRegression,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.functions.lineage import kept, part_count, pinned, scratch_path
from marlpit.functions.ranks import with_quantiles
from marlpit.functions.semantics import orders, portable_hash
from marlpit.operators import evaluation as ev
from marlpit.operators.splits import unit_hash
from marlpit.operators.transforms import assert_unique_key, hash_sample

FEATURES, LABEL, WEIGHT, KEY, LATER, COUNT = "_features", "_label", "_weight", "_key", "_later", "_count"
CLASSIFIERS = {
    "logistic": LogisticRegression, "linear_svc": LinearSVC, "decision_tree": DecisionTreeClassifier, "random_forest": RandomForestClassifier,
    "gradient_boosting": GBTClassifier, "naive_bayes": NaiveBayes, "mlp": MultilayerPerceptronClassifier,
}
REGRESSORS = {"linear": LinearRegression, "glm": GeneralizedLinearRegression, "decision_tree": DecisionTreeRegressor, "random_forest": RandomForestRegressor, "gradient_boosting": GBTRegressor}
TWO_CLASSES = {"linear_svc", "gradient_boosting"}
#: Learners that read their input at every iteration; the others keep what they need of it themselves, as blocks or bins.
REREAD = {"glm"}
#: Learners for which rows that are alike may stand as one row with their number as its weight, as they sum over rows only: in a search, where many are learned from the same rows, and always (hinge loss
#: has kinks, around which a line search tries hundreds of points, each a pass over the rows). FEW: kinds of rows for each row at most; EVEN: share of the squares of weights at most where there is a penalty, for the
#: standard deviations by which features are scaled take them for single rows.
SUMMED, OFTEN, FEW, EVEN = {"logistic", "linear_svc", "linear", "glm"}, {"linear_svc"}, 0.25, 1e-5
#: Classes of a target at most; a target with more is taken for a mistake.
MAX_CLASSES = 1000
CALIBRATION_SEED = 11
#: First bits of a hash by which rows are counted to deal them to blocks, and blocks for each partition, so that hashed blocks fill partitions evenly.
HASH_BITS, BLOCKS_A_PART = 16, 4
#: Column of evaluation's summaries for each metric.
CLASS_METRICS = {"accuracy": "accuracy", "balanced_accuracy": "balanced_accuracy", "f1_macro": "macro_f1", "f1_weighted": "weighted_f1"}
NUMBER_METRICS = {"rmse": "rmse", "mae": "mae", "r2": "r2"}


@dataclass(frozen=True)
class Spec:
    """What is learned from what: task is classification or regression.

    class_weight: "balanced" (rows / (classes * rows of the class)) or a weight for each class. weight: a column of row weights.
    calibrate: share of the training rows, chosen by a hash of key, on whose margins the probabilities of a learner that gives only margins (linear_svc) are fitted; without it such a model has none.
    """

    task: str
    target: str
    features: tuple[str, ...]
    algorithm: str
    params: Mapping[str, Any] = field(default_factory=dict)
    class_weight: str | Mapping[str, float] | None = None
    weight: str | None = None
    calibrate: float = 0.0
    key: str | None = None


@dataclass(frozen=True)
class Fitted:
    """A model with its score contract: classes in the order of the probabilities, what each weighed, and one learned model, or one for each class against the rest.
    calibration: slope and intercept of the log odds over the margin of each model."""

    spec: Spec
    models: tuple[Model, ...]
    classes: tuple[str, ...] = ()
    class_weights: Mapping[str, float] = field(default_factory=dict)
    calibration: tuple[tuple[float, float], ...] = ()

    @property
    def one_against_rest(self) -> bool:
        return len(self.models) > 1

    @property
    def has_probabilities(self) -> bool:
        return bool(self.calibration) or (self.spec.task == "classification" and self.models[0].hasParam("probabilityCol"))


def class_counts(df: DataFrame, target: str) -> dict[str, int]:
    """Rows of each class in order of the classes; the counts are those of all rows, and only they reach the driver."""
    counted = df.filter(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("c")).agg(F.count("*").alias("n"))
    found = counted.orderBy("c").limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{target} has more than {MAX_CLASSES} classes")
    return {r["c"]: r["n"] for r in found}


def resolved_weights(spec: Spec, counts: Mapping[str, int]) -> dict[str, float]:
    if spec.class_weight is None:
        return {}
    if spec.class_weight == "balanced":
        if len(counts) < 2:
            raise ValueError("balanced class weights need at least two classes")
        total = sum(counts.values())
        return {c: total / (len(counts) * n) for c, n in counts.items()}
    missing = [c for c in counts if c not in spec.class_weight]
    if missing:
        raise ValueError(f"no weight for the classes {missing}")
    return {c: float(spec.class_weight[c]) for c in counts}


def learner(spec: Spec, place: int = 0, weighted: bool = False) -> Estimator:
    kind = (CLASSIFIERS if spec.task == "classification" else REGRESSORS)[spec.algorithm]
    given = dict(spec.params)
    names = {p.name for p in kind().params}
    if "seed" in names:
        given.setdefault("seed", 42)
    if weighted or spec.weight or spec.class_weight:
        if "weightCol" not in names:
            raise ValueError(f"{spec.algorithm} takes no weights")
        given["weightCol"] = WEIGHT
    out = kind(featuresCol=FEATURES, labelCol=LABEL, **given)
    for c in names & {"predictionCol", "rawPredictionCol", "probabilityCol"}:
        out.set(out.getParam(c), f"_{c}_{place}")  # boosting doesn't take all of them as arguments
    return out


def class_place(target: str, classes: Sequence[str]) -> Column:
    """The place of a row's class, from 0; -1 for others."""
    return (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(target).cast("string")) - 1).cast("double")


def training_rows(df: DataFrame, spec: Spec, counts: Mapping[str, int] | None = None) -> tuple[DataFrame, tuple[str, ...], dict[str, float]]:
    """(features, label, weight, number of rows that a row stands for and, to calibrate, whether a row is left for that, of the rows with a target; classes; class weights). counts: rows of each class, if they are known."""
    df, classes, weights = df.filter(F.col(spec.target).isNotNull()), (), {}
    count = F.col(COUNT) if COUNT in df.columns else F.lit(1.0)
    weight = count * F.col(spec.weight).cast("double") if spec.weight else count
    if spec.task == "classification":
        counts = class_counts(df, spec.target) if counts is None else counts
        classes, weights = tuple(counts), resolved_weights(spec, counts)
        label = class_place(spec.target, classes)
        if weights:
            weight = weight * F.get(F.array(*[F.lit(weights[c]) for c in classes]), label.cast("int"))
    else:
        label = F.col(spec.target).cast("double")
    later = [(unit_hash(F.col(spec.key), CALIBRATION_SEED) < spec.calibrate).alias(LATER)] if spec.calibrate else []
    return df.select(*dict.fromkeys(spec.features), label.alias(LABEL), weight.alias(WEIGHT), count.alias(COUNT), *later), classes, weights


def with_features(df: DataFrame, spec: Spec) -> DataFrame:
    return VectorAssembler(inputCols=list(spec.features), outputCol=FEATURES, handleInvalid="error").transform(df)


def without_summary(model: Model, df: DataFrame) -> Model:
    """The model as it comes back from a saved file: without the summary of its training, which holds the session and the training rows and would go to every task that scores."""
    if not getattr(model, "hasSummary", False):
        return model
    path = scratch_path(df.sparkSession, "model")
    model.save(path)
    return type(model).load(path)


def margin(spec: Spec, place: int) -> Column:
    """What speaks for the second class of a model of two."""
    return F.get(vector_to_array(f"_rawPredictionCol_{place}"), F.lit(1))


def alike(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The kinds of rows, with the number of rows (COUNT) of each."""
    return rows.groupBy(*columns).agg(F.count("*").cast("double").alias(COUNT))


def has_few_kinds(rows: DataFrame, columns: Sequence[str]) -> bool:
    found = rows.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64(*columns)).alias("kinds")).first()
    return found.n > 0 and found.kinds <= FEW * found.n


def calibrated(rows: DataFrame, spec: Spec, models: Sequence[Model], classes: Sequence[str]) -> tuple[tuple[float, float], ...]:
    """Slope and intercept of the log odds over the margins of rows that the models haven't seen."""
    out = []
    for i, model in enumerate(models):
        hit = (F.col(LABEL) == (i if len(models) > 1 else 1)).cast("double")
        pairs = model.transform(rows).select(array_to_vector(F.array(margin(spec, i))).alias("m"), hit.alias("y"), COUNT)
        odds = LogisticRegression(featuresCol="m", labelCol="y", weightCol=COUNT, tol=1e-9).fit(pairs)
        out.append((float(odds.coefficients[0]), float(odds.intercept)))
    return tuple(out)


def fit(df: DataFrame, spec: Spec, counts: Mapping[str, int] | None = None) -> Fitted:
    """df is read a few times, so what is costly to compute should be pinned. Rows are kept, as a table of what is learned from, where several models or each iteration read them."""
    if spec.calibrate and (spec.algorithm != "linear_svc" or not spec.key):
        raise ValueError("calibrate is for linear_svc and needs a key")
    rows, classes, weights = training_rows(df, spec, counts)
    merged = COUNT in df.columns
    if not merged and spec.algorithm in OFTEN and not spec.params.get("regParam"):
        kind = [*dict.fromkeys(spec.features), LABEL, WEIGHT, *([LATER] if spec.calibrate else [])]
        merged = has_few_kinds(rows.drop(LATER), kind[: len(kind) - bool(spec.calibrate)])
        rows = alike(rows, kind).withColumn(WEIGHT, F.col(WEIGHT) * F.col(COUNT)) if merged else rows
    each_class = spec.task == "classification" and spec.algorithm in TWO_CLASSES and len(classes) > 2
    with kept(rows) if each_class or spec.calibrate or spec.algorithm in REREAD or (merged and COUNT not in df.columns) else nullcontext(rows) as rows:
        rows = with_features(rows, spec).drop(*spec.features)
        seen = rows.filter(~F.col(LATER)) if spec.calibrate else rows
        if each_class:
            each = [learner(spec, i, merged).fit(seen.withColumn(LABEL, (F.col(LABEL) == i).cast("double"))) for i in range(len(classes))]
        else:
            each = [learner(spec, 0, merged).fit(seen)]
        models = tuple(without_summary(m, rows) for m in each)
        calibration = calibrated(rows.filter(LATER), spec, models, classes) if spec.calibrate else ()
    return Fitted(spec, models, classes, weights, calibration)


def by_class(fitted: Fitted) -> Column:
    """An array with what each class scores: probabilities that sum to 1, or margins of a learner that gives only these."""
    spec, places = fitted.spec, range(len(fitted.models))
    if fitted.calibration:
        shares = [1 / (1 + F.exp(-(margin(spec, i) * a + b))) for i, (a, b) in zip(places, fitted.calibration, strict=True)]
        each = F.array(*shares) if fitted.one_against_rest else F.array(1 - shares[0], shares[0])
    elif fitted.one_against_rest:
        each = F.array(*[F.get(vector_to_array(f"_probabilityCol_{i}"), F.lit(1)) if fitted.has_probabilities else margin(spec, i) for i in places])
    else:
        return vector_to_array("_probabilityCol_0" if fitted.has_probabilities else "_rawPredictionCol_0")
    if not (fitted.one_against_rest and fitted.has_probabilities):
        return each
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(each, lambda x: x / total)).otherwise(F.array_repeat(F.lit(1.0 / len(fitted.classes)), len(fitted.classes)))


def predicted(df: DataFrame, fitted: Fitted) -> DataFrame:
    """df with prediction, prediction_score and, of models that give probabilities, _shares (an array by class)."""
    out, spec = with_features(df, fitted.spec), fitted.spec
    for model in fitted.models:
        out = model.transform(out)
    made = [FEATURES, *[f"_{c}_{i}" for i in range(len(fitted.models)) for c in ("predictionCol", "rawPredictionCol", "probabilityCol")]]
    if spec.task == "regression":
        return out.withColumn("prediction", F.col("_predictionCol_0")).withColumn("prediction_score", F.col("prediction")).drop(*made)
    out = out.withColumn("_shares", by_class(fitted))
    place = F.array_position("_shares", F.array_max("_shares")) - 1
    names = F.array(*[F.lit(c) for c in fitted.classes])
    score = F.get("_shares", F.lit(1)) if len(fitted.classes) == 2 else F.array_max("_shares")
    out = out.withColumn("prediction", F.get(names, place.cast("int"))).withColumn("prediction_score", score)
    return out.drop(*made, *([] if fitted.has_probabilities else ["_shares"]))


def score(df: DataFrame, fitted: Fitted, row_id: str, keep: Sequence[str] = ()) -> DataFrame:
    """row_id, prediction, prediction_score, probability_<class> ... and the columns to keep. The row id must be given and unique.

    prediction_score is that of the second of two classes, or else of the predicted one. A model that gives only margins has no probability columns, and its score is a margin."""
    assert_unique_key(df, [row_id])
    names = [*fitted.spec.features, row_id, *keep]
    out = predicted(df.select(*dict.fromkeys(names)), fitted)
    each = [F.get("_shares", F.lit(i)).alias(f"probability_{c}") for i, c in enumerate(fitted.classes)] if fitted.has_probabilities else []
    return out.select(row_id, "prediction", "prediction_score", *each, *keep)


def baseline(df: DataFrame, target: str, task: str) -> DataFrame:
    """One row: the constant that a model must beat. prediction and share of the most frequent class, or mean and median."""
    if task == "regression":
        return with_quantiles(df.agg(F.avg(target).alias("mean")), df, [], target, {"median": 0.5})
    n = df.filter(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("prediction")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.orderBy(F.desc("n"), "prediction").limit(1).crossJoin(F.broadcast(total)).select("prediction", (F.col("n") / F.col("t")).alias("share"))  # one row


def in_flight(df: DataFrame, actual: str, prediction: str, task: str) -> DataFrame:
    """One row by sums: accuracy, or mae, rmse, r2."""
    if task == "classification":
        return df.agg(F.count("*").alias("n"), F.avg((F.col(actual).cast("string") == F.col(prediction).cast("string")).cast("double")).alias("accuracy"))
    a = F.col(actual).cast("double")
    r = a - F.col(prediction).cast("double")
    return df.agg(F.count("*").alias("n"), F.avg(F.abs(r)).alias("mae"), F.sqrt(F.avg(r * r)).alias("rmse"), (1 - F.try_divide(F.sum(r * r), F.var_pop(a) * F.count(a))).alias("r2"))


def default_metric(task: str, classes: int) -> str:
    """ROC AUC for two classes, macro F1 for more, RMSE for numbers."""
    return "rmse" if task == "regression" else "roc_auc" if classes == 2 else "f1_macro"


def is_better(metric: str, one: float, other: float) -> bool:
    return one < other if metric in ("rmse", "mae") else one > other


def measured(scored: DataFrame, fitted: Fitted, metric: str) -> float:
    """The metric over rows with a target and a prediction; sums and counts only."""
    target = fitted.spec.target
    if metric in CLASS_METRICS:
        found = ev.classification_summary(scored, target, "prediction").first()[CLASS_METRICS[metric]]
    elif metric in NUMBER_METRICS:
        found = ev.regression_summary(scored, target, "prediction").first()[NUMBER_METRICS[metric]]
    elif metric == "roc_auc" and len(fitted.classes) == 2:
        found = ev.roc_auc(scored, target, "prediction_score", fitted.classes[1], COUNT if COUNT in scored.columns else None).first()["roc_auc"]
    else:
        raise ValueError(f"{metric} can't judge {fitted.spec.algorithm} of {len(fitted.classes)} classes")
    return math.nan if found is None else float(found)


def combinations(space: Mapping[str, Sequence[Any]], n: int | None = None, seed: int = 42) -> list[dict[str, Any]]:
    """All combinations of the space, or n of them drawn with a seed."""
    every = [dict(zip(space, values, strict=True)) for values in product(*space.values())]
    return random.Random(seed).sample(every, n) if n is not None and n < len(every) else every


@contextmanager
def judged_rows(df: DataFrame, spec: Spec, fold: str, metric: str | None) -> Iterator[tuple[DataFrame, dict[str, int], str]]:
    """(what candidates are learned from and judged by, of the rows with a target; rows of each class; metric). Kept until the block ends; rows that are alike are one with their number, where that is the same to learner
    and metric and there are many of them."""
    columns = [*dict.fromkeys([*spec.features, spec.target, fold, *[c for c in (spec.weight, spec.key if spec.calibrate else None) if c]])]
    with kept(df.filter(F.col(spec.target).isNotNull()).select(*columns)) as rows:
        counts = class_counts(rows, spec.target) if spec.task == "classification" else {}
        metric = metric or default_metric(spec.task, len(counts))
        if metric == "roc_auc" and spec.algorithm in SUMMED and not spec.calibrate and has_few_kinds(rows, columns):
            with kept(alike(rows, columns)) as kinds:
                if kinds.agg(F.sum(F.col(COUNT) ** 2) / F.sum(COUNT) ** 2).first()[0] <= EVEN:
                    yield kinds, counts, metric
                    return
        yield rows, counts, metric


def fold_scores(df: DataFrame, spec: Spec, space: Mapping[str, Sequence[Any]], fold: str, metric: str | None = None, n: int | None = None, seed: int = 42, only: Sequence[int] | None = None) -> DataFrame:
    """params, cv_fold, evaluated, score of each combination on each fold (or only some), learned from the rows of the others; the metric is the same for all."""
    with judged_rows(df, spec, fold, metric) as (rows, counts, metric):
        return kept_fold_scores(rows, spec, space, fold, counts, metric, n, seed, only)


def kept_fold_scores(rows: DataFrame, spec: Spec, space: Mapping[str, Sequence[Any]], fold: str, counts: Mapping[str, int], metric: str, n: int | None, seed: int, only: Sequence[int] | None) -> DataFrame:
    """fold_scores of judged rows. Classes are counted once, by fold."""
    kind = F.col(spec.target).cast("string") if spec.task == "classification" else F.lit("")
    number = F.sum(COUNT).cast("long") if COUNT in rows.columns else F.count("*")
    met = {(r[fold], r["_c"]): r["n"] for r in rows.groupBy(fold, kind.alias("_c")).agg(number.alias("n")).collect()}  # a row for each fold and class
    sizes, out = {f: sum(k for (g, _), k in met.items() if g == f) for f, _ in met}, []
    for params in combinations(space, n, seed):
        shown = ", ".join(f"{k}={v}" for k, v in sorted(params.items()))
        for f in sorted(sizes if only is None else only):
            others = {c: sum(k for (g, d), k in met.items() if g not in (f, None) and d == c) for c in counts}
            fitted = fit(rows.filter(F.col(fold) != f), replace(spec, params={**spec.params, **params}), {c: k for c, k in others.items() if k})
            out.append((shown, f, sizes[f], measured(predicted(rows.filter(F.col(fold) == f), fitted), fitted, metric)))
    return rows.sparkSession.createDataFrame(out, "params string, cv_fold int, evaluated long, score double")


def search(
    df: DataFrame, spec: Spec, space: Mapping[str, Sequence[Any]], folds: int | str | None = None, n: int | None = None, seed: int = 42, metric: str | None = None
) -> tuple[Fitted, DataFrame]:
    """(best model fitted on all rows; params, score (mean over folds), sd and folds of each candidate). folds: a number, a fold column (0, 1 ...), or None for one holdout of a fifth.
    Without a column rows are dealt by a hash of features and target, so equal rows share a fold."""
    dealt, only = folds, None
    if not isinstance(folds, str):
        dealt, only = "_fold", None if folds else [0]
        df = df.withColumn(dealt, F.pmod(F.xxhash64(F.lit(seed), *spec.features, spec.target), F.lit(folds or 5)).cast("int"))
    with judged_rows(df, spec, dealt, metric) as (rows, counts, metric):
        scores = kept_fold_scores(rows, spec, space, dealt, counts, metric, n, seed, only)
        table = scores.groupBy("params").agg(F.avg("score").alias("score"), F.stddev("score").alias("sd"), F.count("*").alias("folds"))
        means = {r["params"]: r["score"] for r in table.collect()}  # a row for each candidate
        best = None
        for params in combinations(space, n, seed):
            mean = means[", ".join(f"{k}={v}" for k, v in sorted(params.items()))]
            if best is None or is_better(metric, mean, best[0]):
                best = (mean, params)
        return fit(rows, replace(spec, params={**spec.params, **best[1]}), counts), table


def compare(train: DataFrame, holdout: DataFrame, specs: Sequence[Spec], metric: str | None = None) -> tuple[Fitted, DataFrame]:
    """(the best of several algorithms, fitted again on all rows; algorithm, metric and score of each on the holdout). One metric judges all."""
    scores, best = [], None
    for i, spec in enumerate(specs):
        fitted = fit(train, spec)
        metric = metric or default_metric(spec.task, len(fitted.classes))
        found = measured(predicted(holdout.filter(F.col(spec.target).isNotNull()), fitted), fitted, metric)
        scores.append((spec.algorithm, metric, found))
        if best is None or is_better(metric, found, scores[best][2]):
            best = i
    return fit(train.unionByName(holdout), specs[best]), train.sparkSession.createDataFrame(scores, "algorithm string, metric string, score double")


def in_blocks(rows: DataFrame, key: str, seed: int, columns: Sequence[str]) -> DataFrame:
    """The rows twice, in the order of one hash of key (_side 0) and of another (_side 1), with their place in it (_n), dealt to blocks so that a place is in the same block on both sides.

    Hashes are even, so counts of rows by their first HASH_BITS bits tell where a block ends. A cell of the second order that lies across the end of a block goes to both."""
    spark, sides = rows.sparkSession, []
    cell = F.shiftright("_h", 60 - HASH_BITS).cast("int").alias("_cell")
    for i in (0, 1):
        sides.append(rows.select(F.lit(i).alias("_side"), portable_hash(F.col(key), F.lit(seed + i)).alias("_h"), F.col(key).alias(KEY), *columns).withColumn("_cell", cell))
    before = Window.partitionBy("_side").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # counts of 2^HASH_BITS cells at most
    counts = sides[0].select("_side", "_cell").unionByName(sides[1].select("_side", "_cell")).groupBy("_side", "_cell").agg(F.count("*").alias("_count"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_count").over(before), F.lit(0)))
    with kept(starts) as starts:
        total = starts.filter("_side = 0").agg(F.coalesce(F.sum("_count"), F.lit(0))).first()[0]
        n = part_count(spark, total)
        size = max(1, -(-total // (n * BLOCKS_A_PART)))
        first = starts.filter("_side = 0").withColumn("_block", F.floor(F.col("_start") / size).cast("int"))
        spans = first.groupBy("_block").agg(F.min("_start").alias("_lo"), F.max(F.col("_start") + F.col("_count")).alias("_hi"))
        second = starts.filter("_side = 1").join(F.broadcast(spans), (F.col("_start") < F.col("_hi")) & (F.col("_start") + F.col("_count") > F.col("_lo")))  # a row for each block
        dealt = first.select("_side", "_cell", "_block", "_start").unionByName(second.select("_side", "_cell", "_block", "_start"))
        dealt = pinned(dealt.withColumn("_base", F.min("_start").over(Window.partitionBy("_side", "_block"))).drop("_start"))
    both = sides[0].unionByName(sides[1]).join(F.broadcast(dealt), ["_side", "_cell"]).drop("_cell")  # a row for each cell, and for each block more
    inside = Window.partitionBy("_block", "_side").orderBy(*orders(["_h", KEY]))
    return both.repartition(n, "_block").withColumn("_n", F.col("_base") + F.row_number().over(inside)).drop("_h", KEY, "_base")


def dealt(rows: DataFrame, columns: Sequence[str], key: str, seed: int, keep: Sequence[str] = ()) -> DataFrame:
    """columns and keep of each row, and as _dealt_<column> the columns of the row that it is dealt, by pairing the order of one hash of key with that of another. Rows are moved once."""
    both = in_blocks(rows, key, seed, list(dict.fromkeys([*columns, *keep])))
    pair = Window.partitionBy("_block").orderBy("_n", "_side")  # the row of the second order comes right after that of the first
    both = both.withColumns({f"_dealt_{c}": F.lead(c).over(pair) for c in columns})
    return both.filter("_side = 0").drop("_block", "_side", "_n")


def permutation_importance(df: DataFrame, fitted: Fitted, key: str, sample: int | None = 256, repeats: int = 3, seed: int = 7, metric: str | None = None) -> DataFrame:
    """feature, importance: how much the score falls when the feature is shuffled. sample=None takes all rows.

    All features are dealt alike in a repeat, so rows are ordered once for each repeat; they are kept only while its features are judged."""
    rows = (hash_sample(df, key, seed, sample) if sample else df).filter(F.col(fitted.spec.target).isNotNull())
    features, target = fitted.spec.features, fitted.spec.target
    metric = metric or default_metric(fitted.spec.task, len(fitted.classes))
    sign = -1 if metric in ("rmse", "mae") else 1
    whole = measured(predicted(rows, fitted), fitted, metric)
    drops: dict[str, list[float]] = {c: [] for c in features}
    for r in range(repeats):
        with kept(dealt(rows, features, key, seed + 10 * r, [target])) as pairs:
            for c in features:
                other = pairs.withColumn(c, F.col(f"_dealt_{c}")).select(*features, target)
                drops[c].append(sign * (whole - measured(predicted(other, fitted), fitted, metric)))
    out = [(c, float(sum(d) / repeats)) for c, d in drops.items()]
    return df.sparkSession.createDataFrame(out, "feature string, importance double")


def replay(log: DataFrame, payload: str, schema: str, fitted: Fitted, since: str, until: str, roles: Sequence[str] = ("champion", "fallback")) -> DataFrame:
    """Logged requests of a window scored again with another model: request_id, record_id, prediction, prediction_score."""
    some = log.filter(F.col("role").isin(list(roles)) & (F.col("scored_at") >= F.lit(since).cast("timestamp")) & (F.col("scored_at") < F.lit(until).cast("timestamp")))
    rows = some.withColumn("_p", F.from_json(payload, schema)).select("request_id", "record_id", "_p.*")
    rows = rows.withColumn("_key", F.concat_ws("|", "request_id", "record_id"))
    return score(rows, fitted, "_key", ["request_id", "record_id"]).drop("_key")
