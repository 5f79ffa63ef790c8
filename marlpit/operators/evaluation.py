"""Evaluation of predictions. Every function takes keys (``by``): with none it evaluates the whole, with some each group, in the same aggregates.
Where a positive class matters and none is given, it is the last in order of the classes that occur.

Scores meet as counts of equal scores, so ties count as they should; these are placed in range partitions, so no window runs over all rows or all distinct scores.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlpit.functions.ranks import placed, quantiles, with_quantiles
from marlpit.functions.semantics import safe_div

MAX_CLASSES, CURVE_BINS, CALIBRATION_BINS, HISTOGRAM_BINS, QQ_POINTS = 30, 100, 10, 20, 99


def _join(a: DataFrame, b: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys, or pair two one-row frames."""
    return a.join(b, list(by), how) if by else a.crossJoin(F.broadcast(b))  # one row each


def scope(df: DataFrame, actual: str, by: Sequence[str] = ()) -> DataFrame:
    """scanned, evaluated, excluded (no actual value), status."""
    out = df.groupBy(*by).agg(F.count("*").alias("scanned"), F.count(actual).alias("evaluated"))
    return out.withColumn("excluded", F.col("scanned") - F.col("evaluated")).withColumn("status", F.when(F.col("evaluated") == 0, "target_unavailable").otherwise("evaluated"))


def class_report(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """label, support, predicted, hits, precision, recall, f1."""
    rows = df.filter(F.col(actual).isNotNull())
    pairs = rows.groupBy(*by, F.col(actual).cast("string").alias("a"), F.col(predicted).cast("string").alias("p")).agg(F.count("*").alias("n"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("s"), F.lit(0).cast("bigint").alias("q"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("h")),
                              F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("s"), F.col("n").alias("q"), F.lit(0).cast("bigint").alias("h"))))
    per = pairs.select(*by, sides.alias("x")).select(*by, "x.*").filter("label IS NOT NULL").groupBy(*by, "label").agg(F.sum("s").alias("support"), F.sum("q").alias("predicted"), F.sum("h").alias("hits"))
    per = per.withColumn("precision", safe_div(F.col("hits"), F.col("predicted"))).withColumn("recall", safe_div(F.col("hits"), F.col("support")))
    return per.withColumn("f1", safe_div(2 * F.col("hits"), F.col("support") + F.col("predicted")))


def classification_summary(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """evaluated, accuracy, balanced_accuracy, macro_precision, macro_recall, macro_f1, weighted_f1. A class without predictions counts as precision 0."""
    r, met = class_report(df, actual, predicted, by), F.col("support") > 0
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return r.groupBy(*by).agg(
        F.sum("support").alias("evaluated"), safe_div(F.sum("hits"), F.sum("support")).alias("accuracy"), F.avg(F.when(met, F.col("recall"))).alias("balanced_accuracy"),
        F.avg(zero("precision")).alias("macro_precision"), F.avg(zero("recall")).alias("macro_recall"), F.avg(zero("f1")).alias("macro_f1"), safe_div(F.sum(zero("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """actual, predicted, n over the full grid of the MAX_CLASSES classes with most support."""
    rows = df.filter(F.col(actual).isNotNull()).groupBy(F.col(actual).cast("string").alias("actual"), F.col(predicted).cast("string").alias("predicted")).agg(F.count("*").alias("n"))
    labels = class_report(df, actual, predicted).orderBy(F.desc("support"), "label").limit(MAX_CLASSES).select("label")
    grid = labels.select(F.col("label").alias("actual")).crossJoin(F.broadcast(labels.select(F.col("label").alias("predicted"))))  # MAX_CLASSES on either side
    return grid.join(rows, ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def positive_class(df: DataFrame, actual: str, positive: str | None = None) -> str | None:
    """The positive class: the one that is given, or else the last in order of the classes that occur."""
    return positive if positive is not None else df.agg(F.max(actual).cast("string")).first()[0]


def score_groups(df: DataFrame, actual: str, score: str, positive: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """score, pos, neg: rows of each class with that score."""
    hit = F.col(actual).cast("string") == F.lit(positive_class(df, actual, positive))
    rows = df.filter(F.col(actual).isNotNull() & F.col(score).isNotNull())
    return rows.groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.count_if(hit).cast("bigint").alias("pos"), F.count_if(~hit).cast("bigint").alias("neg"))


def ranking(df: DataFrame, actual: str, score: str, positive: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """roc_auc (ties count half) and average_precision."""
    g = score_groups(df, actual, score, positive, by)
    g = placed(g, by, [F.desc("score")], ["pos", "neg"])
    g = g.withColumn("tp", F.col("pos_before") + F.col("pos")).withColumn("fp", F.col("neg_before") + F.col("neg")).withColumn("tp0", F.col("pos_before"))
    return g.groupBy(*by).agg(
        safe_div(F.sum(F.col("neg") * (F.col("tp0") + F.col("pos") / 2)), F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"),
        safe_div(F.sum(F.col("pos") * safe_div(F.col("tp"), F.col("tp") + F.col("fp"))), F.sum("pos")).alias("average_precision"),
    )


def roc_auc(df: DataFrame, actual: str, score: str, positive: str | None = None, count: str | None = None) -> DataFrame:
    """The roc_auc of ranking alone; count: a column with the number of rows that a row stands for. Each range of scores is summed up by itself, as one row, so ranges are neither kept nor ordered again."""

    def areas(batches):  # goes to tasks by value
        import numpy as np
        import pyarrow as pa

        top, before, negatives, area = None, 0, 0, 0.0
        for b in batches:
            if b.num_rows:
                top = b.column(0)[0].as_py() if top is None else top
                pos, neg = b.column(1).to_numpy(), b.column(2).to_numpy()
                area += float(np.dot(neg.astype(float), before + np.cumsum(pos) - pos / 2))
                before, negatives = before + int(pos.sum()), negatives + int(neg.sum())
        if top is not None:
            yield pa.RecordBatch.from_pydict({"top": pa.array([top], pa.float64()), "pos": pa.array([before], pa.int64()), "neg": pa.array([negatives], pa.int64()), "area": pa.array([area], pa.float64())})

    hit, n = F.col(actual).cast("string") == F.lit(positive_class(df, actual, positive)), F.col(count).cast("long") if count else F.lit(1).cast("long")
    given = F.col(score).isNotNull()  # no filter: it would compute the score twice
    sums = [F.coalesce(F.sum(F.when(given & side, n)), F.lit(0).cast("long")).alias(c) for c, side in (("pos", hit), ("neg", ~hit))]
    g = df.groupBy(F.col(score).cast("double").alias("score")).agg(*sums).select("score", "pos", "neg").repartitionByRange(F.desc("score")).sortWithinPartitions(F.desc("score"))
    parts = g.mapInArrow(areas, "top double, pos long, neg long, area double")
    earlier = F.coalesce(F.sum("pos").over(Window.orderBy(F.desc("top")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    parts = parts.withColumn("area", F.col("area") + F.col("neg") * earlier.cast("double"))
    return parts.agg(safe_div(F.sum("area"), F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def curves(df: DataFrame, actual: str, score: str, positive: str | None = None) -> DataFrame:
    """Up to CURVE_BINS points of the ROC and precision-recall curves: bin, threshold, tpr, fpr, precision."""
    g = score_groups(df, actual, score, positive)
    g = placed(g.withColumn("n", F.col("pos") + F.col("neg")), [], [F.desc("score")], ["n"])
    g = g.withColumn("bin", F.ceil((F.col("n_before") + F.col("n")) * CURVE_BINS / F.col("n_all")).cast("int"))
    b = g.groupBy("bin").agg(F.min("score").alias("threshold"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    whole, w = Window.partitionBy(), Window.orderBy("bin")  # CURVE_BINS rows
    tp, fp = F.sum("pos").over(w), F.sum("neg").over(w)
    return b.select("bin", "threshold", safe_div(tp, F.sum("pos").over(whole)).alias("tpr"), safe_div(fp, F.sum("neg").over(whole)).alias("fpr"), safe_div(tp, tp + fp).alias("precision"))


def probability_losses(df: DataFrame, actual: str, score: str, positive: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """brier, log_loss (probabilities kept 1e-15 from the ends)."""
    rows = df.filter(F.col(actual).isNotNull() & F.col(score).isNotNull())
    y, p = F.when(F.col(actual).cast("string") == F.lit(positive_class(df, actual, positive)), 1.0).otherwise(0.0), F.col(score).cast("double")
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    return rows.groupBy(*by).agg(F.avg((p - y) ** 2).alias("brier"), F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"))


def calibration(df: DataFrame, actual: str, score: str, positive: str | None = None) -> DataFrame:
    """bin of ten, n, mean_score, rate."""
    rows = df.filter(F.col(actual).isNotNull() & F.col(score).isNotNull())
    at = F.least(F.lit(CALIBRATION_BINS - 1), F.floor(F.col(score) * CALIBRATION_BINS)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.when(F.col(actual).cast("string") == F.lit(positive_class(df, actual, positive)), 1.0).otherwise(0.0)).alias("rate"))


def score_histogram(df: DataFrame, actual: str, score: str) -> DataFrame:
    """actual, bin of twenty, n."""
    at = F.least(F.lit(HISTOGRAM_BINS - 1), F.floor(F.col(score) * HISTOGRAM_BINS)).cast("int")
    return df.filter(F.col(actual).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(actual).cast("string").alias("actual"), at.alias("bin")).agg(F.count("*").alias("n"))


def regression_summary(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """evaluated, mae, rmse, r2, mean_residual, mape (rows with actual 0 left out), residual_sd, p05, p50, p95. One aggregate, and exact quantiles by range partitions."""
    rows = df.select(*by, F.col(actual).cast("double").alias("a"), F.col(predicted).cast("double").alias("p")).filter("a IS NOT NULL AND p IS NOT NULL")
    r = F.col("a") - F.col("p")
    out = rows.groupBy(*by).agg(
        F.count("*").alias("evaluated"), F.avg(F.abs(r)).alias("mae"), F.sqrt(F.avg(r * r)).alias("rmse"), (1 - safe_div(F.sum(r * r), F.var_pop("a") * F.count("a"))).alias("r2"), F.avg(r).alias("mean_residual"),
        F.avg(F.when(F.col("a") != 0, F.abs(r / F.nullif("a", F.lit(0.0))))).alias("mape"), F.stddev_samp(r).alias("residual_sd"),
    )
    return with_quantiles(out, rows.select(*by, r.alias("r")), by, "r", {"p05": 0.05, "p50": 0.5, "p95": 0.95})


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.select((F.col(actual).cast("double") - F.col(predicted).cast("double")).alias("residual")).filter("residual IS NOT NULL")


def residual_histogram(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    from marlpit.operators.profile import histogram

    return histogram(residuals(df, actual, predicted), "residual", HISTOGRAM_BINS)


def qq_points(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """p (1 to 99 hundredths), residual (its exact quantile), normal (of the standard normal)."""
    probs = [i / (QQ_POINTS + 1) for i in range(1, QQ_POINTS + 1)]
    q = quantiles(residuals(df, actual, predicted), [], "residual", probs)
    normal = F.array(*[F.lit(NormalDist().inv_cdf(p)) for p in probs])
    return q.filter("q IS NOT NULL").select(F.posexplode(F.arrays_zip(F.col("q").alias("residual"), normal.alias("normal"))).alias("i", "z")).select((F.col("i") + 1).alias("p"), F.col("z.residual"), F.col("z.normal"))


def fold_summary(scores: DataFrame, metric: str, weight: str) -> DataFrame:
    """One row over folds: mean, weighted_mean, sd, minimum, maximum, folds."""
    m = F.col(metric)
    return scores.agg(F.avg(m).alias("mean"), safe_div(F.sum(m * F.col(weight)), F.sum(weight)).alias("weighted_mean"), F.stddev_samp(m).alias("sd"), F.min(m).alias("minimum"), F.max(m).alias("maximum"), F.count("*").alias("folds"))


def selection_frequency(selected: DataFrame, feature: str = "feature", fold: str = "cv_fold") -> DataFrame:
    """feature, folds, share: in how many folds each feature was chosen."""
    total = selected.agg(F.count_distinct(fold).alias("all"))
    per = selected.groupBy(feature).agg(F.count_distinct(fold).alias("folds"))
    return per.crossJoin(F.broadcast(total)).select(feature, "folds", (F.col("folds") / F.col("all")).alias("share"))  # one row


def join_actuals(predictions: DataFrame, actuals: DataFrame, key: str, entity: str, target: str) -> tuple[DataFrame, DataFrame]:
    """(predictions with their actual value, one row of diagnostics: predictions, actuals, matched, unmatched_predictions, unmatched_actuals)."""
    from marlpit.operators.transforms import assert_unique_key

    assert_unique_key(predictions, [key])
    assert_unique_key(actuals, [entity])
    truth = actuals.select(F.col(entity).cast("string").alias("_e"), F.col(target).alias("actual"))
    joined = predictions.join(truth, F.col(key).cast("string") == F.col("_e"), "left")
    counts = joined.agg(F.count("*").alias("predictions"), F.count("_e").alias("matched"))
    both = counts.crossJoin(F.broadcast(actuals.agg(F.count("*").alias("actuals"))))  # one row each
    both = both.withColumn("unmatched_predictions", F.col("predictions") - F.col("matched")).withColumn("unmatched_actuals", F.col("actuals") - F.col("matched"))
    return joined.drop("_e"), both


def by_keys(parts: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Reports of the same groups side by side."""
    if not by:
        return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # one row each
    out = parts[0]
    for n, p in enumerate(parts[1:]):
        renamed = p.select(*[F.col(k).alias(f"_k{n}_{k}") for k in by], *[c for c in p.columns if c not in by])
        on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{n}_{k}")) for k in by])
        out = out.join(renamed, on, "left").drop(*[f"_k{n}_{k}" for k in by])
    return out
