"""Reports over logged predictions joined with later actual values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.functions.ranks import with_quantiles
from marlpit.functions.semantics import safe_div
from marlpit.operators import evaluation as ev
from marlpit.operators.transforms import assert_unique_key, key_check

GRAINS = ("hour", "day", "week", "month")


def label_join_kind(actuals: Sequence[str]) -> str:
    """Which key the columns of actuals allow: prediction_id, request_record_id or record_id."""
    if "prediction_id" in actuals:
        return "prediction_id"
    if {"request_id", "record_id"} <= set(actuals):
        return "request_record_id"
    if "record_id" in actuals:
        return "record_id"
    raise ValueError("actuals have none of prediction_id, (request_id, record_id), record_id")


def join_labels(executions: DataFrame, actuals: DataFrame, target: str, kind: str | None = None) -> DataFrame:
    """All executions with actual, the value of the record that they were about. By prediction_id actuals meet the served execution, whose
    (request, record) hands them on to the others; by record_id alone a record served twice is refused."""
    kind = kind or label_join_kind(actuals.columns)
    served = executions.filter("served")
    if kind == "prediction_id":
        assert_unique_key(actuals, ["prediction_id"])
        hit = served.select("prediction_id", "request_id", "record_id").join(actuals.select("prediction_id", F.col(target).alias("actual")), "prediction_id")
        return executions.join(hit.select("request_id", "record_id", "actual"), ["request_id", "record_id"], "left")
    keys = ["request_id", "record_id"] if kind == "request_record_id" else ["record_id"]
    assert_unique_key(actuals, keys)
    if kind == "record_id":
        twice = key_check(served, ["record_id"]).first().duplicate_keys
        if twice:
            raise ValueError(f"{twice} records were served more than once; join them by prediction or request")
    return executions.join(actuals.select(*keys, F.col(target).alias("actual")), keys, "left")


def coverage(joined: DataFrame, actuals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: executions, served, labelled (served ones with an actual), coverage, unmatched_actuals."""
    own = joined.agg(F.count("*").alias("executions"), F.count_if("served").alias("served"), F.count_if(F.col("served") & F.col("actual").isNotNull()).alias("labelled"))
    stray = actuals.join(joined.select(*keys).distinct(), list(keys), "left_anti").agg(F.count("*").alias("unmatched_actuals"))
    return own.withColumn("coverage", safe_div(F.col("labelled"), F.col("served"))).crossJoin(F.broadcast(stray))  # one row each


def feature_value(payload: str, name: str) -> Column:
    """A feature of a JSON payload; names may hold dots."""
    return F.get_json_object(F.col(payload), "$['" + name.replace("'", "\\'") + "']")


def numeric_drift(df: DataFrame, payload: str, baseline: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """feature, rows, missing, valid, mean, minimum, maximum, out_of_range, mean_shift (over the baseline's range); all features in one aggregate.
    baseline: name -> {mean, minimum, maximum}."""
    cells = []
    for name, b in baseline.items():
        x = feature_value(payload, name).try_cast("double")
        shift = safe_div(F.abs(F.avg(x) - F.lit(b["mean"])), F.lit(b["maximum"] - b["minimum"]))
        outside = (x < F.lit(b["minimum"])) | (x > F.lit(b["maximum"]))
        cells.append(F.struct(F.lit(name).alias("feature"), F.count("*").alias("rows"), F.count_if(x.isNull()).alias("missing"), F.count(x).alias("valid"), F.avg(x).alias("mean"), F.min(x).alias("minimum"), F.max(x).alias("maximum"), F.count_if(outside).alias("out_of_range"), shift.alias("mean_shift")))
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def categorical_inputs(df: DataFrame, values: Mapping[str, Column], top: int = 20) -> DataFrame:
    """feature, value, n, share, missing: the most frequent values of each feature, from one count over (feature, value)."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), c.cast("string").alias("value")) for k, c in values.items()]))
    n = df.select(cells.alias("p")).select("p.*").groupBy("feature", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("feature")
    n = n.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("missing", F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))).over(w), F.lit(0)))
    return n.filter("value IS NOT NULL").withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), "value"))).filter(F.col("place") <= top).drop("place")


def prediction_classes(df: DataFrame, prediction: str, top: int = 100) -> DataFrame:
    """prediction, n, share; classes beyond the first are folded into __other__."""
    n = df.groupBy(F.col(prediction).cast("string").alias("prediction")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "prediction"))  # over the classes
    folded = n.withColumn("prediction", F.when(place <= top, F.col("prediction")).otherwise("__other__")).groupBy("prediction").agg(F.sum("n").alias("n"))
    return folded.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def prediction_numbers(df: DataFrame, prediction: str, bins: int = 20) -> tuple[DataFrame, DataFrame]:
    """(one row: n, mean, sd, minimum, median, maximum; a histogram)."""
    from marlpit.operators.profile import histogram

    x = F.col(prediction).try_cast("double")
    rows = df.select(x.alias("x")).filter("x IS NOT NULL")
    summary = rows.agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("minimum"), F.max("x").alias("maximum"))
    return with_quantiles(summary, rows, [], "x", {"median": 0.5}), histogram(rows, "x", bins)


def calendar(spark, since: str, until: str, grain: str) -> DataFrame:
    """bucket: every start of an hour, day, week or month that the window [since, until) touches."""
    start = F.date_trunc(grain, F.lit(since).cast("timestamp"))
    last = F.date_trunc(grain, F.lit(until).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND"))
    return spark.range(1).select(F.explode(F.sequence(start, last, F.expr(f"INTERVAL 1 {grain.upper()}"))).alias("bucket"))


def request_health(log: DataFrame, since: str, until: str, grain: str = "hour") -> DataFrame:
    """Per bucket, empty ones too: requests (each once), succeeded, failed, fallbacks, mean_latency, p95_latency, max_latency, executions, served."""
    window = log.filter((F.col("scored_at") >= F.lit(since).cast("timestamp")) & (F.col("scored_at") < F.lit(until).cast("timestamp"))).withColumn("bucket", F.date_trunc(grain, F.col("scored_at")))
    requests = window.groupBy("request_id").agg(*[F.min_by(c, F.struct("scored_at", "record_id", "model_id")).alias(c) for c in ("bucket", "request_status", "fallback_used", "request_latency_ms")])
    ok = F.col("request_status") == "succeeded"
    per = requests.groupBy("bucket").agg(
        F.count("*").alias("requests"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.count_if("fallback_used").alias("fallbacks"),
        F.avg("request_latency_ms").alias("mean_latency"), F.max("request_latency_ms").alias("max_latency"),
    )
    per = with_quantiles(per, requests, ["bucket"], "request_latency_ms", {"p95_latency": 0.95})
    runs = window.groupBy("bucket").agg(F.count("*").alias("executions"), F.count_if("served").alias("served"))
    out = calendar(log.sparkSession, since, until, grain).join(per, "bucket", "left").join(runs, "bucket", "left")
    return out.fillna(0, ["requests", "succeeded", "failed", "fallbacks", "executions", "served"])


def service_health(requests: DataFrame) -> DataFrame:
    """One row: total, succeeded, failed, fallbacks, mean, max, p50, p95, p99 of the latency."""
    ok = F.col("request_status") == "succeeded"
    totals = requests.agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.count_if("fallback_used").alias("fallbacks"), F.avg("request_latency_ms").alias("mean_latency"), F.max("request_latency_ms").alias("max_latency"))
    return with_quantiles(totals, requests, [], "request_latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def error_codes(requests: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent error codes of failed requests."""
    failed = requests.filter(F.col("request_status") != "succeeded")
    return failed.groupBy("error_code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("error_code").asc_nulls_last()).limit(top)


def regression_over(joined: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: evaluated, mae, rmse, r2, mean_residual."""
    return ev.regression_summary(joined, "actual", "prediction_value", by).select(*by, "evaluated", "mae", "rmse", "r2", "mean_residual")


def classification_over(joined: DataFrame, positive: str | None, by: Sequence[str]) -> DataFrame:
    """Per group: the classification summary; with a positive class also roc_auc, average_precision, brier, log_loss."""
    parts = [ev.classification_summary(joined, "actual", "prediction_value", by)]
    if positive is not None:
        parts += [ev.ranking(joined, "actual", "prediction_score", positive, by), ev.probability_losses(joined, "actual", "prediction_score", positive, by)]
    return ev.by_keys(parts, by)


def bucketed(joined: DataFrame, grain: str) -> DataFrame:
    return joined.withColumn("bucket", F.date_trunc(grain, F.col("scored_at")))


def drill_buckets(joined: DataFrame, grain: str, buckets: Sequence[str], positive: str | None = None) -> DataFrame:
    """The evaluation of a few buckets (8 at most)."""
    if len(buckets) > 8:
        raise ValueError("at most 8 buckets")
    some = bucketed(joined, grain).filter(F.col("bucket").isin([F.lit(b).cast("timestamp") for b in buckets]))
    return classification_over(some, positive, ["bucket"])
