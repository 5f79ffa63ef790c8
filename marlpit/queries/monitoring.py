"""Monitoring and streaming over events read as a log of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.operators import evaluation as ev
from marlpit.operators import monitoring as mon
from marlpit.operators.contracts import Expectation
from marlpit.queries.registry import collector, read, rounded
from marlpit.queries.sources import work_folder
from marlpit.streaming import monitor

QUERIES, ORACLE_SQL, register = collector()

#: Two executions for each second event (champion served, challenger not), one for others; every fifth event has no actual value.
_L = """b AS (SELECT *, CAST(event_id AS VARCHAR) AS request_id, CAST(user_id AS VARCHAR) || '-' || CAST(event_id AS VARCHAR) AS record_id, ts AS scored_at, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS request_status, user_id % 11 = 0 AS fallback_used, CAST(floor(value * 3) AS INTEGER) AS request_latency_ms,
CASE WHEN value > 50 THEN '1' ELSE '0' END AS truth FROM events),
log AS (SELECT request_id || '/c' AS prediction_id, *, 'm' || user_id % 3 AS model_id, 'champion' AS role, true AS served, CASE WHEN user_id % 4 = 0 THEN '1' ELSE truth END AS prediction_value, ((user_id * 7 + event_id) % 100) / 200.0::DOUBLE + CASE WHEN truth = '1' THEN 0.4 ELSE 0.0 END::DOUBLE AS prediction_score FROM b
UNION ALL SELECT request_id || '/x', *, 'x0', 'challenger', false, CASE WHEN user_id % 3 = 0 THEN '1' ELSE '0' END, (event_id % 100) / 100.0::DOUBLE FROM b WHERE event_id % 2 = 0),
act AS (SELECT request_id, record_id, request_id || '/c' AS prediction_id, truth AS actual_value FROM b WHERE event_id % 5 <> 0),
j AS (SELECT log.*, act.actual_value AS actual FROM log LEFT JOIN act ON act.request_id = log.request_id AND act.record_id = log.record_id)"""


def base(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(
        "event_id", "user_id", "event_type", "value", F.col("event_id").cast("string").alias("request_id"), F.concat_ws("-", F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("record_id"), F.col("ts").alias("scored_at"),
        F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("request_status"), (F.col("user_id") % 11 == 0).alias("fallback_used"), F.floor(F.col("value") * 3).cast("int").alias("request_latency_ms"),
        F.when(F.col("value") > 50, "1").otherwise("0").alias("truth"), F.to_json(F.struct("user_id", "value")).alias("input_json"),
    )


def log(spark: SparkSession, d: str) -> DataFrame:
    b, u = base(spark, d), F.col("user_id")
    score = F.pmod(u * 7 + F.col("event_id"), F.lit(100)) / 200.0 + F.when(F.col("truth") == "1", 0.4).otherwise(0.0)
    champion = b.select(F.concat("request_id", F.lit("/c")).alias("prediction_id"), "*", F.concat(F.lit("m"), (u % 3).cast("string")).alias("model_id"), F.lit("champion").alias("role"), F.lit(True).alias("served"), F.when(u % 4 == 0, "1").otherwise(F.col("truth")).alias("prediction_value"), score.alias("prediction_score"))
    challenger = b.filter("event_id % 2 = 0").select(F.concat("request_id", F.lit("/x")).alias("prediction_id"), "*", F.lit("x0").alias("model_id"), F.lit("challenger").alias("role"), F.lit(False).alias("served"), F.when(u % 3 == 0, "1").otherwise("0").alias("prediction_value"), (F.pmod("event_id", F.lit(100)) / 100.0).alias("prediction_score"))
    return champion.unionByName(challenger)


def actuals(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d).filter("event_id % 5 <> 0").select("request_id", "record_id", F.concat("request_id", F.lit("/c")).alias("prediction_id"), F.col("truth").alias("actual_value"))


def joined(spark: SparkSession, d: str) -> DataFrame:
    return mon.join_labels(log(spark, d), actuals(spark, d), "actual_value", "request_record_id")


def window_of(spark: SparkSession, d: str) -> tuple[str, str]:
    return read(spark, d, "events").agg(F.date_trunc("day", F.min("ts")).cast("string"), (F.date_trunc("day", F.max("ts")) + F.expr("INTERVAL 1 DAY")).cast("string")).first()


@register(f"WITH {_L} SELECT prediction_id, actual FROM j")
def j2_join_by_prediction(spark: SparkSession, d: str) -> DataFrame:
    return mon.join_labels(log(spark, d), actuals(spark, d).select("prediction_id", "actual_value"), "actual_value").select("prediction_id", "actual")


@register(f"WITH {_L} SELECT prediction_id, actual FROM j")
def j3_join_by_request_record(spark: SparkSession, d: str) -> DataFrame:
    return joined(spark, d).select("prediction_id", "actual")


@register(f"WITH {_L} SELECT prediction_id, actual FROM j")
def j4_join_by_record(spark: SparkSession, d: str) -> DataFrame:
    return mon.join_labels(log(spark, d), actuals(spark, d).select("record_id", "actual_value"), "actual_value").select("prediction_id", "actual")


@register("SELECT DISTINCT o_orderstatus AS label, CAST((SELECT count(*) FROM orders a WHERE a.o_orderstatus = o.o_orderstatus) AS BIGINT) AS support, CAST(CASE WHEN o_orderstatus = 'F' THEN (SELECT count(*) FROM orders) ELSE 0 END AS BIGINT) AS predicted FROM orders o")
def j12_label_sets(spark: SparkSession, d: str) -> DataFrame:
    """Labels that are only actual, only predicted or both, with what each side has of them."""
    return ev.class_report(read(spark, d, "orders").withColumn("p", F.lit("F")), "o_orderstatus", "p").select("label", "support", "predicted")


@register(f"""WITH {_L} SELECT CAST(count(*) AS BIGINT) AS executions, CAST(count(*) FILTER (WHERE served) AS BIGINT) AS served, CAST(count(*) FILTER (WHERE served AND actual IS NOT NULL) AS BIGINT) AS labelled,
round(count(*) FILTER (WHERE served AND actual IS NOT NULL) / count(*) FILTER (WHERE served), 6) AS coverage, CAST(0 AS BIGINT) AS unmatched_actuals FROM j""")
def o1_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mon.coverage(joined(spark, d), actuals(spark, d), ["request_id", "record_id"]))


@register("""WITH f AS (SELECT 'value' AS feature, value AS x, 50.0 AS m, 5.0 AS lo, 200.0 AS hi FROM events UNION ALL SELECT 'user_id', user_id, 500.0, 10.0, 900.0 FROM events)
SELECT feature, CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS missing, CAST(count(x) AS BIGINT) AS valid, round(avg(x), 6) AS mean, round(min(x), 6) AS minimum, round(max(x), 6) AS maximum, CAST(count(*) FILTER (WHERE x < lo OR x > hi) AS BIGINT) AS out_of_range, round(abs(avg(x) - any_value(m)) / (any_value(hi) - any_value(lo)), 6) AS mean_shift FROM f GROUP BY 1""")
def o2_numeric_drift(spark: SparkSession, d: str) -> DataFrame:
    baseline = {"value": {"mean": 50.0, "minimum": 5.0, "maximum": 200.0}, "user_id": {"mean": 500.0, "minimum": 10.0, "maximum": 900.0}}
    return rounded(mon.numeric_drift(base(spark, d), "input_json", baseline))


@register("""WITH f AS (SELECT 'kind' AS feature, nullif(event_type, 'click') AS value FROM events UNION ALL SELECT 'group', CAST(user_id % 30 AS VARCHAR) FROM events), c AS (SELECT feature, value, count(*) AS n FROM f GROUP BY ALL),
r AS (SELECT *, n / sum(n) OVER (PARTITION BY feature) AS share, coalesce(sum(n) FILTER (WHERE value IS NULL) OVER (PARTITION BY feature), 0) AS missing FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS place FROM r WHERE value IS NOT NULL)
SELECT feature, value, CAST(n AS BIGINT) AS n, round(share, 6) AS share, CAST(missing AS BIGINT) AS missing FROM k WHERE place <= 20""")
def o3_categorical_inputs(spark: SparkSession, d: str) -> DataFrame:
    values = {"kind": F.nullif("event_type", F.lit("click")), "group": F.col("user_id") % 30}
    return rounded(mon.categorical_inputs(base(spark, d), values))


@register("""WITH c AS (SELECT CAST(user_id % 150 AS VARCHAR) AS p, count(*) AS n FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p) AS i FROM c)
SELECT CASE WHEN i <= 100 THEN p ELSE '__other__' END AS prediction, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / (SELECT sum(n) FROM c), 6) AS share FROM r GROUP BY 1""")
def o4_prediction_classes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mon.prediction_classes(base(spark, d).withColumn("p", F.col("user_id") % 150), "p"))


@register("SELECT CAST(count(*) AS BIGINT) AS n, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS sd, min(value) AS minimum, round(median(value), 5) AS median, max(value) AS maximum FROM events")
def o5_prediction_numbers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mon.prediction_numbers(base(spark, d).withColumn("p", F.col("value").cast("string")), "p")[0], 5)


@register(f"""WITH {_L}, w AS (SELECT date_trunc('day', min(ts)) AS lo, date_trunc('day', max(ts)) + INTERVAL 1 DAY AS hi FROM events), s AS (SELECT unnest(generate_series(lo, hi - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS bucket FROM w),
q AS (SELECT date_trunc('hour', scored_at) AS bucket, count(*) AS requests, count(*) FILTER (WHERE request_status = 'succeeded') AS succeeded, count(*) FILTER (WHERE request_status <> 'succeeded') AS failed, count(*) FILTER (WHERE fallback_used) AS fallbacks, avg(request_latency_ms) AS m, quantile_cont(request_latency_ms, 0.95) AS p, max(request_latency_ms) AS x FROM b GROUP BY 1),
r AS (SELECT date_trunc('hour', scored_at) AS bucket, count(*) AS executions, count(*) FILTER (WHERE served) AS served FROM log GROUP BY 1)
SELECT s.bucket, CAST(coalesce(requests, 0) AS BIGINT) AS requests, CAST(coalesce(succeeded, 0) AS BIGINT) AS succeeded, CAST(coalesce(failed, 0) AS BIGINT) AS failed, CAST(coalesce(fallbacks, 0) AS BIGINT) AS fallbacks, round(m, 4) AS mean_latency, round(p, 4) AS p95_latency, x AS max_latency,
CAST(coalesce(executions, 0) AS BIGINT) AS executions, CAST(coalesce(served, 0) AS BIGINT) AS served FROM s LEFT JOIN q ON q.bucket = s.bucket LEFT JOIN r ON r.bucket = s.bucket""")
def o6_request_health(spark: SparkSession, d: str) -> DataFrame:
    """Also J11: the calendar's buckets without requests are there, with zeros."""
    out = rounded(mon.request_health(log(spark, d), *window_of(spark, d)), 4)
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@register(f"""WITH {_L}, q AS (SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE request_status = 'succeeded') AS BIGINT) AS succeeded, CAST(count(*) FILTER (WHERE request_status <> 'succeeded') AS BIGINT) AS failed, CAST(count(*) FILTER (WHERE fallback_used) AS BIGINT) AS fallbacks,
round(avg(request_latency_ms), 4) AS mean_latency, max(request_latency_ms) AS max_latency, round(quantile_cont(request_latency_ms, 0.5), 4) AS p50, round(quantile_cont(request_latency_ms, 0.95), 4) AS p95, round(quantile_cont(request_latency_ms, 0.99), 4) AS p99 FROM b) SELECT * FROM q""")
def a8_service_health(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mon.service_health(base(spark, d)), 4)


@register("""SELECT 'code-' || user_id % 40 AS error_code, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, error_code LIMIT 20""")
def a8_error_codes(spark: SparkSession, d: str) -> DataFrame:
    return mon.error_codes(base(spark, d).withColumn("error_code", F.concat(F.lit("code-"), (F.col("user_id") % 40).cast("string"))))


@register("""WITH r AS (SELECT date_trunc('day', ts) AS bucket, value AS a, user_id / 10.0 AS p FROM events), m AS (SELECT *, avg(a) OVER (PARTITION BY bucket) AS m FROM r)
SELECT bucket, CAST(count(*) AS BIGINT) AS evaluated, round(avg(abs(a - p)), 4) AS mae, round(sqrt(avg((a - p) ** 2)), 4) AS rmse, round(1 - sum((a - p) ** 2) / nullif(sum((a - m) ** 2), 0), 4) AS r2, round(avg(a - p), 4) AS mean_residual FROM m GROUP BY 1""")
def o7_regression_by_day(spark: SparkSession, d: str) -> DataFrame:
    rows = base(spark, d).select("scored_at", F.col("value").alias("actual"), (F.col("user_id") / 10.0).alias("prediction_value"))
    out = rounded(mon.regression_over(mon.bucketed(rows, "day"), ["bucket"]), 4)
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


def _classes(key: str, source: str = "j") -> str:
    return f"""e AS (SELECT {key}, actual AS a, prediction_value AS p, prediction_score AS s FROM {source} WHERE actual IS NOT NULL), l AS (SELECT {key}, a AS label FROM e UNION SELECT {key}, p FROM e),
c AS (SELECT l.{key}, label, count(*) FILTER (WHERE a = label) AS support, count(*) FILTER (WHERE p = label) AS predicted, count(*) FILTER (WHERE a = label AND p = label) AS hits FROM l JOIN e ON e.{key} = l.{key} GROUP BY ALL),
k AS (SELECT *, hits / nullif(predicted, 0) AS precision, hits / nullif(support, 0) AS recall, 2 * hits / nullif(support + predicted, 0) AS f1 FROM c),
y AS (SELECT {key}, CAST(sum(support) AS BIGINT) AS evaluated, round(sum(hits) / sum(support), 6) AS accuracy, round(avg(recall) FILTER (WHERE support > 0), 6) AS balanced_accuracy, round(avg(coalesce(precision, 0)), 6) AS macro_precision, round(avg(coalesce(recall, 0)), 6) AS macro_recall, round(avg(coalesce(f1, 0)), 6) AS macro_f1, round(sum(coalesce(f1, 0) * support) / sum(support), 6) AS weighted_f1 FROM k GROUP BY 1)"""


def _ranks(key: str) -> str:
    return f"""g AS (SELECT {key}, s, count(*) FILTER (WHERE a = '1') AS pos, count(*) FILTER (WHERE a <> '1') AS neg FROM e GROUP BY ALL), w AS (SELECT *, sum(pos) OVER (PARTITION BY {key} ORDER BY s DESC) AS tp, sum(neg) OVER (PARTITION BY {key} ORDER BY s DESC) AS fp FROM g),
z AS (SELECT {key}, round(sum(neg * (tp - pos + pos / 2)) / nullif(sum(pos) * sum(neg), 0), 6) AS roc_auc, round(sum(pos * tp / (tp + fp)) / nullif(sum(pos), 0), 6) AS average_precision FROM w GROUP BY 1),
v AS (SELECT {key}, round(avg((s - (a = '1')::INT) ** 2), 6) AS brier, round(avg(-((a = '1')::INT * ln(least(greatest(s, 1e-15), 1 - 1e-15)) + (1 - (a = '1')::INT) * ln(1 - least(greatest(s, 1e-15), 1 - 1e-15)))), 6) AS log_loss FROM e GROUP BY 1)"""


@register(f"WITH {_L}, jb AS (SELECT *, date_trunc('day', scored_at) AS bucket FROM j), {_classes('bucket', 'jb')} SELECT * FROM y")
def o8_classification_by_day(spark: SparkSession, d: str) -> DataFrame:
    out = rounded(mon.classification_over(mon.bucketed(joined(spark, d), "day"), None, ["bucket"]))
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@register(f"WITH {_L}, jb AS (SELECT *, date_trunc('day', scored_at) AS bucket FROM j), {_classes('bucket', 'jb')}, {_ranks('bucket')} SELECT z.bucket, roc_auc, average_precision, brier, log_loss FROM z JOIN v ON v.bucket = z.bucket")
def o9_ranking_by_day(spark: SparkSession, d: str) -> DataFrame:
    rows = mon.bucketed(joined(spark, d), "day")
    out = ev.by_keys([ev.ranking(rows, "actual", "prediction_score", "1", ["bucket"]), ev.probability_losses(rows, "actual", "prediction_score", "1", ["bucket"])], ["bucket"])
    return rounded(out).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@register(f"WITH {_L}, {_classes('model_id')}, {_ranks('model_id')} SELECT y.*, roc_auc, average_precision, brier, log_loss FROM y JOIN z ON z.model_id = y.model_id JOIN v ON v.model_id = y.model_id")
def o10_by_model(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mon.classification_over(joined(spark, d), "1", ["model_id"]))


@register(f"WITH {_L}, t AS (SELECT date_trunc('day', min(ts)) + INTERVAL 1 DAY AS t0 FROM events), jb AS (SELECT j.*, date_trunc('day', scored_at) AS bucket FROM j, t WHERE date_trunc('day', scored_at) IN (t0, t0 + INTERVAL 1 DAY)), {_classes('bucket', 'jb')} SELECT * FROM y")
def o11_drill_buckets(spark: SparkSession, d: str) -> DataFrame:
    first = read(spark, d, "events").agg(F.date_trunc("day", F.min("ts"))).first()[0]
    from datetime import timedelta

    out = rounded(mon.drill_buckets(joined(spark, d), "day", [str(first + timedelta(days=1)), str(first + timedelta(days=2))]))
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


# --- streams -----------------------------------------------------------------------------------------------------


def stream_of(df: DataFrame, folder: str) -> DataFrame:
    """df written in order of time as a few files, then read as a stream of one file at a time."""
    df.repartitionByRange(4, "scored_at").sortWithinPartitions("scored_at").write.parquet(f"{folder}/in")
    return df.sparkSession.readStream.schema(df.schema).parquet(f"{folder}/in")


@register("""WITH m AS (SELECT date_trunc('hour', max(ts) - INTERVAL 10 MINUTE) AS closed FROM events) SELECT date_trunc('hour', ts) AS bucket, CAST(count(*) AS BIGINT) AS executions, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS failed, round(avg(CAST(floor(value * 3) AS INTEGER)), 4) AS mean_latency
FROM events, m WHERE date_trunc('hour', ts) < closed GROUP BY 1""")
def k1_windowed_health(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark)
    health = monitor.windowed_health(stream_of(base(spark, d).select("scored_at", "request_status", "request_latency_ms"), folder))
    monitor.to_table(health, f"{folder}/out", f"{folder}/state")
    out = rounded(spark.read.schema(health.schema).parquet(f"{folder}/out"), 4)
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@register("SELECT CAST(event_id AS VARCHAR) AS request_id FROM events")
def k2_idempotent_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Every request comes twice and is taken in once."""
    folder, b = work_folder(spark), base(spark, d).select("scored_at", "request_id")
    out = monitor.once_per_key(stream_of(b.unionByName(b), folder), ["request_id"], "scored_at")
    monitor.to_table(out, f"{folder}/out", f"{folder}/state")
    return spark.read.schema(out.schema).parquet(f"{folder}/out").select("request_id")


@register("SELECT CASE WHEN value > 100 OR event_type = 'error' THEN 'rejected' ELSE 'accepted' END AS side, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def k3_contract_gate(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark)
    rules = [Expectation("value", "maximum", 100.0), Expectation("request_status", "allowed_values", ["succeeded"])]
    stream = stream_of(base(spark, d).select("scored_at", "event_id", "value", "request_status"), folder)
    monitor.run_available(monitor.contract_gate(stream, rules, f"{folder}/accepted", f"{folder}/rejected"), f"{folder}/state")
    sides = [spark.read.parquet(f"{folder}/{s}").select(F.lit(s).alias("side")) for s in ("accepted", "rejected")]
    return sides[0].unionByName(sides[1]).groupBy("side").agg(F.count("*").alias("n"))
