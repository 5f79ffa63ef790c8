"""Time-series diagnostics over events (irregular) and their hourly sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.operators import timeseries as ts
from marlpit.queries.registry import collector, read, rounded

QUERIES, ORACLE_SQL, register = collector()

_O = "o AS (SELECT ts, value AS v, CAST(user_id AS DOUBLE) AS u, value * 0.5 + user_id AS w, row_number() OVER (ORDER BY ts, value) AS p FROM events)"
_D = f"{_O}, l AS (SELECT *, lag(ts) OVER (ORDER BY p) AS t1, lag(v) OVER (ORDER BY p) AS v1 FROM o), d AS (SELECT (epoch_us(ts) - epoch_us(t1)) / 1e6 AS delta FROM l WHERE ts > t1)"


def events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").withColumn("w", F.col("value") * 0.5 + F.col("user_id"))


@register("""SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS missing_time, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS invalid_value, CAST(count(*) FILTER (WHERE event_type <> 'click') - count(DISTINCT ts) FILTER (WHERE event_type <> 'click') AS BIGINT) AS duplicate_timestamps,
min(ts) AS start, max(ts) AS "end", round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS span_seconds FROM events""")
def t1_quality(spark: SparkSession, d: str) -> DataFrame:
    df = events(spark, d).withColumn("value", F.when(F.col("event_type") != "click", F.col("value")))
    out = rounded(ts.quality(df, "ts", "value"), 3)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@register(f"WITH {_D} SELECT CAST(count(*) AS BIGINT) AS intervals, round(median(delta), 4) AS median, round(avg(delta), 4) AS mean, round(stddev_pop(delta), 4) AS sd, round(min(delta), 4) AS minimum, round(max(delta), 4) AS maximum FROM d")
def t2_cadence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ts.cadence(events(spark, d), "ts", "value"), 4)


@register(f"WITH {_D}, m AS (SELECT median(delta) AS m FROM d) SELECT CAST(count(*) FILTER (WHERE delta > 1.5 * m) AS BIGINT) AS gaps, round(avg(CASE WHEN abs(delta - m) <= 0.05 * m THEN 1 ELSE 0 END), 6) AS regular_share FROM d, m")
def t3_gaps(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ts.gaps(events(spark, d), "ts", "value"))


@register(f"""WITH {_D}, y AS (SELECT *, (epoch_us(ts) - epoch_us((SELECT min(ts) FROM o))) / 86400e6 AS day FROM l)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS sd, min(v) AS minimum, max(v) AS maximum, round(regr_slope(v, day), 5) AS slope_per_day, round(regr_r2(v, day), 4) AS r2, round(avg(v - v1), 5) AS diff_mean, round(stddev_samp(v - v1), 5) AS diff_sd, round(corr(v, v1), 5) AS lag1 FROM y""")
def t4_level(spark: SparkSession, d: str) -> DataFrame:
    out = ts.level(events(spark, d), "ts", "value").withColumn("r2", F.round("r2", 4))
    return rounded(out, 5)


def _lags(first: int, last: int, fixed: str, moved: str) -> str:
    return f"WITH {_O}, " + "c AS (" + " UNION ALL ".join(f"SELECT {k} AS lag, corr({fixed}, m) AS r, count(m) AS n FROM (SELECT *, lag({moved}, {k}) OVER (ORDER BY p) AS m FROM o)" for k in range(first, last + 1)) + ")"


@register(_lags(1, 12, "v", "v") + " SELECT CAST(lag AS INTEGER) AS lag, round(r, 5) AS correlation, CAST(n AS BIGINT) AS pairs FROM c")
def t5_acf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ts.acf(events(spark, d), "ts", "value", 12), 5)


@register(_lags(0, 6, "v", "u") + " SELECT CAST(lag AS INTEGER) AS lag, round(r, 5) AS correlation, CAST(n AS BIGINT) AS pairs FROM c")
def t6_ccf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ts.ccf(events(spark, d), "ts", "value", "user_id", 6), 5)


@register(f"WITH {_O}, c AS (" + " UNION ALL ".join(f"SELECT '{n}' AS driver, {k} AS lag, corr(v, m) AS r FROM (SELECT *, lag({x}, {k}) OVER (ORDER BY p) AS m FROM o)" for n, x in (("user_id", "u"), ("w", "w")) for k in range(5)) + """),
b AS (SELECT driver, max_by(lag, (round(abs(r), 9), -lag)) AS lag, max_by(r, (round(abs(r), 9), -lag)) AS r FROM c GROUP BY 1)
SELECT driver, CAST(lag AS INTEGER) AS lag, round(r, 5) AS correlation, CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' WHEN abs(r) >= 0.2 THEN 'weak' ELSE 'negligible' END AS strength, CAST(row_number() OVER (ORDER BY round(abs(r), 9) DESC, driver) AS INTEGER) AS rank FROM b""")
def t7_driver_ranking(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ts.driver_ranking(events(spark, d), "ts", "value", ["user_id", "w"], 4), 5)


def seasonal(spark: SparkSession, d: str) -> DataFrame:
    """Orders by day with a weekly wave, derived from the orders table."""
    daily = read(spark, d, "orders").groupBy(F.date_trunc("day", "o_orderdate").alias("ts")).agg(F.count("*").alias("n"))
    phase = F.pmod(F.datediff("ts", F.lit("1990-01-01")), F.lit(7))
    return daily.withColumn("value", F.col("n") * 0.0137 + F.when(phase == 0, 3.0).when(phase == 1, 2.0).otherwise(0.0))


_SEASON = "s AS (SELECT date_trunc('day', o_orderdate) AS ts, count(*) * 0.0137::DOUBLE + CASE date_diff('day', DATE '1990-01-01', date_trunc('day', o_orderdate)::DATE) % 7 WHEN 0 THEN 3.0 WHEN 1 THEN 2.0 ELSE 0.0 END AS v FROM orders GROUP BY date_trunc('day', o_orderdate)), o AS (SELECT *, row_number() OVER (ORDER BY ts) AS p FROM s)"


@register("WITH " + _SEASON + ", c AS (" + " UNION ALL ".join(f"SELECT {k} AS lag, corr(v, m) AS r FROM (SELECT *, lag(v, {k}) OVER (ORDER BY p) AS m FROM o)" for k in range(1, 16)) + """),
n AS (SELECT *, lag(r) OVER (ORDER BY lag) AS b, lead(r) OVER (ORDER BY lag) AS a FROM c) SELECT CAST(lag AS INTEGER) AS period, round(r, 5) AS correlation FROM n WHERE lag >= 3 AND r >= 0.3 AND r >= coalesce(b, -2) AND r >= coalesce(a, -2) ORDER BY round(r, 9) DESC, lag LIMIT 1""")
def t8_suggest_period(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ts.suggest_period(ts.acf(seasonal(spark, d), "ts", "value", 15)), 5)


def _bins(rows: str, n: int) -> str:
    return f"bb AS (SELECT min(epoch_us(ts) / 1e6) AS lo, max(epoch_us(ts) / 1e6) AS hi FROM {rows}), bi AS (SELECT *, CAST(least({n - 1}, floor((epoch_us(ts) / 1e6 - lo) / ((hi - lo) / {n}))) AS INTEGER) AS bin FROM {rows}, bb)"


_ROLL = "OVER (ORDER BY bin ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@register(f"WITH {_O}, {_bins('o', 60)}, g AS (SELECT bin, avg(v) AS mean, min(v) AS minimum, max(v) AS maximum, count(*) AS n FROM bi GROUP BY 1) SELECT bin, round(mean, 5) AS mean, minimum, maximum, CAST(n AS BIGINT) AS n, round(avg(mean) {_ROLL}, 5) AS rolling_mean, round(stddev_pop(mean) {_ROLL}, 5) AS rolling_sd FROM g")
def t9_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ts.bins(events(spark, d), "ts", "value"), 5)


@register(f"WITH {_SEASON} SELECT CAST((p - 1) % 7 AS INTEGER) AS phase, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS sd, CAST(count(*) AS BIGINT) AS n FROM o GROUP BY 1")
def t10_seasonal_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ts.seasonal_profile(seasonal(spark, d), "ts", "value", 7), 5)


@register(f"""WITH {_SEASON}, f AS (SELECT regr_slope(v, p) AS a, regr_intercept(v, p) AS b FROM o), t AS (SELECT ts, v, p, b + a * p AS trend, (p - 1) % 7 AS phase FROM o, f),
h AS (SELECT phase, avg(v - trend) AS seasonal FROM t GROUP BY 1), r AS (SELECT t.ts, v, trend, seasonal, v - trend - seasonal AS residual FROM t JOIN h ON h.phase = t.phase), {_bins('r', 60)}
SELECT bin, round(avg(v), 5) AS observed, round(avg(trend), 5) AS trend, round(avg(seasonal), 5) AS seasonal, round(avg(residual), 5) AS residual FROM bi GROUP BY 1""")
def t11_decompose(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ts.decompose(seasonal(spark, d), "ts", "value", 7), 5)


@register(f"WITH {_O}, x AS (SELECT ts, v - lag(v, 2) OVER (ORDER BY p) AS d FROM o), r AS (SELECT * FROM x WHERE d IS NOT NULL), {_bins('r', 60)}, g AS (SELECT bin, avg(d) AS mean, stddev_samp(d) AS sd, avg(abs(d)) AS size FROM bi GROUP BY 1) SELECT bin, round(mean, 5) AS mean, round(sd, 5) AS sd, round(size, 5) AS size, round(avg(size) {_ROLL}, 5) AS rolling_mean FROM g")
def t12_differences(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ts.differences(events(spark, d), "ts", "value", 2), 5)


@register(f"""WITH {_O}, f AS (SELECT p AS position, ts, v, lag(v) OVER (ORDER BY p) AS lag_1, lag(v, 24) OVER (ORDER BY p) AS lag_season, avg(v) OVER (ORDER BY p ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m, stddev_pop(v) OVER (ORDER BY p ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s, count(*) OVER () AS n FROM o)
SELECT position, ts, v, lag_1, lag_season, round(v - lag_1, 5) AS difference, round(m, 5) AS rolling_mean, round(s, 5) AS rolling_sd FROM f WHERE position <= 50 OR position > n - 50""")
def t13_features(spark: SparkSession, d: str) -> DataFrame:
    out = ts.features(events(spark, d), "ts", "value", 24).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return out.withColumns({c: F.round(c, 5) + F.lit(0.0) for c in ("difference", "rolling_mean", "rolling_sd")})


@register(f"WITH {_D}, m AS (SELECT median(delta) AS m FROM d), g AS (SELECT count(*) FILTER (WHERE delta > 1.5 * m) AS gaps, avg(CASE WHEN abs(delta - m) <= 0.05 * m THEN 1 ELSE 0 END) AS share FROM d, m), k AS (SELECT corr(v, v1) AS r FROM l) SELECT 'gaps: fill or mark them' AS note FROM g WHERE gaps > 0 UNION ALL SELECT 'irregular: resample first' FROM g WHERE share < 0.95 UNION ALL SELECT 'strong memory: random splits leak' FROM k WHERE abs(r) >= 0.7")
def t14_notes(spark: SparkSession, d: str) -> DataFrame:
    df = events(spark, d)
    return ts.notes(ts.gaps(df, "ts", "value"), ts.level(df, "ts", "value"))


@register(f"WITH {_O}, {_bins('o', 100)}, g AS (SELECT bin, avg(v) AS mean FROM bi GROUP BY 1) SELECT 'series' AS chart, bin AS x, round(mean, 5) AS y, round(avg(mean) OVER (ORDER BY bin ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 5) AS overlay FROM g")
def t15_chart_series(spark: SparkSession, d: str) -> DataFrame:
    out = ts.bins(events(spark, d), "ts", "value", 200, 7)
    return rounded(out.select(F.lit("series").alias("chart"), F.col("bin").alias("x"), F.col("mean").alias("y"), F.col("rolling_mean").alias("overlay")), 5)


@register(f"""WITH {_O} SELECT p AS position, lag(v, 3) OVER (ORDER BY p) AS lag_3, round(avg(v) OVER (ORDER BY p ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 5) AS rolling_mean, CAST((p - 1) % 24 AS INTEGER) AS phase FROM o""")
def w2_w3_w8_windows(spark: SparkSession, d: str) -> DataFrame:
    """Lags, rolling means and phases of every row, numbered without sorting all rows in one task."""
    w = ts.in_order()
    rows = ts.ordered(ts.series(events(spark, d), "ts", "value"), 7)
    rows = rows.withColumn("lag_3", F.lag("v", 3).over(w)).withColumn("rolling_mean", F.avg("v").over(w.rowsBetween(-6, 0))).filter("own")
    return rows.select("position", "lag_3", F.round("rolling_mean", 5).alias("rolling_mean"), ((F.col("position") - 1) % 24).cast("int").alias("phase"))
