"""Diagnostics of a time series: quality, cadence, gaps, correlation with its past and with drivers, seasons, decomposition.

Rows are ordered by range partitions: each partition is sorted and numbered by itself, and what reaches across its edge (the last rows before it)
is carried over, so no step sorts all rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.functions.lineage import range_parts
from marlpit.functions.ranks import quantiles, with_quantiles
from marlpit.functions.semantics import epoch_seconds, is_finite, safe_corr, safe_div

#: Lags taken in one pass.
LAGS_AT_ONCE = 40
STRENGTHS = ((0.7, "strong"), (0.4, "moderate"), (0.2, "weak"))


def series(df: DataFrame, ts: str, value: str, extra: Sequence[str] = ()) -> DataFrame:
    """ts, v and extra of rows with a time and a finite value."""
    return df.select(F.col(ts).try_cast("timestamp").alias("ts"), F.col(value).try_cast("double").alias("v"), *[F.col(c).try_cast("double").alias(c) for c in extra]).filter(F.col("ts").isNotNull() & is_finite(F.col("v")))


def ordered(rows: DataFrame, carry: int = 0, key: Sequence[str] = ("ts", "v")) -> DataFrame:
    """rows with position (from 1), part (its range partition) and own; with carry, a partition also gets copies (own = false) of the last ``carry`` rows before it,
    taken from as many earlier partitions as that needs, so that lags of up to carry rows find what they need within the partition."""
    keys = [F.col(k) for k in key]
    ranged = range_parts(rows, keys, "part")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col("part").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift"), "n")
    inside = Window.partitionBy("part").orderBy(*keys)
    numbered = ranged.withColumn("_k", F.row_number().over(inside)).join(F.broadcast(shift), F.col("part") == F.col("_p"))  # one row for each partition
    numbered = numbered.withColumn("position", F.col("_k") + F.col("_shift"))
    if not carry:
        return numbered.withColumn("own", F.lit(True)).drop("_k", "_p", "_shift", "n")
    starts = shift.select(F.col("_p").alias("to"), F.col("_shift").alias("begin"))
    late = numbered.filter(F.col("_k") > F.col("n") - carry).drop("_k", "_p", "_shift", "n")  # carry rows of each partition
    over = late.join(F.broadcast(starts), (F.col("to") > F.col("part")) & (F.col("position") > F.col("begin") - carry) & (F.col("position") <= F.col("begin")))
    over = over.withColumn("part", F.col("to")).drop("to", "begin").withColumn("own", F.lit(False))
    return numbered.drop("_k", "_p", "_shift", "n").withColumn("own", F.lit(True)).unionByName(over)


def in_order() -> Window:
    return Window.partitionBy("part").orderBy("position")


def with_lags(rows: DataFrame, column: str, lags: Sequence[int]) -> DataFrame:
    """rows (in order) with column lag_k for each k."""
    return lagged(ordered(rows, max(lags, default=0)), column, lags)


def lagged(both: DataFrame, column: str, lags: Sequence[int]) -> DataFrame:
    """Ordered rows, with what is carried, with lag_k for each k; then without what is carried."""
    w = in_order()
    return both.withColumns({f"lag_{k}": F.lag(column, k).over(w) for k in lags}).filter("own").drop("own")


def quality(df: DataFrame, ts: str, value: str) -> DataFrame:
    """One row: rows, missing_time, invalid_value, duplicate_timestamps, start, end, span_seconds."""
    t, v = F.col(ts).try_cast("timestamp"), F.col(value)
    counted = df.select(t.alias("t"), is_finite(v).alias("good")).groupBy("t").agg(F.count("*").alias("n"), F.count_if(~F.col("good")).alias("bad"), F.count_if(F.col("good")).alias("fine"))
    given = F.col("t").isNotNull()
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(~given, F.col("n"))), F.lit(0)).alias("missing_time"), F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid_value"),
        F.coalesce(F.sum(F.when(given & (F.col("fine") > 1), F.col("fine") - 1)), F.lit(0)).alias("duplicate_timestamps"),
        F.min("t").alias("start"), F.max("t").alias("end"), (epoch_seconds(F.max("t")) - epoch_seconds(F.min("t"))).alias("span_seconds"),
    )


def deltas(rows: DataFrame) -> DataFrame:
    """delta: seconds between neighbours, where they differ. Whole microseconds are subtracted: seconds since 1970 as doubles are only good to a quarter of one."""
    return with_lags(rows, "ts", [1]).select(((F.unix_micros("ts") - F.unix_micros("lag_1")) / F.lit(1e6)).alias("delta")).filter("delta > 0")


def cadence(df: DataFrame, ts: str, value: str) -> DataFrame:
    """One row: intervals, median, mean, sd, minimum, maximum of the seconds between neighbours."""
    d = deltas(series(df, ts, value))
    out = d.agg(F.count("*").alias("intervals"), F.avg("delta").alias("mean"), F.stddev_pop("delta").alias("sd"), F.min("delta").alias("minimum"), F.max("delta").alias("maximum"))
    return with_quantiles(out, d, [], "delta", {"median": 0.5})


def gaps(df: DataFrame, ts: str, value: str) -> DataFrame:
    """One row: gaps (intervals over 1.5 medians), regular_share (intervals within 5 % of the median)."""
    d = deltas(series(df, ts, value))
    middle = quantiles(d, [], "delta", [0.5]).select(F.get("q", F.lit(0)).alias("m"))
    x, m = F.col("delta"), F.col("m")
    return d.crossJoin(F.broadcast(middle)).agg(F.count_if(x > 1.5 * m).alias("gaps"), F.avg(F.when(F.abs(x - m) <= 0.05 * m, 1.0).otherwise(0.0)).alias("regular_share"))  # one row


def level(df: DataFrame, ts: str, value: str) -> DataFrame:
    """One row: n, mean, sd, minimum, maximum, slope_per_day, r2, diff_mean, diff_sd, lag1 correlation."""
    rows = with_lags(series(df, ts, value), "v", [1]).withColumn("day", epoch_seconds(F.col("ts")) / 86400)
    first = rows.agg(F.min("day").alias("d0"))
    rows = rows.crossJoin(F.broadcast(first)).withColumn("day", F.col("day") - F.col("d0"))  # one row
    d = F.col("v") - F.col("lag_1")
    return rows.agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("minimum"), F.max("v").alias("maximum"),
        F.regr_slope("v", "day").alias("slope_per_day"), F.regr_r2("v", "day").alias("r2"), F.avg(d).alias("diff_mean"), F.stddev_samp(d).alias("diff_sd"), safe_corr(F.col("v"), F.col("lag_1")).alias("lag1"),
    )


def lag_correlations(rows: DataFrame, moved: str, fixed: str, lags: Sequence[int]) -> DataFrame:
    """lag, correlation of fixed with moved so many rows before, pairs. The series is put in order once; LAGS_AT_ONCE lags are taken in one pass over it."""
    both, parts = ordered(rows, max(lags, default=0)), []
    for at in range(0, len(lags), LAGS_AT_ONCE):
        some = lags[at : at + LAGS_AT_ONCE]
        shifted = lagged(both, moved, some)
        cells = [F.struct(F.lit(k).alias("lag"), safe_corr(F.col(fixed), F.col(f"lag_{k}")).alias("correlation"), F.count_if(F.col(f"lag_{k}").isNotNull() & F.col(fixed).isNotNull()).alias("pairs")) for k in some]
        parts.append(shifted.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*"))
    return reduce(DataFrame.unionByName, parts)


def acf(df: DataFrame, ts: str, value: str, max_lag: int = 48) -> DataFrame:
    return lag_correlations(series(df, ts, value), "v", "v", range(1, max_lag + 1))


def ccf(df: DataFrame, ts: str, value: str, driver: str, max_lag: int = 48) -> DataFrame:
    """lag 0 and up: correlation of the value with the driver so many rows before."""
    return lag_correlations(series(df, ts, value, [driver]).filter(is_finite(F.col(driver))), driver, "v", range(0, max_lag + 1))


def strength(r: Column) -> Column:
    out = F.lit("negligible")
    for least, name in reversed(STRENGTHS):
        out = F.when(F.abs(r) >= least, name).otherwise(out)
    return F.when(r.isNull(), None).otherwise(out)


def driver_ranking(df: DataFrame, ts: str, value: str, drivers: Sequence[str], max_lag: int = 12) -> DataFrame:
    """driver, lag and correlation where it is strongest, direction, strength, rank."""
    found = reduce(DataFrame.unionByName, [ccf(df, ts, value, c, max_lag).withColumn("driver", F.lit(c)) for c in drivers])
    best = found.filter("correlation IS NOT NULL").groupBy("driver").agg(F.max_by(F.struct("lag", "correlation"), F.struct(F.round(F.abs("correlation"), 9), -F.col("lag"))).alias("b"))
    r = F.col("b.correlation")
    ranked = best.select("driver", "b.lag", r.alias("correlation"), F.when(r >= 0, "positive").otherwise("negative").alias("direction"), strength(r).alias("strength"))
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round(F.abs("correlation"), 9)), "driver")))


def suggest_period(correlations: DataFrame, least: float = 0.3) -> DataFrame:
    """One row, or none: the lag of the highest local peak of an autocorrelation at lag 3 or more."""
    w = Window.orderBy("lag")  # a row for each lag
    r = F.col("correlation")
    near = correlations.withColumn("b", F.lag("correlation").over(w)).withColumn("a", F.lead("correlation").over(w))
    peaks = near.filter((F.col("lag") >= 3) & (r >= least) & (r >= F.coalesce("b", F.lit(-2.0))) & (r >= F.coalesce("a", F.lit(-2.0))))
    return peaks.orderBy(F.desc(F.round(r, 9)), "lag").limit(1).select(F.col("lag").alias("period"), "correlation")


def bins(df: DataFrame, ts: str, value: str, max_points: int = 120, window: int = 5) -> DataFrame:
    """Up to max_points / 2 bins of time: mean, minimum, maximum, n, and the rolling mean and deviation of the bins' means."""
    return binned(series(df, ts, value), [F.avg("v").alias("mean"), F.min("v").alias("minimum"), F.max("v").alias("maximum"), F.count("*").alias("n")], max_points, window, "mean")


def binned(rows: DataFrame, measures: Sequence[Column], max_points: int, window: int | None = None, over: str | None = None) -> DataFrame:
    n = max(1, max_points // 2)
    e = epoch_seconds(F.col("ts"))
    bounds = rows.agg(F.min(e).alias("lo"), F.max(e).alias("hi"))
    at = F.coalesce(F.least(F.lit(n - 1), F.floor(safe_div(e - F.col("lo"), (F.col("hi") - F.col("lo")) / n))), F.lit(0)).cast("int")
    out = rows.crossJoin(F.broadcast(bounds)).groupBy(at.alias("bin")).agg(*measures)  # one row
    if window:
        w = Window.orderBy("bin").rowsBetween(-(window - 1), 0)  # over the bins
        out = out.withColumn("rolling_mean", F.avg(over).over(w)).withColumn("rolling_sd", F.stddev_pop(over).over(w))
    return out


def seasonal_profile(df: DataFrame, ts: str, value: str, period: int) -> DataFrame:
    """phase, mean, sd, n."""
    rows = ordered(series(df, ts, value)).withColumn("phase", ((F.col("position") - 1) % period).cast("int"))
    return rows.groupBy("phase").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.count("*").alias("n"))


def decompose(df: DataFrame, ts: str, value: str, period: int, max_points: int = 120) -> DataFrame:
    """Bins of observed, trend (a line over positions), seasonal (mean detrended value of the phase) and residual."""
    rows = ordered(series(df, ts, value)).withColumn("x", F.col("position").cast("double"))
    line = rows.agg(F.regr_slope("v", "x").alias("a"), F.regr_intercept("v", "x").alias("b"))
    rows = rows.crossJoin(F.broadcast(line)).withColumn("trend", F.col("b") + F.col("a") * F.col("x")).withColumn("phase", ((F.col("position") - 1) % period).cast("int"))  # one row
    phases = rows.groupBy("phase").agg(F.avg(F.col("v") - F.col("trend")).alias("seasonal"))
    rows = rows.join(F.broadcast(phases), "phase").withColumn("residual", F.col("v") - F.col("trend") - F.col("seasonal"))  # ``period`` rows
    return binned(rows, [F.avg(c).alias(n) for c, n in (("v", "observed"), ("trend", "trend"), ("seasonal", "seasonal"), ("residual", "residual"))], max_points)


def differences(df: DataFrame, ts: str, value: str, lag: int = 1, max_points: int = 120, window: int = 5) -> DataFrame:
    """Bins of the difference to the value so many rows before: mean, sd, and the rolling mean of their size."""
    rows = with_lags(series(df, ts, value), "v", [lag]).withColumn("d", F.col("v") - F.col(f"lag_{lag}")).filter("d IS NOT NULL")
    return binned(rows, [F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), F.avg(F.abs("d")).alias("size")], max_points, window, "size").drop("rolling_sd")


def features(df: DataFrame, ts: str, value: str, period: int, window: int = 5, ends: int = 50) -> DataFrame:
    """The first and last rows with position, lag_1, seasonal lag, difference, rolling mean and deviation."""
    w = in_order()
    rows = ordered(series(df, ts, value), max(period, window))
    rolling = w.rowsBetween(-(window - 1), 0)
    rows = rows.withColumns({"lag_1": F.lag("v", 1).over(w), "lag_season": F.lag("v", period).over(w), "rolling_mean": F.avg("v").over(rolling), "rolling_sd": F.stddev_pop("v").over(rolling)}).filter("own")
    total = rows.agg(F.max("position").alias("n"))
    rows = rows.crossJoin(F.broadcast(total)).filter((F.col("position") <= ends) | (F.col("position") > F.col("n") - ends))  # one row
    return rows.select("position", "ts", "v", "lag_1", "lag_season", (F.col("v") - F.col("lag_1")).alias("difference"), "rolling_mean", "rolling_sd")


def notes(gap_row: DataFrame, level_row: DataFrame) -> DataFrame:
    """What gaps and memory mean for who models the series."""
    both = gap_row.crossJoin(level_row)  # one row each
    rules = F.array_compact(F.array(
        F.when(F.col("gaps") > 0, F.lit("gaps: fill or mark them")), F.when(F.col("regular_share") < 0.95, F.lit("irregular: resample first")),
        F.when(F.abs("lag1") >= 0.7, F.lit("strong memory: random splits leak")),
    ))
    return both.select(F.explode(rules).alias("note"))
