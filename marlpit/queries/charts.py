"""Chart queries over lineitem, orders and customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.operators import charts
from marlpit.queries.registry import collector, read, rounded

QUERIES, ORACLE_SQL, register = collector()


def lineitem(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem")


@register("""WITH g AS (SELECT l_linenumber AS x, l_returnflag AS grp, round(avg(l_quantity), 4) AS average, round(median(l_quantity), 4) AS median, round(coalesce(stddev_samp(l_quantity), 0), 4) AS std,
round(sum(l_quantity), 2) AS sum, CAST(count(l_quantity) AS BIGINT) AS count, min(l_quantity) AS min, max(l_quantity) AS max, CAST(count(*) AS BIGINT) AS valid FROM lineitem GROUP BY ALL)
SELECT *, (SELECT count(*) FROM g) > 142 AS truncated FROM g ORDER BY x, grp LIMIT 142""")
def v1_chart_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.chart_aggregate(lineitem(spark, d), "l_linenumber", "l_quantity", list(charts.METRICS), "l_returnflag"), 4)


@register("""SELECT round((floor(c_acctbal / 500.0::DOUBLE + 1e-12) + 0.5) * 500, 12) AS x, 'all' AS grp, CAST(count(*) AS BIGINT) AS count, CAST(count(*) AS BIGINT) AS valid, false AS truncated FROM customer GROUP BY 1""")
def v2_epsilon_buckets(spark: SparkSession, d: str) -> DataFrame:
    return charts.chart_aggregate(read(spark, d, "customer"), "c_acctbal", "c_acctbal", ["count"], epsilon=250.0)


@register("SELECT o_orderstatus, round(avg(o_totalprice), 4) AS value, CAST(count(*) AS BIGINT) AS valid, avg(o_totalprice) >= 140000 AS met FROM orders GROUP BY 1")
def v3_kpi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.kpi(read(spark, d, "orders"), "average", "o_totalprice", ["o_orderstatus"], "gte", 140000.0), 4)


@register("""WITH q AS (SELECT l_returnflag AS grp, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
SELECT grp, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, CAST(count(*) AS BIGINT) AS n, min(l_extendedprice) FILTER (WHERE l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low,
max(l_extendedprice) FILTER (WHERE l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high, CAST(count(*) FILTER (WHERE NOT l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outliers
FROM lineitem JOIN q ON grp = l_returnflag GROUP BY ALL""")
def v4_boxplot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.boxplot(lineitem(spark, d), "l_extendedprice", "l_returnflag"), 4)


@register("""WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
c AS (SELECT l_linestatus AS grp, CAST(least(127, floor((l_extendedprice - lo) / ((hi - lo) / 128))) AS INTEGER) AS bin, count(*) AS c FROM lineitem, b GROUP BY ALL),
s AS (SELECT l_linestatus AS grp, count(*) AS n, 1.06 * stddev_samp(l_extendedprice) * count(*) ** -0.2 AS h FROM lineitem GROUP BY 1), g AS (SELECT unnest(range(128)) AS k),
o AS (SELECT c.grp, CAST(k AS INTEGER) AS k, lo - 0.1 * (hi - lo) + (hi - lo) * 1.2 / 127 * k AS x, sum(c * exp(-0.5 * ((lo - 0.1 * (hi - lo) + (hi - lo) * 1.2 / 127 * k - lo - (hi - lo) / 128 * (bin + 0.5)) / h) ** 2) / (n * h * sqrt(2 * pi()))) AS d
FROM c JOIN s ON s.grp = c.grp, b, g GROUP BY c.grp, k, lo, hi)
SELECT grp, k, round(x, 3) AS x, round(1e6 * d, 4) AS density FROM o, b WHERE NOT (lo >= 0 AND x < 0)""")
def v5_kde(spark: SparkSession, d: str) -> DataFrame:
    out = charts.kde(lineitem(spark, d), "l_extendedprice", "l_linestatus")
    return out.withColumn("density", F.round(1e6 * F.col("density"), 4)).withColumn("x", F.round("x", 3))


@register("""WITH b AS (SELECT min(l_quantity) AS lx, max(l_quantity) AS hx, min(l_extendedprice) AS ly, max(l_extendedprice) AS hy FROM lineitem),
c AS (SELECT l_returnflag AS grp, CAST(least(24, floor((l_quantity - lx) / ((hx - lx) / 25))) AS BIGINT) AS cell_x, CAST(least(24, floor((l_extendedprice - ly) / ((hy - ly) / 25))) AS BIGINT) AS cell_y, avg(l_quantity) AS x, avg(l_extendedprice) AS y, count(*) AS n FROM lineitem, b GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, cell_x, cell_y) AS group_rank FROM c)
SELECT grp, cell_x, cell_y, round(x, 4) AS x, round(y, 4) AS y, CAST(n AS BIGINT) AS n, CAST(group_rank AS INTEGER) AS group_rank FROM r ORDER BY group_rank, grp LIMIT 1900""")
def v6_scatter_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.scatter_bins(lineitem(spark, d), "l_quantity", "l_extendedprice", "l_returnflag", 1900), 4)


@register("""WITH c AS (SELECT 'all' AS grp, CAST(floor(l_quantity / 5 + 1e-12) AS BIGINT) AS cell_x, CAST(floor(l_extendedprice / 20000 + 1e-12) AS BIGINT) AS cell_y, avg(l_quantity) AS x, avg(l_extendedprice) AS y, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT grp, cell_x, cell_y, round(x, 4) AS x, round(y, 4) AS y, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY n DESC, cell_x, cell_y) AS INTEGER) AS group_rank FROM c""")
def v7_scatter_epsilon(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.scatter_bins(lineitem(spark, d), "l_quantity", "l_extendedprice", epsilon=(2.5, 10000.0)), 4)


@register("SELECT l_returnflag AS grp, CAST(count(*) AS BIGINT) AS n, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1")
def v8_trend_linear(spark: SparkSession, d: str) -> DataFrame:
    out = charts.trend(lineitem(spark, d), "l_quantity", "l_extendedprice", "l_returnflag")
    return out.withColumns({"slope": F.round("slope", 3), "intercept": F.round("intercept", 2), "r2": F.round("r2", 6)})


@register("""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
SELECT 'all' AS grp, CAST(k AS INTEGER) AS k, round(lo + (hi - lo) * k / 79, 6) AS x, round(b + a * (lo + (hi - lo) * k / 79), 2) AS y FROM f, (SELECT unnest(range(80)) AS k)""")
def v8_trend_curve(spark: SparkSession, d: str) -> DataFrame:
    out = charts.trend_curve(charts.trend(lineitem(spark, d), "l_quantity", "l_extendedprice"))
    return out.withColumns({"x": F.round("x", 6), "y": F.round("y", 2)})


@register("SELECT l_returnflag AS grp, CAST(count(*) AS BIGINT) AS n, round(exp(regr_intercept(ln(l_extendedprice), l_quantity)), 2) AS amplitude, round(regr_slope(ln(l_extendedprice), l_quantity), 8) AS rate, round(regr_r2(ln(l_extendedprice), l_quantity), 6) AS r2, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1")
def v9_trend_exponential(spark: SparkSession, d: str) -> DataFrame:
    out = charts.trend(lineitem(spark, d), "l_quantity", "l_extendedprice", "l_returnflag", "exponential")
    return out.withColumns({"amplitude": F.round("amplitude", 2), "rate": F.round("rate", 8), "r2": F.round("r2", 6)})


@register("""WITH b AS (SELECT (min(l_quantity) + max(l_quantity)) / 2 AS c, (max(l_quantity) - min(l_quantity)) / 2 AS h FROM lineitem), z AS (SELECT (l_quantity - c) / h AS z, l_extendedprice AS y, c, h FROM lineitem, b)
SELECT 'all' AS grp, any_value(c) AS centre, any_value(h) AS half, CAST(count(*) AS BIGINT) AS n, """ + ", ".join(f"round(sum(z ** {k}), 3) AS s{k}" for k in range(5)) + ", " + ", ".join(f"round(sum(y * z ** {k}) / 1e6, 3) AS t{k}" for k in range(3)) + " FROM z")
def v10_polynomial_moments(spark: SparkSession, d: str) -> DataFrame:
    out = charts.polynomial_moments(lineitem(spark, d), "l_quantity", "l_extendedprice", 2).drop("yy", "y1")
    return rounded(out.withColumns({f"t{k}": F.col(f"t{k}") / 1e6 for k in range(3)}), 3)


_MOMENTS = ", ".join(f"sum(z ** {k}) AS s{k}" for k in range(5)) + ", " + ", ".join(f"sum(y * z ** {k}) AS t{k}" for k in range(3))


def _det(a: str, b: str, c: str, d: str, e: str, f: str, g: str, h: str, i: str) -> str:
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


@register(f"""WITH b AS (SELECT (min(l_quantity) + max(l_quantity)) / 2 AS c, (max(l_quantity) - min(l_quantity)) / 2 AS h FROM lineitem), z AS (SELECT l_returnflag AS grp, (l_quantity - c) / h AS z, l_extendedprice AS y FROM lineitem, b), m AS (SELECT grp, count(*) AS n, {_MOMENTS} FROM z GROUP BY 1),
d AS (SELECT *, {_det("s0", "s1", "s2", "s1", "s2", "s3", "s2", "s3", "s4")} AS d FROM m),
k AS (SELECT grp, n, {_det("t0", "s1", "s2", "t1", "s2", "s3", "t2", "s3", "s4")} / d AS b0, {_det("s0", "t0", "s2", "s1", "t1", "s3", "s2", "t2", "s4")} / d AS b1, {_det("s0", "s1", "t0", "s1", "s2", "t1", "s2", "s3", "t2")} / d AS b2 FROM d)
SELECT grp, CAST(n AS BIGINT) AS n, CAST(x AS DOUBLE) AS x, round(b0 + b1 * (x - c) / h + b2 * ((x - c) / h) ** 2, 2) AS y FROM k, b, (SELECT unnest([5, 20, 45]) AS x)""")
def v10_quadratic_points(spark: SparkSession, d: str) -> DataFrame:
    """Three points of each group's parabola."""
    out = charts.trend_polynomial(lineitem(spark, d), "l_quantity", "l_extendedprice", 2, "l_returnflag").withColumn("x", F.explode(F.array(F.lit(5.0), F.lit(20.0), F.lit(45.0))))
    y = F.col("coefficients")[0] + F.col("coefficients")[1] * F.col("x") + F.col("coefficients")[2] * F.col("x") * F.col("x")
    return out.select("grp", "n", "x", F.round(y, 2).alias("y"))


@register(None)
def v10_trend_polynomial(spark: SparkSession, d: str) -> DataFrame:
    return charts.trend_polynomial(lineitem(spark, d), "l_quantity", "l_extendedprice", 3, "l_returnflag")


@register("""WITH b AS (SELECT l_returnflag AS grp, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1)
SELECT grp, CAST(least(23, floor((l_quantity - lo) / ((hi - lo) / 24))) AS BIGINT) AS bin, round(avg(l_quantity), 4) AS x, round(avg(l_extendedprice), 3) AS y, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN b ON grp = l_returnflag GROUP BY ALL""")
def v11_spline_nodes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.spline_nodes(lineitem(spark, d), "l_quantity", "l_extendedprice", "l_returnflag"), 4).withColumn("y", F.round("y", 3))


_NODES = """b AS (SELECT l_returnflag AS grp, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1),
n AS (SELECT grp, least(23, floor((l_quantity - lo) / ((hi - lo) / 24))) AS bin, avg(l_quantity) AS x, avg(l_extendedprice) AS y FROM lineitem JOIN b ON grp = l_returnflag GROUP BY ALL)"""


@register(f"""WITH {_NODES}, e AS (SELECT grp, min(x) AS x0, max(x) AS x1 FROM n GROUP BY 1)
SELECT grp, CAST(k AS INTEGER) AS k, round(x0 + (x1 - x0) * k / 79, 4) AS x, round(3 * (x0 + (x1 - x0) * k / 79) + 1, 4) AS y FROM e, (SELECT unnest(range(80)) AS k)""")
def v11_spline_of_a_line(spark: SparkSession, d: str) -> DataFrame:
    """All points of the spline through nodes on a line lie on it."""
    df = lineitem(spark, d).withColumn("line", F.col("l_quantity") * 3 + 1)
    return rounded(charts.trend_spline(df, "l_quantity", "line", "l_returnflag"), 4)


@register(f"""WITH {_NODES}, e AS (SELECT grp, 0 AS k, min(x) AS x, min_by(y, x) AS y FROM n GROUP BY 1 UNION ALL SELECT grp, 79, max(x), max_by(y, x) FROM n GROUP BY 1)
SELECT grp, CAST(k AS INTEGER) AS k, round(x, 4) AS x, round(y, 2) AS y FROM e""")
def v11_spline_ends(spark: SparkSession, d: str) -> DataFrame:
    """The spline begins and ends in its outer nodes."""
    out = charts.trend_spline(lineitem(spark, d), "l_quantity", "l_extendedprice", "l_returnflag").filter("k IN (0, 79)")
    return out.select("grp", "k", F.round("x", 4).alias("x"), F.round("y", 2).alias("y"))


@register(None)
def v11_trend_spline(spark: SparkSession, d: str) -> DataFrame:
    return charts.trend_spline(lineitem(spark, d), "l_quantity", "l_extendedprice", "l_returnflag")


_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register(" UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(covar_pop({a}, {b}), 5) AS covariance FROM lineitem" for i, a in enumerate(_FEATURES) for b in _FEATURES[i:] if (a, b) != ("l_extendedprice", "l_extendedprice")))
def v13_covariance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.covariance(lineitem(spark, d), _FEATURES).filter("NOT (feature_a = 'l_extendedprice' AND feature_b = 'l_extendedprice')"), 5)


@register(None)
def v13_pca_projection(spark: SparkSession, d: str) -> DataFrame:
    df = lineitem(spark, d).withColumn("returned", (F.col("l_returnflag") == "R").cast("double"))
    return charts.pca_projection(df, _FEATURES, "returned")
