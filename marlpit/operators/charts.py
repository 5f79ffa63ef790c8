"""Chart queries: a scan of all rows, a bounded result."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.functions.ranks import quantiles, with_quantiles
from marlpit.functions.semantics import is_finite, order, safe_div
from marlpit.operators.profile import density
from marlpit.operators.transforms import fair_top, group_count_guard

#: The median is found by places, not by an aggregate.
METRICS = {
    "average": F.avg,
    "median": None,
    "std": lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0)),
    "sum": F.sum,
    "count": F.count,
    "min": F.min,
    "max": F.max,
}
MAX_BOX_GROUPS, MAX_TREND_GROUPS, TREND_POINTS, SPLINE_BINS = 20, 100, 80, 24


def epsilon_centre(x: Column, epsilon: float) -> Column:
    """The centre of the half-open bucket of width 2 epsilon, anchored at 0, that holds x."""
    width = 2 * epsilon
    return F.round((F.floor(x / width + 1e-12) + 0.5) * width, 12)


def measured(rows: DataFrame, keys: Sequence[str], y: str, named: dict[str, str]) -> DataFrame:
    """keys, a column for each named metric of y, valid."""
    out = rows.groupBy(*keys).agg(*[METRICS[m](y).alias(n) for n, m in named.items() if METRICS[m]], F.count(y).alias("valid"))
    middles = {n: 0.5 for n, m in named.items() if not METRICS[m]}
    return with_quantiles(out, rows, keys, y, middles) if middles else out


def chart_aggregate(df: DataFrame, x: str, y: str, metrics: Sequence[str], group: str | None = None, epsilon: float | None = None, max_points: int = 1000) -> DataFrame:
    """x, grp, metrics and valid (rows with a finite y), in order of x; truncated says whether more were cut off."""
    key = epsilon_centre(F.col(x).cast("double"), epsilon) if epsilon else F.col(x)
    value = F.when(is_finite(F.col(y)), F.col(y).cast("double"))
    cut = df.select(key.alias("x"), (F.col(group).cast("string") if group else F.lit("all")).alias("grp"), value.alias("y")).filter("x IS NOT NULL")
    grouped = measured(cut, ["x", "grp"], "y", {m: m for m in metrics})
    keep = max(1, max_points // len(metrics))
    rows = grouped.orderBy("x", "grp").limit(keep)
    return rows.crossJoin(F.broadcast(grouped.agg((F.count("*") > keep).alias("truncated"))))  # one row


def kpi(df: DataFrame, metric: str, y: str, groups: Sequence[str] = (), condition: str | None = None, threshold: float | None = None) -> DataFrame:
    """One metric and its valid rows; met says whether the value is eq, lt, lte, gt or gte the threshold."""
    value = F.when(is_finite(F.col(y)), F.col(y).cast("double"))
    out = measured(df.select(*groups, value.alias("_y")), list(groups), "_y", {"value": metric})
    if condition:
        v, t = F.col("value"), F.lit(threshold)
        out = out.withColumn("met", {"eq": v == t, "lt": v < t, "lte": v <= t, "gt": v > t, "gte": v >= t}[condition])
    return out


def boxplot(df: DataFrame, x: str, group: str | None = None) -> DataFrame:
    """Per group: n, q1, median, q3, the whiskers (the outermost values within 1.5 quartile distances), outliers."""
    if group:
        group_count_guard(df.filter(is_finite(F.col(x))), group, MAX_BOX_GROUPS)
    cut = df.filter(is_finite(F.col(x))).select((F.col(group).cast("string") if group else F.lit("all")).alias("grp"), F.col(x).cast("double").alias("v"))
    stats = quantiles(cut, ["grp"], "v", [0.25, 0.5, 0.75])
    stats = stats.select("grp", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    v, reach = F.col("v"), 1.5 * (F.col("q3") - F.col("q1"))
    inside = v.between(F.col("q1") - reach, F.col("q3") + reach)
    joined = cut.join(F.broadcast(stats), "grp")  # MAX_BOX_GROUPS rows
    return joined.groupBy("grp", "q1", "median", "q3").agg(F.count("*").alias("n"), F.min(F.when(inside, v)).alias("low"), F.max(F.when(inside, v)).alias("high"), F.count_if(~inside).alias("outliers"))


def kde(df: DataFrame, x: str, group: str | None = None, bins: int = 128) -> DataFrame:
    """A density curve per group; see profile.density. Of one-signed data the far side of zero is cut off."""
    if group:
        group_count_guard(df, group, MAX_BOX_GROUPS)
    out = density(df.filter(is_finite(F.col(x))), x, group, bins=bins, points=bins, margin=0.1, floor_share=None)
    bounds = df.filter(is_finite(F.col(x))).agg(F.min(F.col(x).cast("double")).alias("lo"), F.max(F.col(x).cast("double")).alias("hi"))
    one_side = ((F.col("lo") >= 0) & (F.col("x") < 0)) | ((F.col("hi") <= 0) & (F.col("x") > 0))
    return out.crossJoin(F.broadcast(bounds)).filter(~one_side).drop("lo", "hi")  # one row


def scatter_bins(df: DataFrame, x: str, y: str, group: str | None = None, max_points: int = 2000, epsilon: tuple[float, float] | None = None) -> DataFrame:
    """Cells of a grid with the mean of their points and their number; groups take turns where there are more cells than max_points.
    The grid has 5 to 50 columns; with epsilon its cells are 2 epsilon wide, anchored at 0."""
    n_groups = group_count_guard(df, group, MAX_TREND_GROUPS) if group else 1
    cut = df.filter(is_finite(F.col(x)) & is_finite(F.col(y))).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (F.col(group).cast("string") if group else F.lit("all")).alias("grp"))
    if epsilon:
        for c, e in zip("xy", epsilon, strict=True):
            index = F.col(c) / (2 * e)
            cut = cut.filter(F.abs(index) < 9e18).withColumn(f"cell_{c}", F.floor(index + 1e-12))
    else:
        side = int(min(50, max(5, (max_points / max(1, n_groups)) ** 0.5)))
        bounds = cut.agg(*[f(c).alias(f"{n}{c}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))])
        cut = cut.crossJoin(F.broadcast(bounds))  # one row
        for c in "xy":
            width = (F.col(f"hi{c}") - F.col(f"lo{c}")) / side
            cut = cut.withColumn(f"cell_{c}", F.coalesce(F.least(F.lit(side - 1), F.floor((F.col(c) - F.col(f"lo{c}")) / F.nullif(width, F.lit(0.0)))), F.lit(0)))
    cells = cut.groupBy("grp", "cell_x", "cell_y").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    return fair_top(cells, "grp", [F.desc("n"), F.col("cell_x"), F.col("cell_y")], max_points)


def _trend_rows(df: DataFrame, x: str, y: str, group: str | None) -> DataFrame:
    if group:
        group_count_guard(df, group, MAX_TREND_GROUPS)
    return df.filter(is_finite(F.col(x)) & is_finite(F.col(y))).select((F.col(group).cast("string") if group else F.lit("all")).alias("grp"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


def trend(df: DataFrame, x: str, y: str, group: str | None = None, kind: str = "linear") -> DataFrame:
    """Per group: n, slope, intercept, r2 and the range of x. kind exponential fits ln y where y > 0: y = amplitude * exp(rate * x), r2 in logarithms."""
    rows = _trend_rows(df, x, y, group)
    if kind == "exponential":
        rows = rows.filter("y > 0").withColumn("y", F.log("y"))
    fit = rows.groupBy("grp").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    fit = fit.filter("n > 1 AND slope IS NOT NULL")
    if kind == "exponential":
        fit = fit.select("grp", "n", F.exp("intercept").alias("amplitude"), F.col("slope").alias("rate"), "r2", "lo", "hi")
    return fit


def trend_curve(fit: DataFrame) -> DataFrame:
    """80 points of each fitted line or exponential."""
    t = F.explode(F.sequence(F.lit(0), F.lit(TREND_POINTS - 1))).alias("k")
    p = fit.select("*", t).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (TREND_POINTS - 1))
    y = F.col("amplitude") * F.exp(F.col("rate") * F.col("x")) if "rate" in fit.columns else F.col("intercept") + F.col("slope") * F.col("x")
    return p.select("grp", "k", "x", y.alias("y"))


def polynomial_moments(df: DataFrame, x: str, y: str, degree: int, group: str | None = None) -> DataFrame:
    """Per group: n, centre and half (x is scaled to -1..1), sums of powers of x and of y times them."""
    rows = _trend_rows(df, x, y, group)
    span = rows.groupBy("grp").agg(((F.min("x") + F.max("x")) / 2).alias("centre"), ((F.max("x") - F.min("x")) / 2).alias("half"))
    z = (F.col("x") - F.col("centre")) / F.nullif("half", F.lit(0.0))
    scaled = rows.join(F.broadcast(span), "grp").filter("half > 0").withColumn("z", z)  # MAX_TREND_GROUPS rows
    powers = [F.sum(F.pow("z", F.lit(float(k)))).alias(f"s{k}") for k in range(2 * degree + 1)]
    mixed = [F.sum(F.col("y") * F.pow("z", F.lit(float(k)))).alias(f"t{k}") for k in range(degree + 1)]
    return scaled.groupBy("grp", "centre", "half").agg(F.count("*").alias("n"), *powers, *mixed, F.sum(F.col("y") ** 2).alias("yy"), F.sum("y").alias("y1"))


def trend_polynomial(df: DataFrame, x: str, y: str, degree: int = 2, group: str | None = None) -> DataFrame:
    """Per group: n, coefficients of 1, x, x**2 ..., r2. The sums come from Spark; each group's small system is solved where its one row is."""

    def solve(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples():
                s = [getattr(r, f"s{k}") for k in range(2 * degree + 1)]
                t = np.array([getattr(r, f"t{k}") for k in range(degree + 1)])
                a = np.array([[s[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
                if np.linalg.matrix_rank(a) <= degree:
                    continue
                b = np.linalg.solve(a, t)
                left, total = r.yy - b @ t, r.yy - r.y1**2 / r.n
                poly = np.polynomial.Polynomial(b)(np.polynomial.Polynomial([-r.centre / r.half, 1 / r.half]))
                out.append((r.grp, r.n, [float(c) for c in poly.coef], float(1 - left / total) if total > 0 else 1.0))
            yield pd.DataFrame(out, columns=["grp", "n", "coefficients", "r2"])

    return polynomial_moments(df, x, y, degree, group).mapInPandas(solve, "grp string, n long, coefficients array<double>, r2 double")


def spline_nodes(df: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    """Means of up to 24 equal-width bins per group."""
    rows = _trend_rows(df, x, y, group)
    span = rows.groupBy("grp").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.least(F.lit(SPLINE_BINS - 1), F.floor((F.col("x") - F.col("lo")) / F.nullif((F.col("hi") - F.col("lo")) / SPLINE_BINS, F.lit(0.0))))
    return rows.join(F.broadcast(span), "grp").groupBy("grp", at.alias("bin")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).filter("bin IS NOT NULL")  # MAX_TREND_GROUPS rows


def natural_spline(xs: np.ndarray, ys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The natural cubic spline through nodes, by its second derivatives."""
    h = np.diff(xs)
    n = len(xs)
    a, b = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((ys[i + 1] - ys[i]) / h[i] - (ys[i] - ys[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, b)
    i = np.clip(np.searchsorted(xs, at, side="right") - 1, 0, n - 2)
    left, right = (xs[i + 1] - at) / h[i], (at - xs[i]) / h[i]
    return left * ys[i] + right * ys[i + 1] + h[i] ** 2 / 6 * ((left**3 - left) * m[i] + (right**3 - right) * m[i + 1])


def trend_spline(df: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    """80 points per group of the spline through its bin means."""

    def curve(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("x")
        if len(nodes) < 3:
            return pd.DataFrame({"grp": [], "k": [], "x": [], "y": []})
        at = np.linspace(nodes["x"].iloc[0], nodes["x"].iloc[-1], TREND_POINTS)
        return pd.DataFrame({"grp": nodes["grp"].iloc[0], "k": np.arange(TREND_POINTS), "x": at, "y": natural_spline(nodes["x"].to_numpy(), nodes["y"].to_numpy(), at)})

    return spline_nodes(df, x, y, group).groupBy("grp").applyInPandas(curve, "grp string, k int, x double, y double")


def covariance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature_a, feature_b, covariance (of the population) over rows in which all are finite; one aggregate."""
    for c in columns:
        df = df.filter(is_finite(F.col(c)))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    cells = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias("covariance")) for a, b in pairs]
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def principal_axes(df: DataFrame, columns: Sequence[str], standardise: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, axes in columns by falling variance, variances); the largest entry of an axis is positive. The covariance matrix comes from one aggregate."""
    for c in columns:
        df = df.filter(is_finite(F.col(c)))
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    x = [F.col(c).cast("double") for c in columns]
    row = df.agg(*[F.avg(v) for v in x], *[F.covar_pop(x[i], x[j]) for i, j in pairs]).first()
    if row[0] is None:
        raise ValueError("no complete rows")
    cov = np.zeros((k, k))
    for (i, j), v in zip(pairs, row[k:], strict=True):
        cov[i, j] = cov[j, i] = v
    scale = np.sqrt(np.diag(cov)) if standardise else np.ones(k)
    scale = np.where(scale > 0, scale, 1.0)
    values, axes = np.linalg.eigh(cov / np.outer(scale, scale))
    values, axes = values[::-1], axes[:, ::-1]
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], 0) < 0, -1, 1)
    return np.array(row[:k], dtype=float), scale, axes, np.maximum(values, 0)


def projected(columns: Sequence[str], means: np.ndarray, scale: np.ndarray, axis: np.ndarray) -> Column:
    return sum((F.col(c).cast("double") - float(m)) * float(a / s) for c, m, s, a in zip(columns, means, scale, axis, strict=True))


def pca_projection(df: DataFrame, features: Sequence[str], target: str | None = None, side: int = 30) -> DataFrame:
    """Cells of a grid over the first two principal components of the standardised features: centre, n, mean target; and each component's share of the variance."""
    means, scale, axes, values = principal_axes(df, features)
    for c in features:
        df = df.filter(is_finite(F.col(c)))
    two = df.select(*[projected(features, means, scale, axes[:, i]).alias(n) for i, n in enumerate("xy")], (F.col(target).cast("double") if target else F.lit(None).cast("double")).alias("t"))
    cells = scatter_cells(two, side)
    shares = values / values.sum() if values.sum() else values
    return cells.withColumn("share_x", F.lit(float(shares[0]))).withColumn("share_y", F.lit(float(shares[1])))


def scatter_cells(two: DataFrame, side: int) -> DataFrame:
    bounds = two.agg(*[f(c).alias(f"{n}{c}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    at = {c: F.coalesce(F.least(F.lit(side - 1), F.floor(safe_div(F.col(c) - F.col(f"lo{c}"), (F.col(f"hi{c}") - F.col(f"lo{c}")) / side))), F.lit(0)) for c in "xy"}
    return two.crossJoin(F.broadcast(bounds)).groupBy(at["x"].alias("cell_x"), at["y"].alias("cell_y")).agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("t").alias("mean_target")).orderBy(order("cell_x"), order("cell_y"))  # one row
