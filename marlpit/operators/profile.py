"""Descriptive profile of a whole table: columns, values, histograms, relations, densities, contingency, segments."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.functions.lineage import pinned
from marlpit.functions.ranks import picked, placed, with_quantiles
from marlpit.functions.semantics import family, safe_corr, safe_div


#: Groups that a chart tells apart and values on either side of a contingency table at most; more are refused.
MAX_GROUPS, MAX_VALUES = 100, 1000


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, distinct_values: one pass over (column, value) pairs, each counted once."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns]))
    pairs = df.select(cells.alias("p")).select("p.*").filter("v IS NOT NULL").groupBy("column_name", "v").agg(F.lit(1).alias("one"))
    return pairs.groupBy("column_name").agg(F.count("*").alias("distinct_values"))


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, exact_distinct: bool = True) -> DataFrame:
    """A row per column: count, missing, missing_rate, distinct_values, distinct_rate; of numbers minimum, maximum, mean, median and standard_deviation.
    One aggregate over one scan for all but the distinct values and medians, which come from one table of counted values of all columns."""
    columns = list(columns or df.columns)
    parts = []
    for c in columns:
        number = family(df.schema[c].dataType) == "number"
        x = F.col(c).cast("double")
        nothing = F.lit(None).cast("double")
        stats = [F.min(x), F.max(x), F.avg(x), F.stddev_samp(x)] if number else [nothing] * 4
        names = ("minimum", "maximum", "mean", "standard_deviation")
        approx = F.approx_count_distinct(c) if not exact_distinct else F.lit(None).cast("bigint")
        parts.append(F.struct(F.lit(c).alias("column_name"), F.count(c).alias("count"), F.count_if(F.col(c).isNull()).alias("missing"), approx.alias("approx"), *[s.alias(n) for s, n in zip(stats, names, strict=True)]))
    out = df.agg(F.array(*parts).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    return with_shares(with_values(out, df, columns, exact_distinct))


def value_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, value (as text), number (of numeric columns), n: every distinct value of every column with its count, nulls left out."""
    number = lambda c: F.col(c).cast("double") if family(df.schema[c].dataType) == "number" else F.lit(None).cast("double")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"), number(c).alias("number")) for c in columns]))
    return df.select(cells.alias("p")).select("p.*").filter("value IS NOT NULL").groupBy("column_name", "value", "number").agg(F.count("*").alias("n"))


def with_values(out: DataFrame, df: DataFrame, columns: Sequence[str], exact_distinct: bool) -> DataFrame:
    """Statistics of columns with their median and distinct_values."""
    some = columns if exact_distinct else [c for c in columns if family(df.schema[c].dataType) == "number"]
    if some:
        cells = placed(value_cells(df, some), ["column_name"], [F.col("number"), F.col("value")], ["n"])
        found = picked(cells, ["column_name"], "number", "n", [0.5], "q", F.count("*").alias("values"))
        out = out.join(found, "column_name", "left").withColumn("median", F.get("q", F.lit(0))).withColumn("distinct_values", F.coalesce("values", F.lit(0))).drop("q", "values")
    else:
        out = out.withColumn("median", F.lit(None).cast("double"))
    return out if exact_distinct else out.withColumn("distinct_values", F.col("approx"))


def with_shares(out: DataFrame) -> DataFrame:
    """Statistics of columns with missing_rate and distinct_rate."""
    out = out.withColumn("missing_rate", safe_div(F.col("missing"), F.col("count") + F.col("missing")))
    return out.withColumn("distinct_rate", safe_div(F.col("distinct_values"), F.col("count"))).drop("approx")


def top_values(df: DataFrame, columns: Sequence[str], n: int = 10) -> DataFrame:
    """The n most frequent values of each column (ties by text) with their share of all rows: one pass over (column, value) pairs. Tasks keep n values of a column each before these meet."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]))
    counted = df.select(cells.alias("p")).select("p.*").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))
    ranked = counted.filter("value IS NOT NULL").withColumn("place", place).filter(F.col("place") <= n)
    return ranked.crossJoin(F.broadcast(df.agg(F.count("*").alias("rows")))).withColumn("share", F.col("n") / F.col("rows")).drop("rows")  # one row


def column_notes(profile: DataFrame, ignored: Sequence[str] = (), text_columns: Sequence[str] = ()) -> DataFrame:
    """column_name, note: what the profile says of a column."""
    c = F.col
    rules = [
        (c("missing_rate") >= 0.3, "many missing values"),
        (c("distinct_rate") >= 0.95, "nearly unique"),
        (c("distinct_values") == 1, "constant"),
        (c("column_name").isin(list(ignored)), "ignored"),
        (c("column_name").isin(list(text_columns)) & (c("distinct_values") > 50), "many categories"),
    ]
    notes = F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in rules]))
    return profile.select("column_name", F.explode(notes).alias("note"))


def dataset_notes(profile: DataFrame, n_rows: int) -> DataFrame:
    """One row: columns, columns with missing values, constant columns, share of missing cells, small or not."""
    cells = F.sum(F.col("count") + F.col("missing"))
    return profile.agg(
        F.count("*").alias("columns"), F.count_if(F.col("missing") > 0).alias("columns_with_missing"), F.count_if(F.col("distinct_values") == 1).alias("constant_columns"),
        safe_div(F.sum("missing"), cells).alias("missing_share"), F.lit(n_rows < 30).alias("small_sample"),
    )


def small(groups: DataFrame, most: int, what: str) -> DataFrame:
    """Distinct values, pinned, unless there are more than a table or chart can show."""
    groups = pinned(groups.limit(most + 1))
    if groups.count() > most:
        raise ValueError(f"more than {most} {what}")
    return groups


def histogram(df: DataFrame, column: str, bins: int = 12, groups: Sequence[str] = ()) -> DataFrame:
    """bin, lower, upper, n over equal widths; the last bin is closed and empty bins are there; a constant column has one bin. More than MAX_GROUPS groups are refused."""
    x = F.col(column).cast("double")
    given = df.filter(x.isNotNull() & ~F.isnan(x)).select(x.alias("x"), *groups)
    bounds = given.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    where = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / F.nullif(width, F.lit(0.0))))).otherwise(0)
    counted = given.crossJoin(F.broadcast(bounds)).groupBy(where.cast("int").alias("bin"), *groups).agg(F.count("*").alias("n"))  # one row of bounds
    grid = bounds.withColumn("bin", F.explode(F.when(F.col("hi") > F.col("lo"), F.sequence(F.lit(0), F.lit(bins - 1))).otherwise(F.array(F.lit(0)))))
    edge = lambda k: F.col("lo") + width * k
    if groups:
        grid = grid.crossJoin(F.broadcast(small(counted.select(*groups).distinct(), MAX_GROUPS, "groups")))
    out = grid.join(counted, ["bin", *groups], "left")
    return out.select("bin", *groups, edge(F.col("bin")).alias("lower"), F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(edge(F.col("bin") + 1)).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"))


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """column value, rank (ties share their mean rank): ranks of distinct values from running counts, so rows aren't sorted in one task."""
    ranked = placed(df.groupBy(column).agg(F.count("*").alias("_n")), [], [F.col(column)], ["_n"])
    return ranked.select(F.col(column), (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(name))


def _pairs_with(df: DataFrame, features: Sequence[str], target: str, kind: str) -> DataFrame:
    """feature, x, y for each feature of a row, where both are given."""
    given = lambda c: c.isNotNull() & ~F.isnan(c) if kind == "double" else c.isNotNull()
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("x")) for c in features]))
    rows = df.select(F.col(target).cast("double").alias("y"), cells.alias("c")).select("c.feature", "c.x", "y")
    return rows.filter(given(F.col("x")) & F.col("y").isNotNull() & ~F.isnan("y"))


def numeric_relations(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """feature, n, pearson, spearman, covariance, slope, intercept, r2, score for each feature with three pairs or more.

    All features share one pass over the rows for their counted pairs, one table of ranks by feature, side and value, and one join of it back to the counts; moments come from another
    aggregate of the rows, so the number of jobs doesn't grow with the features."""
    pairs = _pairs_with(df, features, target, "double")
    main = pairs.groupBy("feature").agg(
        F.count("*").alias("n"), safe_corr(F.col("x"), F.col("y")).alias("pearson"), F.covar_samp("x", "y").alias("covariance"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept")
    )
    counted = pinned(pairs.groupBy("feature", "x", "y").agg(F.count("*").alias("w")))
    sides = F.explode(F.array(F.struct(F.lit("x").alias("side"), F.col("x").alias("v")), F.struct(F.lit("y").alias("side"), F.col("y").alias("v"))))
    values = counted.select("feature", "w", sides.alias("b")).groupBy("feature", "b.side", "b.v").agg(F.sum("w").alias("k"))
    ranks = placed(values, ["feature", "side"], [F.col("v")], ["k"]).select("feature", "side", "v", (F.col("k_before") + (F.col("k") + 1) / 2).alias("r"))
    rx, ry = (ranks.filter(F.col("side") == s).select("feature", F.col("v").alias(s), F.col("r").alias(f"r{s}")) for s in "xy")
    cells = counted.join(rx, ["feature", "x"]).join(ry, ["feature", "y"])
    n, mx, my = F.sum("w"), F.sum(F.col("w") * F.col("rx")), F.sum(F.col("w") * F.col("ry"))
    sxy, sxx, syy = F.sum(F.col("w") * F.col("rx") * F.col("ry")), F.sum(F.col("w") * F.col("rx") ** 2), F.sum(F.col("w") * F.col("ry") ** 2)
    rank = cells.groupBy("feature").agg(safe_div(sxy - mx * my / n, F.sqrt(sxx - mx * mx / n) * F.sqrt(syy - my * my / n)).alias("spearman"))
    both = main.join(rank, "feature").filter("n >= 3")
    return both.withColumn("r2", F.col("pearson") ** 2).withColumn("score", F.abs("pearson"))


def numeric_relation(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, pearson, spearman, covariance, slope, intercept, r2, score; none for fewer than three pairs."""
    return numeric_relations(df, [x], y).drop("feature")


def grouped_relations(df: DataFrame, groups: Sequence[str], number: str) -> DataFrame:
    """feature, grp and, for groups with max(3, 3 %) of a feature's rows or more: n, minimum, maximum, median, mean, sd, and the score of the relation, |range of means| / (4 sd).
    Features without 2 to 50 such groups are left out. All features share each pass."""
    given = _pairs_with(df, groups, number, "string").withColumnsRenamed({"x": "grp", "y": "v"})
    per = given.groupBy("feature", "grp").agg(
        F.count("*").alias("n"), F.min("v").alias("minimum"), F.max("v").alias("maximum"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd")
    )
    total = given.groupBy("feature").agg(F.count("*").alias("rows"), F.stddev_samp("v").alias("sd_all"))
    kept = per.join(F.broadcast(total), "feature").filter(F.col("n") >= F.greatest(F.lit(3.0), 0.03 * F.col("rows")))  # a row for each feature
    kept = pinned(kept)  # 33 groups of a feature at most
    few = given.join(F.broadcast(kept.select("feature", "grp")), ["feature", "grp"])
    kept = with_quantiles(kept, few, ["feature", "grp"], "v", {"median": 0.5})
    whole = Window.partitionBy("feature")
    kept = kept.withColumn("score", safe_div(F.max("mean").over(whole) - F.min("mean").over(whole), 4 * F.col("sd_all"))).withColumn("groups", F.count("*").over(whole))
    return kept.filter(F.col("groups").between(2, 50)).select("feature", "grp", "n", "minimum", "maximum", "median", "mean", "sd", "score")


def grouped_relation(df: DataFrame, group: str, number: str) -> DataFrame:
    """grouped_relations of one feature."""
    return grouped_relations(df, [group], number).drop("feature")


def density(df: DataFrame, number: str, group: str | None = None, bins: int = 80, points: int = 80, margin: float = 0.08, floor_share: float | None = 1 / 18) -> DataFrame:
    """grp, x, density: a Gaussian kernel estimate from counts in bins. The bandwidth is 1.06 sd n^-0.2 of the group, and a share of the range at least.
    Rows meet only as counts: groups x bins of them against the grid of points. More than MAX_GROUPS groups are refused."""
    v = F.col(number).cast("double")
    given = df.select((F.col(group).cast("string") if group else F.lit("all")).alias("grp"), v.alias("v")).filter("grp IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)")
    bounds = given.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / F.nullif(width, F.lit(0.0)))).cast("int")
    binned = given.crossJoin(F.broadcast(bounds)).filter("hi > lo").groupBy("grp", at.alias("bin")).agg(F.count("*").alias("c"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))  # one row of bounds
    stats = small(given.groupBy("grp").agg(F.count("*").alias("n"), F.stddev_samp("v").alias("sd")), MAX_GROUPS, "groups").filter("n > 1 AND sd > 0")
    span = F.col("hi") - F.col("lo")
    silverman = 1.06 * F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))
    h = F.greatest(silverman, span * floor_share) if floor_share else silverman
    cells = binned.join(F.broadcast(stats), "grp").withColumn("h", h).withColumn("mid", F.col("lo") + width * (F.col("bin") + 0.5))  # one row for each group of the chart
    start, step = F.col("lo") - margin * span, span * (1 + 2 * margin) / (points - 1)
    cells = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", start + step * F.col("k"))
    z = (F.col("x") - F.col("mid")) / F.col("h")
    weight = F.col("c") * F.exp(-0.5 * z * z) / (F.col("n") * F.col("h") * F.sqrt(2 * F.pi()))
    return cells.groupBy("grp", "k").agg(F.first("x").alias("x"), F.sum(weight).alias("density")).select("grp", "k", "x", "density")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """A row per pair of values, pairs that never occur among them: n, row_share, expected, lift, residual; and of the table chi2, dof, cramers_v, sparse_share.
    Sides with more than MAX_VALUES values are refused."""
    given = df.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    cells = pinned(given.groupBy("a", "b").agg(F.count("*").alias("n")))
    rows = small(cells.groupBy("a").agg(F.sum("n").alias("na")), MAX_VALUES, f"values of {a}")
    cols = small(cells.groupBy("b").agg(F.sum("n").alias("nb")), MAX_VALUES, f"values of {b}")
    total, ra, rb = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], rows.count(), cols.count()
    grid = rows.crossJoin(F.broadcast(cols)).join(cells, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))  # MAX_VALUES on either side
    grid = grid.withColumn("expected", F.col("na") * F.col("nb") / F.lit(total))
    grid = grid.withColumn("residual", (F.col("n") - F.col("expected")) / F.sqrt("expected")).withColumn("lift", F.col("n") / F.col("expected")).withColumn("row_share", F.col("n") / F.col("na"))
    table = grid.agg(F.sum(F.col("residual") ** 2).alias("chi2"), F.avg(F.when(F.col("expected") < 5, 1.0).otherwise(0.0)).alias("sparse_share"))
    grid = grid.crossJoin(F.broadcast(table))  # one row
    cramers = F.sqrt(safe_div(F.col("chi2"), F.lit(total) * F.lit(min(ra, rb) - 1)))
    return grid.select("a", "b", "n", "row_share", "expected", "lift", "residual", "chi2", F.lit((ra - 1) * (rb - 1)).alias("dof"), cramers.alias("cramers_v"), "sparse_share")


def ordinal_trend(df: DataFrame, column: str, focus: Column) -> DataFrame:
    """One row: correlation of the values' rank with the focus flag, weighted by rows, from one count per value."""
    per = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("w"), F.count_if(focus).alias("k"))
    ranked = placed(per.withColumn("one", F.lit(1)), [], [F.col(column)], ["one"]).withColumn("r", (F.col("one_before") + 1).cast("double"))
    w, r, k = F.col("w"), F.col("r"), F.col("k")
    n, sr, sk, srr, srk = F.sum(w), F.sum(w * r), F.sum(k), F.sum(w * r * r), F.sum(k * r)
    cov, vr, vk = srk / n - sr / n * sk / n, srr / n - (sr / n) ** 2, sk / n - (sk / n) ** 2
    return ranked.agg(n.alias("n"), F.count("*").alias("levels"), safe_div(cov, F.sqrt(vr * vk)).alias("trend"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The bounds of the Wilson interval of k successes in n."""
    p, n = safe_div(k, n), n.cast("double")
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (centre - half) / (1 + z * z / n), (centre + half) / (1 + z * z / n)


def _pairs(df: DataFrame, features: Sequence[str], measures: Sequence[Column]) -> DataFrame:
    """Aggregates for the values of every pair of features: one pass with grouping sets."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in features], *[c for c in df.columns if c.startswith("_")])
    sets = [[F.col(a), F.col(b)] for a, b in combinations(features, 2)]
    grouped = text.groupingSets(sets, *[F.col(c) for c in features]).agg(F.grouping_id().alias("_gid"), *measures)
    width = len(features)
    first = F.coalesce(*[F.when(F.shiftright("_gid", width - 1 - i).bitwiseAND(F.lit(1)) == 0, F.lit(i)) for i in range(width)])
    last = F.coalesce(*[F.when(F.shiftright("_gid", width - 1 - i).bitwiseAND(F.lit(1)) == 0, F.lit(i)) for i in reversed(range(width))])
    names, values = F.array(*[F.lit(c) for c in features]), F.array(*[F.col(c) for c in features])
    out = grouped.withColumn("feature_a", F.get(names, first)).withColumn("value_a", F.get(values, first)).withColumn("feature_b", F.get(names, last)).withColumn("value_b", F.get(values, last))
    return out.filter("value_a IS NOT NULL AND value_b IS NOT NULL").drop(*features, "_gid")


def segment_scan_categorical(df: DataFrame, features: Sequence[str], target: str, focus: str, top: int = 12) -> DataFrame:
    """The segments of two features' values that differ most from the whole in the rate of the focus class: n, rate, baseline, difference, lift, low, high, score."""
    base = df.filter(F.col(target).isNotNull()).withColumn("_hit", (F.col(target).cast("string") == focus).cast("int"))
    total = base.agg(F.count("*").alias("rows"), F.avg("_hit").alias("baseline"))
    segments = _pairs(base, features, [F.count("*").alias("n"), F.sum("_hit").alias("k")]).crossJoin(F.broadcast(total))  # one row
    segments = segments.filter(F.col("n") >= F.greatest(F.lit(5.0), 0.03 * F.col("rows"))).withColumn("rate", F.col("k") / F.col("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    out = segments.withColumn("difference", F.col("rate") - F.col("baseline")).withColumn("lift", safe_div(F.col("rate"), F.col("baseline"))).withColumn("low", low).withColumn("high", high)
    out = out.withColumn("score", F.col("n") / F.col("rows") * F.col("difference"))
    keys = ["feature_a", "value_a", "feature_b", "value_b"]
    return out.orderBy(F.desc(F.round(F.abs("score"), 9)), *keys).limit(top).select(*keys, "n", "rate", "baseline", "difference", "lift", "low", "high", "score")


def segment_scan_continuous(df: DataFrame, features: Sequence[str], target: str, top: int = 12) -> DataFrame:
    """The same for a number: mean, low and high (1.96 standard errors), effect (Cohen's d against the rest, from sums of squares), score."""
    base = df.withColumn("_y", F.col(target).cast("double")).filter("_y IS NOT NULL")
    total = base.agg(F.count("*").alias("rows"), F.sum("_y").alias("sum_all"), F.sum(F.col("_y") ** 2).alias("squares_all"))
    segments = _pairs(base, features, [F.count("*").alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") ** 2).alias("q")]).crossJoin(F.broadcast(total))  # one row
    segments = segments.filter((F.col("n") >= F.greatest(F.lit(5.0), 0.03 * F.col("rows"))) & (F.col("n") < F.col("rows") - 1))
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    rn, rs, rq = F.col("rows") - n, F.col("sum_all") - s, F.col("squares_all") - q
    ss, rss = q - s * s / n, rq - rs * rs / rn
    pooled = F.sqrt((ss + rss) / (F.col("rows") - 2))
    out = segments.withColumn("mean", s / n).withColumn("baseline", F.col("sum_all") / F.col("rows")).withColumn("effect", safe_div(s / n - rs / rn, pooled))
    error = F.sqrt(ss / (n - 1)) / F.sqrt(n)
    out = out.withColumn("low", F.col("mean") - 1.96 * error).withColumn("high", F.col("mean") + 1.96 * error).withColumn("score", n / F.col("rows") * F.col("effect"))
    keys = ["feature_a", "value_a", "feature_b", "value_b"]
    return out.orderBy(F.desc(F.round(F.abs("score"), 9)), *keys).limit(top).select(*keys, "n", "mean", "baseline", "effect", "low", "high", "score")


def infer_target_type(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, target_type: categorical or continuous."""
    present = df.agg(*[F.count(c).alias(c) for c in columns])
    cells = present.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("present")) for c in columns])).alias("p")).select("p.*")
    out = cells.join(distinct_counts(df, columns), "column_name", "left")
    numbers = [c for c in columns if family(df.schema[c].dataType) == "number"]
    few = F.coalesce("distinct_values", F.lit(0)) <= F.greatest(F.lit(2), F.least(F.lit(20.0), F.greatest(F.lit(5.0), 0.05 * F.col("present"))))
    return out.select("column_name", F.when(F.col("column_name").isin(numbers) & ~few, "continuous").otherwise("categorical").alias("target_type"))
