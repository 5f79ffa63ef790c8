"""The whole profile of a table in few passes: rows are read for the columns' moments, for one table of counted values, and for segments; all else comes from the counted values.

The table of counted values has a row for each column and distinct value: how many rows have it, and how many of them in each class of the target. It is kept in range
partitions of (column, value), so places, medians (over all rows and by class), ranks and trends are sums within partitions, shifted by the sums of those before.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.functions.lineage import range_parts
from marlpit.functions.ranks import around
from marlpit.functions.semantics import family, safe_div
from marlpit.operators import profile as pr

#: More classes than these make a target that is not compared by class; categories with more values are not tabulated against it.
MAX_CLASSES, MAX_LEVELS = 50, 50
HISTOGRAM_BINS, DENSITY_BINS, DENSITY_POINTS, MARGIN, TOP = 12, 80, 80, 0.08, 10
WHOLE = ("byte", "short", "integer", "long")
#: Roles of columns that are described but not compared.
SET_ASIDE = ("identifier", "timestamp", "period_id", "ignored")
#: Roles that make a category of a column of numbers, and distinct values that a measure has more of.
CATEGORICAL_ROLES, MEASURE_VALUES = ("feature_categorical", "feature_ordinal", "boolean", "text"), 12
SEGMENT_LEVELS = (2, 12)


@dataclass(frozen=True)
class Plan:
    """What is compared with what: numbers and categories are features, classes those of a categorical target."""

    numbers: list[str]
    categories: list[str]
    segments: list[str]
    classes: list[str]


def moments(df: DataFrame) -> list[dict]:
    """A row for each column: column_name, count, missing, minimum, maximum, mean, standard_deviation; one aggregate."""
    parts = []
    for c in df.columns:
        x = F.col(c).cast("double") if family(df.schema[c].dataType) == "number" else F.lit(None).cast("double")
        stats = (F.min(x).alias("minimum"), F.max(x).alias("maximum"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("standard_deviation"))
        parts.append(F.struct(F.lit(c).alias("column_name"), F.count(c).alias("count"), F.count_if(F.col(c).isNull()).alias("missing"), *stats))
    return [r["c"].asDict() for r in df.agg(F.array(*parts).alias("c")).select(F.explode("c").alias("c")).collect()]


def target_classes(df: DataFrame, target: str) -> list[str]:
    """The classes in order of their frequency; none if there are too many to compare."""
    found = df.filter(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(MAX_CLASSES + 1).collect()
    return [r.v for r in found] if len(found) <= MAX_CLASSES else []


def counted_values(df: DataFrame, target: str | None, classes: Sequence[str]) -> DataFrame:
    """column_name, value, number, n, one, c0, c1 ... (rows of each class) in range partitions.

    Rows meet by their own kind of value: whole numbers and doubles aren't written as text before they are counted."""

    def cell(c: str) -> Column:
        kind = df.schema[c].dataType
        number = F.col(c).cast("double") if family(kind) == "number" else F.lit(None).cast("double")
        whole = F.col(c).cast("long") if kind.typeName() in WHOLE else F.lit(None).cast("long")
        text = F.lit(None).cast("string") if kind.typeName() in (*WHOLE, "double") else F.col(c).cast("string")
        return F.struct(F.lit(c).alias("column_name"), number.alias("number"), whole.alias("whole"), text.alias("text"), F.col(c).isNotNull().alias("given"))

    place = F.array_position(F.array(*map(F.lit, classes)), F.col(target).cast("string")) if classes else F.lit(0)
    pairs = df.select(place.alias("t"), F.explode(F.array(*map(cell, df.columns))).alias("p")).select("t", "p.*").filter("given")
    counts = [F.count("*").alias("n"), F.lit(1).alias("one"), *[F.count_if(F.col("t") == i + 1).alias(f"c{i}") for i in range(len(classes))]]
    counted = pairs.groupBy("column_name", "number", "whole", "text").agg(*counts)
    value = F.coalesce("text", F.col("whole").cast("string"), F.col("number").cast("string"))
    counted = counted.select("column_name", value.alias("value"), "number", *[c for c in counted.columns if c not in ("column_name", "number", "whole", "text")])
    return range_parts(counted, [F.col("column_name"), F.col("number"), F.col("value")], "_part")


def class_stats(i: int, mean: Column) -> list[Column]:
    """Of the numbers of class i: n, extremes, sums of deviations from the column's mean and of their squares."""
    c, x = F.col(f"c{i}"), F.col("number")
    d = x - mean
    return [F.sum(F.when(x.isNotNull(), c)).alias(f"n{i}"), F.min(F.when(c > 0, x)).alias(f"min{i}"), F.max(F.when(c > 0, x)).alias(f"max{i}"), F.sum(c * d).alias(f"s{i}"), F.sum(c * d * d).alias(f"q{i}")]


def ordered_cells(cells: DataFrame, sums: Sequence[str]) -> DataFrame:
    """The counted values whose order matters, with what stands before them (<column>_before) and in all (<column>_all): those of range partitions that hold a median of all rows or of a class,
    and all values of columns with few. Only these are sorted; a sum for each column and partition tells which they are."""
    per = cells.groupBy("column_name", "_part").agg(*[F.sum(c).alias(c) for c in sums])
    column = Window.partitionBy("column_name")  # a row for each range partition that a column reaches into
    earlier = column.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({f"_b_{c}": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in sums} | {f"{c}_all": F.sum(c).over(column) for c in sums})
    place = lambda c: 0.5 * (F.col(f"{c}_all") - 1)
    holds = [(F.col(f"_b_{c}") <= F.ceil(place(c))) & (F.floor(place(c)) < F.col(f"_b_{c}") + F.col(c)) for c in sums if c != "one"]
    wanted = per.filter(reduce(or_, holds, F.col("one_all") <= MAX_LEVELS)).drop(*sums)
    own = Window.partitionBy("column_name", "_part").orderBy("number", "value").rowsBetween(Window.unboundedPreceding, -1)
    inside = cells.join(F.broadcast(wanted), ["column_name", "_part"])  # some for each column and class
    return inside.withColumns({f"{c}_before": F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(own), F.lit(0)) for c in sums}).drop(*[f"_b_{c}" for c in sums])


def value_summaries(cells: DataFrame, means: Mapping[str, float | None], n_classes: int, focus: int | None) -> list[dict]:
    """A row for each column: distinct values, the median's neighbours, class_stats, and what the trend of the values' ranks with the focus class needs (of columns with few values)."""
    mean = F.coalesce(*[F.when(F.col("column_name") == c, F.lit(m)) for c, m in means.items() if m is not None], F.lit(0.0))
    each = [f"c{i}" for i in range(n_classes)]
    whole = cells.groupBy("column_name").agg(F.sum("one").alias("distinct_values"), *[x for i in range(n_classes) for x in class_stats(i, mean)])
    parts = [F.max("n_all").alias("total"), *around("number", "n", 0.5, "m"), *[x for i, c in enumerate(each) for x in around("number", c, 0.5, f"m{i}")]]
    if focus is not None:
        known = [F.col(c) for c in each]
        w, k, r = sum(known[1:], known[0]).cast("double"), F.col(f"c{focus}").cast("double"), (F.col("one_before") + 1).cast("double")
        parts += [F.sum(x).alias(name) for name, x in (("w", w), ("wr", w * r), ("wrr", w * r * r), ("k", k), ("kr", k * r))]
    placed = ordered_cells(cells, ["n", "one", *each]).groupBy("column_name").agg(*parts)
    return [r.asDict() for r in whole.join(placed, "column_name").collect()]  # a row for each column


def middle(row: Mapping, name: str, total: float | None) -> float | None:
    lo, hi = row[f"{name}_lo"], row[f"{name}_hi"]
    if lo is None or lo == hi or not total:
        return lo
    place = 0.5 * (total - 1)
    return lo + (hi - lo) * (place - math.floor(place))


def chosen(df: DataFrame, columns: Mapping[str, dict], roles: Mapping[str, str], target: str | None, classes: list[str], max_features: int, max_segment_features: int) -> Plan:
    """Features by role: a column of numbers is a measure if it has more than MEASURE_VALUES distinct values and no role that makes a category of it; all others are categories."""
    free = [c for c in df.columns if c != target and roles.get(c) not in SET_ASIDE]

    def is_number(c: str) -> bool:
        return family(df.schema[c].dataType) == "number" and roles.get(c) not in CATEGORICAL_ROLES and columns[c]["distinct_values"] > MEASURE_VALUES

    features = free[:max_features]
    numbers = [c for c in features if is_number(c)]
    categories = [c for c in features if c not in numbers and columns[c]["distinct_values"] <= MAX_LEVELS]
    low, high = SEGMENT_LEVELS
    return Plan(numbers, categories, [c for c in free if low <= columns[c]["distinct_values"] <= high][:max_segment_features], classes)


def bounded(cells: DataFrame, columns: Mapping[str, dict], names: Sequence[str], bins: int) -> DataFrame:
    """The numbers of columns with lo, hi and bin; a constant column has one bin."""
    rows = [(c, columns[c]["minimum"], columns[c]["maximum"]) for c in names if columns[c]["minimum"] is not None]
    bounds = cells.sparkSession.createDataFrame(rows, "column_name string, lo double, hi double")
    inside = cells.filter("number IS NOT NULL AND NOT isnan(number)").join(F.broadcast(bounds), "column_name")  # a row for each column
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("number") - F.col("lo")) / F.nullif(width, F.lit(0.0))))).otherwise(0).cast("int")
    return inside.withColumn("bin", at)


def histograms(cells: DataFrame, columns: Mapping[str, dict], names: Sequence[str], bins: int = HISTOGRAM_BINS) -> DataFrame:
    """column_name, bin, lower, upper, n over equal widths of each column; the last bin is closed and empty bins are there."""
    counted = bounded(cells, columns, names, bins).groupBy("column_name", "bin").agg(F.sum("n").alias("n"))
    grid = []
    for c in names:
        lo, hi = columns[c]["minimum"], columns[c]["maximum"]
        if lo is not None:
            width, last = (hi - lo) / bins, bins - 1 if hi > lo else 0
            grid += [(c, b, lo + width * b, hi if b == bins - 1 else lo + width * (b + 1)) for b in range(last + 1)]
    grid = cells.sparkSession.createDataFrame(grid, "column_name string, bin int, lower double, upper double")
    return grid.join(F.broadcast(counted), ["column_name", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))  # bins of the columns


def densities(cells: DataFrame, columns: Mapping[str, dict], names: Sequence[str], groups: Sequence[tuple]) -> DataFrame:
    """column_name, grp, k, x, density: Gaussian kernel estimates by class from counts in bins; groups: (column, number of the class, class, n, sd)."""
    spark = cells.sparkSession
    classes = sorted({(i, g) for _, i, g, *_ in groups})
    counted = F.array(*[F.struct(F.lit(g).alias("grp"), F.sum(f"c{i}").alias("c")) for i, g in classes])
    binned = bounded(cells, columns, names, DENSITY_BINS).filter("hi > lo").groupBy("column_name", "bin", "lo", "hi").agg(counted.alias("x"))
    binned = binned.select("column_name", "bin", "lo", "hi", F.explode("x").alias("x")).select("column_name", "bin", "lo", "hi", "x.*").filter("c > 0")
    stats = spark.createDataFrame([(c, g, n, sd) for c, _, g, n, sd in groups if n > 1 and sd], "column_name string, grp string, n long, sd double")
    span = F.col("hi") - F.col("lo")
    h = F.greatest(1.06 * F.col("sd") * F.pow(F.col("n"), F.lit(-0.2)), span / 18)
    own = binned.join(F.broadcast(stats), ["column_name", "grp"]).withColumn("h", h).withColumn("mid", F.col("lo") + span / DENSITY_BINS * (F.col("bin") + 0.5))  # a row for each column and class
    start, step = F.col("lo") - MARGIN * span, span * (1 + 2 * MARGIN) / (DENSITY_POINTS - 1)
    own = own.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(DENSITY_POINTS - 1)))).withColumn("x", start + step * F.col("k"))
    z = (F.col("x") - F.col("mid")) / F.col("h")
    weight = F.col("c") * F.exp(-0.5 * z * z) / (F.col("n") * F.col("h") * F.sqrt(2 * F.pi()))
    return own.groupBy("column_name", "grp", "k").agg(F.first("x").alias("x"), F.sum(weight).alias("density"))


def contingencies(cells: DataFrame, names: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """column_name, a (value), b (class), n, row_share, expected, lift, residual, and of each table chi2, dof, cramers_v, sparse_share; MAX_LEVELS by MAX_CLASSES cells a column at most."""
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("b"), F.col(f"c{i}").alias("n")) for i, g in enumerate(classes)]))
    grid = cells.filter(F.col("column_name").isin(list(names))).select("column_name", F.col("value").alias("a"), each.alias("x")).select("column_name", "a", "x.*")
    table, row, column = (Window.partitionBy(*k) for k in (["column_name"], ["column_name", "a"], ["column_name", "b"]))  # small tables
    grid = grid.withColumn("na", F.sum("n").over(row)).withColumn("nb", F.sum("n").over(column)).withColumn("total", F.sum("n").over(table)).filter("na > 0 AND nb > 0")
    grid = grid.withColumn("expected", F.col("na") * F.col("nb") / F.col("total")).withColumn("residual", (F.col("n") - F.col("expected")) / F.sqrt("expected"))
    ra, rb = F.size(F.collect_set("a").over(table)), F.size(F.collect_set("b").over(table))
    grid = grid.withColumn("chi2", F.sum(F.col("residual") ** 2).over(table)).withColumn("dof", (ra - 1) * (rb - 1)).withColumn("m", F.least(ra, rb) - 1)
    return grid.select(
        "column_name", "a", "b", "n", (F.col("n") / F.col("na")).alias("row_share"), "expected", (F.col("n") / F.col("expected")).alias("lift"), "residual", "chi2", "dof",
        F.sqrt(safe_div(F.col("chi2"), F.col("total") * F.col("m"))).alias("cramers_v"), F.avg(F.when(F.col("expected") < 5, 1.0).otherwise(0.0)).over(table).alias("sparse_share"),
    )


def top_values(cells: DataFrame, columns: Mapping[str, dict], n: int = TOP) -> DataFrame:
    """column_name, value, n, share, place of the n most frequent values of each column; tasks keep n of a column each before these meet."""
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))
    one = next(iter(columns.values()))
    found = cells.select("column_name", "value", "n").withColumn("place", place).filter(F.col("place") <= n)
    return found.withColumn("share", F.col("n") / F.lit(max(1, one["count"] + one["missing"])))


def group_rows(columns: Mapping[str, dict], summaries: Mapping[str, dict], plan: Plan, rows: int) -> list[tuple]:
    """(column, number of the class, class, n, minimum, maximum, median, mean, sd, score) of classes with 3 % of a column's rows or more, where there are two or more."""
    out = []
    for c in plan.numbers:
        s, mean, own = summaries[c], columns[c]["mean"] or 0.0, []
        total = sum(s[f"n{i}"] or 0 for i in range(len(plan.classes)))
        for i, g in enumerate(plan.classes):
            n = s[f"n{i}"] or 0
            if n >= max(3, 0.03 * total):
                sd = math.sqrt(max(0.0, s[f"q{i}"] - s[f"s{i}"] ** 2 / n) / (n - 1))
                own.append((c, i, g, n, s[f"min{i}"], s[f"max{i}"], middle(s, f"m{i}", n), mean + s[f"s{i}"] / n, sd))
        # the deviation over the rows of all classes
        q, d = (sum(s[f"{x}{i}"] or 0.0 for i in range(len(plan.classes))) for x in "qs")
        sd_all = math.sqrt(max(0.0, q - d * d / total) / (total - 1)) if total > 1 else 0.0
        if 2 <= len(own) <= MAX_CLASSES:
            means = [x[7] for x in own]
            out += [(*x, (max(means) - min(means)) / (4 * sd_all) if sd_all else None) for x in own]
    return out


def trend_rows(summaries: Mapping[str, dict], names: Sequence[str]) -> list[tuple]:
    """(column, n, levels, trend): the correlation of the values' ranks with the focus class, over rows that have a class."""
    out = []
    for c in names:
        s = summaries.get(c)
        if s and s.get("w"):
            n = s["w"]
            cov, vr, vk = s["kr"] / n - s["wr"] / n * s["k"] / n, s["wrr"] / n - (s["wr"] / n) ** 2, s["k"] / n - (s["k"] / n) ** 2
            out.append((c, int(n), s["distinct_values"], cov / math.sqrt(vr * vk) if vr > 0 and vk > 0 else None))
    return out


def full_profile(
    df: DataFrame, target: str | None = None, target_type: str | None = None, focus: str | None = None, roles: Mapping[str, str] | None = None, max_features: int = 30, max_segment_features: int = 4,
    parts: Collection[str] | None = None,
) -> dict[str, DataFrame]:
    """Every part of the profile: columns, notes, dataset_notes, target_types, top_values, histograms; with a target the relations of up to max_features features with it and segments.

    target_type (categorical or continuous) is inferred if it isn't given; focus is the class whose rate segments and trends look at, the most frequent one if it isn't given.
    A categorical target is compared by class: groups and densities of numbers, contingencies and trends of categories. A continuous one gives relations with numbers (relations) and
    the target's groups by categories (groups), all features together. What reaches the driver is a row for each column with some numbers for each class.
    parts: those of a continuous target to compute (relations, groups, segments), each of which reads all rows again; all unless they are named."""
    spark, roles = df.sparkSession, dict(roles or {})
    with ThreadPoolExecutor(1) as other:  # the moments and the counted values don't need each other
        found = other.submit(moments, df)
        classes = target_classes(df, target) if target and target_type != "continuous" else []
        if classes and target_type is None and family(df.schema[target].dataType) == "number":
            given = next(r["count"] for r in found.result() if r["column_name"] == target)
            classes = classes if len(classes) <= max(2, min(20.0, max(5.0, 0.05 * given))) else []
        at = classes.index(focus) if focus in classes else (0 if classes else None)
        cells = counted_values(df, target, classes)
        columns = {r["column_name"]: r for r in found.result()}
    rows = next(iter(columns.values()))["count"] + next(iter(columns.values()))["missing"]
    summaries = {r["column_name"]: r for r in value_summaries(cells, {c: r["mean"] for c, r in columns.items()}, len(classes), at)}
    for c, r in columns.items():
        s = summaries.get(c, {})
        r["distinct_values"], r["median"] = s.get("distinct_values", 0), middle(s, "m", s["total"]) if s else None
        r["missing_rate"] = r["missing"] / rows if rows else None
        r["distinct_rate"] = r["distinct_values"] / r["count"] if r["count"] else None
    plan = chosen(df, columns, roles, target, classes, max_features, max_segment_features)
    kinds = "column_name string, count long, missing long, minimum double, maximum double, mean double, standard_deviation double, distinct_values long, median double, missing_rate double, distinct_rate double"
    found = spark.createDataFrame([tuple(r[x.split()[0]] for x in kinds.split(", ")) for r in columns.values()], kinds)
    all_numbers = [c for c in df.columns if family(df.schema[c].dataType) == "number"]
    out = {
        "columns": found,
        "notes": pr.column_notes(found, [c for c, r in roles.items() if r == "ignored"], [c for c, r in roles.items() if r in ("feature_categorical", "text")]),
        "dataset_notes": pr.dataset_notes(found, rows),
        "target_types": spark.createDataFrame([(c, "continuous" if c in all_numbers and r["distinct_values"] > max(2, min(20.0, max(5.0, 0.05 * r["count"]))) else "categorical") for c, r in columns.items()], "column_name string, target_type string"),
        "top_values": top_values(cells, columns),
        "histograms": histograms(cells, columns, all_numbers),
    }
    if classes:
        groups = group_rows(columns, summaries, plan, rows)
        out["groups"] = spark.createDataFrame([(c, g, *x) for c, _, g, *x in groups], "column_name string, grp string, n long, minimum double, maximum double, median double, mean double, sd double, score double")
        if groups:
            out["densities"] = densities(cells, columns, plan.numbers, [(c, i, g, n, sd) for c, i, g, n, _, _, _, _, sd, _ in groups])
        out["contingencies"] = contingencies(cells, plan.categories, classes)
        out["trends"] = spark.createDataFrame(trend_rows(summaries, plan.categories), "column_name string, n long, levels long, trend double")
        if len(plan.segments) >= 2:
            out["segments"] = pr.segment_scan_categorical(df, plan.segments, target, classes[at])
    elif target and family(df.schema[target].dataType) == "number":
        if plan.numbers and (parts is None or "relations" in parts):
            out["relations"] = pr.numeric_relations(df, plan.numbers, target)
        if plan.categories and (parts is None or "groups" in parts):
            out["groups"] = pr.grouped_relations(df, plan.categories, target)
        if len(plan.segments) >= 2 and (parts is None or "segments" in parts):
            out["segments"] = pr.segment_scan_continuous(df, plan.segments, target)
    return out
