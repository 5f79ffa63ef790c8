"""Feature engineering: fitted on training rows by a few aggregates, applied to any rows as column expressions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml.feature import UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.functions.lineage import in_small_parts
from marlpit.functions.ranks import column_quantiles, placed
from marlpit.functions.semantics import portable_hash, safe_corr, safe_div
from marlpit.operators.charts import principal_axes, projected
from marlpit.operators.transforms import check_scalar, impute_missing, most_frequent

State = dict[str, Any]
#: Expressions in one aggregate.
AT_ONCE = 100
#: Encoded categories up to which cases are written out; more are joined.
MAX_CASES = 50


def _one_row(df: DataFrame, named: Mapping[str, Column]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    items = list(named.items())
    for at in range(0, len(items), AT_ONCE):
        out |= df.agg(*[e.alias(n) for n, e in items[at : at + AT_ONCE]]).first().asDict()
    return out


# --- numbers -----------------------------------------------------------------------------------------------------


def fit_impute(train: DataFrame, rules: Sequence[Mapping[str, Any]]) -> State:
    """Values to fill in: rules {column, method: constant|mean|median|mode, value?, add_indicator?}."""
    wanted = {r["column"]: F.avg(r["column"]) for r in rules if r["method"] == "mean"}
    found = _one_row(train, wanted) if wanted else {}
    medians = [r["column"] for r in rules if r["method"] == "median"]
    if medians:
        found |= {c: q[0] if q else None for c, q in column_quantiles(train, medians, (0.5,)).items()}
    for r in rules:
        if r["method"] == "mode":
            found[r["column"]] = most_frequent(train, r["column"])
        elif r["method"] == "constant":
            found[r["column"]] = r["value"]
    return {"fill": found, "indicators": [r["column"] for r in rules if r.get("add_indicator")]}


def apply_impute(df: DataFrame, state: State) -> DataFrame:
    return impute_missing(df, [{"column": c, "method": "fixed", "value": v, "add_indicator": c in state["indicators"]} for c, v in state["fill"].items()])


def fit_scale(train: DataFrame, columns: Sequence[str], method: str = "standard") -> State:
    """Centre and scale of each column: standard (mean, population deviation), minmax or robust (median, quartile distance)."""
    if method == "robust":
        quartiles = {c: q or (0.0, 0.0, 1.0) for c, q in column_quantiles(train, columns, (0.25, 0.5, 0.75)).items()}
        return {c: [q[1] or 0.0, q[2] - q[0] or 1.0] for c, q in quartiles.items()}
    named: dict[str, Column] = {}
    for c in columns:
        x = F.col(c).cast("double")
        named |= {"standard": {f"{c}|a": F.avg(x), f"{c}|b": F.stddev_pop(x)}, "minmax": {f"{c}|a": F.min(x), f"{c}|b": F.max(x) - F.min(x)}}[method]
    found = _one_row(train, named)
    return {c: [found[f"{c}|a"] or 0.0, found[f"{c}|b"] or 1.0] for c in columns}


def apply_scale(df: DataFrame, state: State) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(a)) / F.lit(b) for c, (a, b) in state.items()})


def fit_winsorize(train: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> State:
    return column_quantiles(train, columns, (low, high))


def apply_winsorize(df: DataFrame, state: State) -> DataFrame:
    """Values brought within the bounds. A null becomes a bound, as least and greatest pass over nulls: impute first."""
    return df.withColumns({c: F.greatest(F.least(F.col(c), F.lit(b[1])), F.lit(b[0])) for c, b in state.items()})


def math_transform(df: DataFrame, column: str, kind: str, name: str, drop: bool = False) -> DataFrame:
    """square, sqrt, exp, log, log1p, signed_log1p or abs; null outside the function's domain."""
    x = F.col(column).cast("double")
    out = {
        "square": lambda: x * x, "sqrt": lambda: F.when(x >= 0, F.sqrt(x)), "exp": lambda: F.when(x <= 709, F.exp(x)), "log": lambda: F.when(x > 0, F.log(x)),
        "log1p": lambda: F.when(x > -1, F.log1p(x)), "signed_log1p": lambda: F.signum(x) * F.log1p(F.abs(x)), "abs": lambda: F.abs(x),
    }[kind]()
    df = df.withColumn(name, out)
    return df.drop(column) if drop and name != column else df


def datetime_features(df: DataFrame, column: str, parts: Sequence[str], cyclical: bool = False) -> DataFrame:
    """year, quarter, month, day, day_of_week (Sunday 0), hour, is_weekend; with cyclical also sine and cosine of month, day of week and hour."""
    t = F.col(column)
    dow = F.dayofweek(t) - 1
    made = {"year": F.year(t), "quarter": F.quarter(t), "month": F.month(t), "day": F.dayofmonth(t), "day_of_week": dow, "hour": F.hour(t), "is_weekend": dow.isin(0, 6).cast("int")}
    out = {f"{column}__{p}": made[p].cast("int") for p in parts}
    if cyclical:
        for p, n in (("month", 12), ("day_of_week", 7), ("hour", 24)):
            if p in parts:
                out |= {f"{column}__{p}_{f}": getattr(F, f)(2 * F.pi() * made[p] / n) for f in ("sin", "cos")}
    return df.withColumns(out)


def numeric_interaction(df: DataFrame, a: str, b: str, kind: str, name: str, on_zero: str = "null") -> DataFrame:
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    ratio = safe_div(x, y)
    if on_zero == "zero":
        ratio = F.when(y == 0, 0.0).otherwise(ratio)
    return df.withColumn(name, {"add": x + y, "subtract": x - y, "multiply": x * y, "divide": ratio}[kind])


def sql_feature(df: DataFrame, name: str, text: str) -> DataFrame:
    return df.withColumn(name, check_scalar(df, text))


# --- categories --------------------------------------------------------------------------------------------------


def category_counts(train: DataFrame, column: str, max_categories: int = 500, min_frequency: int = 1) -> list[tuple[str, int]]:
    """(value, rows) of the most frequent values, ties by text. max_categories bounds what is kept of them as encoded values; others become "other" or unknown."""
    counted = train.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n"))
    return [(r.v, r.n) for r in counted.filter(F.col("n") >= min_frequency).orderBy(F.desc("n"), "v").limit(max_categories).collect()]


def fit_encode(train: DataFrame, column: str, method: str, max_categories: int = 500, min_frequency: int = 1, bins: int = 16) -> State:
    """method: one_hot, ordinal, frequency or hashing."""
    state: State = {"column": column, "method": method, "bins": bins}
    if method != "hashing":
        state["categories"] = category_counts(train, column, max_categories, min_frequency)
        state["rows"] = train.count()
    return state


def _looked_up(df: DataFrame, column: str, pairs: Sequence[tuple[str, Any]], name: str, kind: str, missing: Any) -> DataFrame:
    text = F.col(column).cast("string")
    if len(pairs) <= MAX_CASES:
        found = F.lit(None).cast(kind)
        for v, x in pairs:
            found = F.when(text == v, F.lit(x)).otherwise(found)
        return df.withColumn(name, F.coalesce(found, F.lit(missing)).cast(kind))
    side = df.sparkSession.createDataFrame(list(pairs), f"_v string, _x {kind}")
    return df.join(F.broadcast(side), text == F.col("_v"), "left").withColumn(name, F.coalesce("_x", F.lit(missing)).cast(kind)).drop("_v", "_x")  # max_categories rows


def apply_encode(df: DataFrame, state: State, handle_unknown: str = "ignore") -> DataFrame:
    """one_hot: column__0, column__1 ... and column__other; ordinal: the rank, -1 unknown; frequency: share of training rows, 0 unknown; hashing: one column per bucket.
    A null stays null in one-hot columns but other, and is unknown elsewhere. handle_unknown="error" refuses values that training rows didn't have."""
    c, text = state["column"], F.col(state["column"]).cast("string")
    if state["method"] == "hashing":
        bucket = F.pmod(portable_hash(text), F.lit(state["bins"]))
        return df.withColumns({f"{c}__hash_{i}": F.when(text.isNotNull(), (bucket == i).cast("int")).otherwise(0) for i in range(state["bins"])})
    known = [v for v, _ in state["categories"]]
    if handle_unknown == "error":
        side = df.sparkSession.createDataFrame([(v,) for v in known], "_v string")
        strange = df.filter(text.isNotNull()).join(F.broadcast(side), text == F.col("_v"), "left_anti").limit(1).count()
        if strange:
            raise ValueError(f"{c} has values that training rows don't have")
    if state["method"] == "one_hot":
        made = {f"{c}__{i}": (text == v).cast("int") for i, v in enumerate(known)}
        return df.withColumns(made | {f"{c}__other": F.coalesce((~text.isin(known)).cast("int"), F.lit(0))})
    if state["method"] == "ordinal":
        return _looked_up(df, c, [(v, i) for i, v in enumerate(known)], f"{c}__ordinal", "int", -1)
    return _looked_up(df, c, [(v, n / state["rows"]) for v, n in state["categories"]], f"{c}__frequency", "double", 0.0)


#: Classes that a target encoding makes columns for at most.
MAX_TARGET_CLASSES = 100


def target_series(train: DataFrame, target: str, task: str) -> dict[str, Column]:
    """What is averaged, by the ending of the column's name: the target as a number, or for classes whether a row has the class, one series each; of two classes the last one, without an ending."""
    if task == "regression":
        return {"": F.col(target).cast("double")}
    found = train.filter(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("c")).distinct().orderBy("c").limit(MAX_TARGET_CLASSES + 1).collect()
    if len(found) > MAX_TARGET_CLASSES:
        raise ValueError(f"{target} has more than {MAX_TARGET_CLASSES} classes")
    hits = {f"_{r['c']}": (F.col(target).cast("string") == r["c"]).cast("double") for r in found}
    return {"": list(hits.values())[-1]} if len(hits) == 2 else hits


def target_mean_tables(train: DataFrame, column: str, series: Sequence[Column], fold: str) -> tuple[DataFrame, list[float]]:
    """(v, f, n, s_0, s_1 ...: rows and sum of each series by value and fold; the mean of each series), each in one aggregate."""
    y = [c.alias(f"y_{i}") for i, c in enumerate(series)]
    rows = train.select(F.coalesce(F.col(column).cast("string"), F.lit("__null__")).alias("v"), F.col(fold).alias("f"), *y)
    prior = rows.agg(*[F.avg(f"y_{i}") for i in range(len(y))]).first()
    return rows.groupBy("v", "f").agg(F.count("y_0").alias("n"), *[F.sum(f"y_{i}").alias(f"s_{i}") for i in range(len(y))]), list(prior)


def encode_target_mean(train: DataFrame, others: DataFrame, column: str, target: str, fold: str, smoothing: float = 10.0, task: str = "regression") -> tuple[DataFrame, DataFrame]:
    """(training rows, others) with column__target, or for more than two classes column__target_<class> each: (sum + smoothing * prior) / (n + smoothing) of the value;
    of training rows without those of their own fold. All series come from the same sums by value and fold."""
    series = target_series(train, target, task)
    per, prior = target_mean_tables(train, column, list(series.values()), fold)
    sums = ["n", *[f"s_{i}" for i in range(len(series))]]
    whole = Window.partitionBy("v")  # a row per fold
    per = per.withColumns({f"rest_{c}": F.sum(c).over(whole) - F.col(c) for c in sums})
    value = F.coalesce(F.col(column).cast("string"), F.lit("__null__"))

    def smoothed(rows: DataFrame, before: str) -> DataFrame:
        n = F.coalesce(F.col(f"{before}n"), F.lit(0))
        rows = rows.withColumns({f"{column}__target{end}": (F.coalesce(F.col(f"{before}s_{i}"), F.lit(0.0)) + smoothing * prior[i]) / (n + smoothing) for i, end in enumerate(series)})
        return rows.drop("_v", "_v2", "_f2", *[f"{before}{c}" for c in sums])

    side = per.select(F.col("v").alias("_v2"), F.col("f").alias("_f2"), *[F.col(f"rest_{c}").alias(f"_rest_{c}") for c in sums])
    inside = train.withColumn("_v", value).join(side, (F.col("_v") == F.col("_v2")) & (F.col(fold) == F.col("_f2")), "left")
    total = per.groupBy(F.col("v").alias("_v2")).agg(*[F.sum(c).alias(f"_all_{c}") for c in sums])
    outside = others.withColumn("_v", value).join(total, F.col("_v") == F.col("_v2"), "left")
    return smoothed(inside, "_rest_"), smoothed(outside, "_all_")


def encode_ordered_target(train: DataFrame, column: str, target: str, key: str, seed: int = 0, smoothing: float = 1.0, task: str = "regression") -> DataFrame:
    """column__ordered, or for more than two classes column__ordered_<class> each: the smoothed mean over the rows of the same value that come before in a hashed order of key.
    The order is made once for all series."""
    series = target_series(train, target, task)
    ys = list(series.values())
    prior = train.agg(*[F.avg(y) for y in ys]).first()
    h = portable_hash(F.col(key), F.lit(seed))
    names = [f"_y_{i}" for i in range(len(ys))]
    rows = train.withColumns({"_v": F.coalesce(F.col(column).cast("string"), F.lit("__null__")), "_k": ys[0].isNotNull().cast("int")} | {c: F.coalesce(y, F.lit(0.0)) for c, y in zip(names, ys, strict=True)})
    rows = placed(rows, ["_v"], [h, F.col(key)], [*names, "_k"])
    rows = rows.withColumns({f"{column}__ordered{end}": (F.col(f"_y_{i}_before") + smoothing * prior[i]) / (F.col("_k_before") + smoothing) for i, end in enumerate(series)})
    return rows.drop("_v", "_k", *names, *[f"{c}_{x}" for c in [*names, "_k"] for x in ("before", "all")])


# --- selection ---------------------------------------------------------------------------------------------------


def variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, variance (of the population)."""
    cells = [F.struct(F.lit(c).alias("feature"), F.var_pop(F.col(c).cast("double")).alias("variance")) for c in columns]
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def variance_filter(df: DataFrame, columns: Sequence[str], threshold: float = 0.0) -> DataFrame:
    gone = [r.feature for r in variances(df, columns).collect() if r.variance is None or r.variance <= threshold]  # a row per feature
    return df.drop(*gone)


def f_scores(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """feature, score: the F statistic between classes against that within them, from class sums."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns]))
    long = df.filter(F.col(target).isNotNull()).select(F.col(target).alias("y"), cells.alias("p")).select("y", "p.*").filter("x IS NOT NULL")
    centre = long.groupBy("feature").agg(F.avg("x").alias("m"))
    per = long.join(F.broadcast(centre), "feature").groupBy("feature", "y").agg(F.count("*").alias("n"), F.sum(F.col("x") - F.col("m")).alias("s"), F.sum((F.col("x") - F.col("m")) ** 2).alias("q"))  # a row per feature
    n, k = F.sum("n"), F.count("*")
    between = F.sum(F.col("s") ** 2 / F.col("n")) - F.sum("s") ** 2 / n
    within = F.sum(F.col("q")) - F.sum(F.col("s") ** 2 / F.col("n"))
    return per.groupBy("feature").agg(safe_div(between / (k - 1), within / (n - k)).alias("score"))


def chi2_scores(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """feature, score: chi square of class sums of the values, shifted to a minimum of 0, against those expected by class size."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns]))
    long = df.filter(F.col(target).isNotNull()).select(F.col(target).alias("y"), cells.alias("p")).select("y", "p.*").filter("x IS NOT NULL")
    low = long.groupBy("feature").agg(F.min("x").alias("low"))
    per = long.join(F.broadcast(low), "feature").groupBy("feature", "y").agg(F.sum(F.col("x") - F.least("low", F.lit(0.0))).alias("o"), F.count("*").alias("n"))  # a row per feature
    w = Window.partitionBy("feature")
    per = per.withColumn("e", F.sum("o").over(w) * F.col("n") / F.sum("n").over(w))
    return per.groupBy("feature").agg(F.sum(safe_div((F.col("o") - F.col("e")) ** 2, F.col("e"))).alias("score"))


def mutual_information(df: DataFrame, columns: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """feature, score in nats between the target and the feature cut at its exact quantiles; a missing value is a bin of its own."""
    cuts = column_quantiles(df, columns, [i / bins for i in range(1, bins)])
    above = lambda c: sum((F.when(F.col(c) > v, 1).otherwise(0) for v in sorted(set(cuts[c] or []))), F.lit(0))
    cells = [F.struct(F.lit(c).alias("feature"), F.when(F.col(c).isNotNull(), above(c)).alias("b")) for c in columns]
    joint = df.filter(F.col(target).isNotNull()).select(F.col(target).alias("y"), F.explode(F.array(*cells)).alias("p")).groupBy("p.feature", "p.b", "y").agg(F.count("*").alias("n"))
    f, b, y = Window.partitionBy("feature"), Window.partitionBy("feature", "b"), Window.partitionBy("feature", "y")
    joint = joint.withColumn("t", F.sum("n").over(f)).withColumn("nb", F.sum("n").over(b)).withColumn("ny", F.sum("n").over(y))
    return joint.groupBy("feature").agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nb") * F.col("ny")))).alias("score"))


def _scores_frame(df: DataFrame, columns: Sequence[str], scores: Sequence[float]) -> DataFrame:
    return df.sparkSession.createDataFrame([(c, float(abs(s))) for c, s in zip(columns, scores, strict=True)], "feature string, score double")


def l1_scores(df: DataFrame, columns: Sequence[str], target: str, penalty: float = 0.01) -> DataFrame:
    """feature, score: sizes of the coefficients of a lasso on standardised features."""
    rows = VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="skip").transform(df.withColumn("_y", F.col(target).cast("double")))
    spread = _one_row(df, {c: F.stddev_pop(F.col(c).cast("double")) for c in columns})
    fit = LinearRegression(featuresCol="_x", labelCol="_y", elasticNetParam=1.0, regParam=penalty).fit(rows)
    return _scores_frame(df, columns, [w * (spread[c] or 0) for c, w in zip(columns, fit.coefficients, strict=True)])


def importance_scores(df: DataFrame, columns: Sequence[str], target: str, seed: int = 0) -> DataFrame:
    """feature, score: importances of a random forest. The forest keeps every row in memory with its draws for all trees, and a task reads a whole partition of them, so partitions of many rows are split first."""
    rows = in_small_parts(df.select(*dict.fromkeys([*columns, target])))
    rows = VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="skip").transform(rows.withColumn("_y", F.col(target).cast("double")))
    return _scores_frame(df, columns, RandomForestRegressor(featuresCol="_x", labelCol="_y", numTrees=20, seed=seed).fit(rows).featureImportances.toArray())


def select_by_f(df: DataFrame, columns: Sequence[str], target: str, n: int) -> list[str]:
    """The n features that Spark ML's F test ranks first."""
    rows = VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="skip").transform(df.withColumn("_y", F.col(target).cast("double")))
    chosen = UnivariateFeatureSelector(featuresCol="_x", labelCol="_y", outputCol="_s").setFeatureType("continuous").setLabelType("categorical").setSelectionMode("numTopFeatures").setSelectionThreshold(n)
    return [columns[i] for i in chosen.fit(rows).selectedFeatures]


def prune_redundant(df: DataFrame, scores: Mapping[str, float], threshold: float = 0.95, max_features: int | None = None) -> list[str]:
    """Features by falling score, without those whose correlation with one kept before reaches the threshold. All correlations come from one aggregate."""
    names = sorted(scores, key=lambda c: (-scores[c], c))
    pairs = {f"{a}|{b}": safe_corr(F.col(a), F.col(b)) for i, a in enumerate(names) for b in names[i + 1 :]}
    found = _one_row(df, pairs) if pairs else {}
    kept: list[str] = []
    for b in names:
        if all(abs(found.get(f"{a}|{b}") or 0.0) < threshold for a in kept):
            kept.append(b)
    return kept[:max_features]


def fit_pca(train: DataFrame, columns: Sequence[str], n: int, whiten: bool = False) -> State:
    if train.filter(" OR ".join(f"`{c}` IS NULL" for c in columns)).limit(1).count():
        raise ValueError("PCA takes no nulls")
    means, _, axes, values = principal_axes(train, columns, standardise=False)
    return {"columns": list(columns), "means": means.tolist(), "axes": axes[:, :n].T.tolist(), "scales": [float(v**0.5) if whiten and v > 0 else 1.0 for v in values[:n]]}


def apply_pca(df: DataFrame, state: State, prefix: str = "pc") -> DataFrame:
    ones = [1.0] * len(state["columns"])
    made = {f"{prefix}_{i + 1}": projected(state["columns"], state["means"], ones, axis) / F.lit(s) for i, (axis, s) in enumerate(zip(state["axes"], state["scales"], strict=True))}
    return df.withColumns(made)


# --- recipes -----------------------------------------------------------------------------------------------------


def recipe_hash(recipe: Sequence[Mapping[str, Any]]) -> str:
    return hashlib.sha256(json.dumps(recipe, sort_keys=True).encode()).hexdigest()


def fit_recipe(train: DataFrame, recipe: Sequence[Mapping[str, Any]]) -> tuple[State, DataFrame]:
    """(state, transformed training rows) of steps {kind: impute|scale|winsorize|encode|pca, ...}; each is fitted on what those before it made."""
    states, df = [], train
    for step in recipe:
        fit, apply, keys = KINDS[step["kind"]]
        state = fit(df, **{k: v for k, v in step.items() if k in keys})
        states.append(state)
        df = apply(df, state)
    return {"recipe_hash": recipe_hash(recipe), "recipe": list(recipe), "states": states}, df


def transform(df: DataFrame, fitted: State, recipe: Sequence[Mapping[str, Any]] | None = None) -> DataFrame:
    """Rows transformed by a saved state; a state of another recipe is refused."""
    if recipe is not None and recipe_hash(recipe) != fitted["recipe_hash"]:
        raise ValueError("the saved state belongs to another recipe")
    for step, state in zip(fitted["recipe"], fitted["states"], strict=True):
        df = KINDS[step["kind"]][1](df, state)
    return df


KINDS = {
    "impute": (fit_impute, apply_impute, {"rules"}),
    "scale": (fit_scale, apply_scale, {"columns", "method"}),
    "winsorize": (fit_winsorize, apply_winsorize, {"columns", "low", "high"}),
    "encode": (fit_encode, apply_encode, {"column", "method", "max_categories", "min_frequency", "bins"}),
    "pca": (fit_pca, apply_pca, {"columns", "n", "whiten"}),
}
