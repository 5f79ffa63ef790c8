"""Column and row transforms: projections, derived columns, filters, joins, aggregations, windows, sorts and unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.functions.lineage import range_parts
from marlpit.functions.ranks import column_quantiles, placed, with_quantiles
from marlpit.functions.semantics import INTEGER_TYPES, order, orders, strict_cast

#: Mappings with more keys are joined rather than written out as cases.
MAX_CASES = 100


# --- projections -------------------------------------------------------------------------------------------------


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def visible_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Those of columns that df has; all of df if it has none."""
    kept = [c for c in columns if c in df.columns]
    return df.select(*kept) if kept else df


def rename_columns(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(renames))


def cast_columns(df: DataFrame, casts: Mapping[str, str]) -> DataFrame:
    """Strict casts to the names of CAST_TYPES."""
    return df.withColumns({c: strict_cast(F.col(c), kind, df.schema[c].dataType if kind in INTEGER_TYPES else None) for c, kind in casts.items()})


def expression(tree: Mapping[str, Any]) -> Column:
    """A column from a tree of {"column": name}, {"literal": value} or {"op": add|subtract|multiply|divide|concat, "args": [...]}."""
    if "column" in tree:
        return F.col(tree["column"])
    if "literal" in tree:
        return F.lit(tree["literal"])
    args = [expression(a) for a in tree["args"]]
    folds = {
        "add": lambda a, b: a + b,
        "subtract": lambda a, b: a - b,
        "multiply": lambda a, b: a * b,
        "divide": lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
        "concat": lambda a, b: F.concat(a.cast("string"), b.cast("string")),
    }
    return reduce(folds[tree["op"]], args)


def derive_column(df: DataFrame, name: str, tree: Mapping[str, Any]) -> DataFrame:
    return df.withColumn(name, expression(tree))


def map_categories(df: DataFrame, column: str, mapping: Mapping[str, str], output: str | None = None) -> DataFrame:
    """Values replaced as the mapping says, others kept as text."""
    text = F.col(column).cast("string")
    if len(mapping) <= MAX_CASES:
        cases = F.lit(None).cast("string")
        for old, new in reversed(list(mapping.items())):
            cases = F.when(text == old, F.lit(new)).otherwise(cases)
        return df.withColumn(output or column, F.coalesce(cases, text))
    pairs = df.sparkSession.createDataFrame([(k, v) for k, v in mapping.items()], "_old string, _new string")
    joined = df.join(F.broadcast(pairs), text == F.col("_old"), "left")  # the mapping is the caller's, in memory already
    return joined.withColumn(output or column, F.coalesce("_new", text)).drop("_old", "_new")


def hash_identifier(df: DataFrame, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A sha256 of the columns (all by default), told apart by length so that no two rows of different values share one by chance of concatenation."""
    texts = [F.col(c).cast("string") for c in columns or df.columns]
    parts = [F.coalesce(F.concat(F.lit("V"), F.length(x).cast("string"), F.lit(":"), x, F.lit(";")), F.lit("N;")) for x in texts]  # the text of a value is made once
    return df.withColumn(name, F.sha2(F.concat(*parts), 256))


def sequence_identifier(df: DataFrame, name: str, order_by: Sequence[str], start: int = 1) -> DataFrame:
    """start, start + 1 ... in the given order, without bringing all rows to one task: range partitions are numbered by themselves and
    shifted by the sizes of those before them."""
    keys = orders(order_by)
    ranged = range_parts(df, keys, "_part")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    numbered = ranged.withColumn("_nth", inside).join(F.broadcast(shift), F.col("_part") == F.col("_p"))
    return numbered.withColumn(name, F.col("_nth") + F.col("_shift") + F.lit(start - 1)).drop("_part", "_p", "_nth", "_shift")


def most_frequent(df: DataFrame, column: str) -> Any:
    """The most frequent value, the smallest of equally frequent ones."""
    row = df.filter(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), F.col(column).cast("string")).first()
    return row[0] if row else None


def impute_missing(df: DataFrame, rules: Sequence[Mapping[str, Any]]) -> DataFrame:
    """rules: {column, method: fixed|unknown|mean|median|mode|drop_rows, value?, add_indicator?}. Rows are dropped before mean and median are taken;
    the mode is that of the whole table."""
    kept = df
    for r in rules:
        if r["method"] == "drop_rows":
            kept = kept.filter(F.col(r["column"]).isNotNull())
    means = {r["column"]: F.avg(r["column"]) for r in rules if r["method"] == "mean"}
    found = kept.agg(*[e.alias(c) for c, e in means.items()]).first().asDict() if means else {}
    middles = [r["column"] for r in rules if r["method"] == "median"]
    found |= {c: q and q[0] for c, q in column_quantiles(kept, middles, [0.5]).items()} if middles else {}
    out = kept
    for r in rules:
        c, method = r["column"], r["method"]
        if r.get("add_indicator"):
            out = out.withColumn(f"{c}__was_missing", F.col(c).isNull())
        if method in ("fixed", "constant"):
            fill = r["value"]
        elif method == "unknown":
            fill = "unknown"
        elif method == "mode":
            fill = most_frequent(df, c)
        elif method in ("mean", "median"):
            fill = found[c]
        else:
            continue
        if fill is not None:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(fill)))
    return out


# --- SQL text ----------------------------------------------------------------------------------------------------


def check_scalar(df: DataFrame, text: str) -> Column:
    """A Column from SQL text that is one scalar expression over df's columns: no aggregate, window or subquery."""
    from marlpit.plans.sql import is_scalar

    if not is_scalar(df, text):
        raise ValueError(f"not a scalar expression: {text}")
    return F.expr(text)


def sql_expression(df: DataFrame, name: str, text: str) -> DataFrame:
    return df.withColumn(name, check_scalar(df, text))


def filter_sql(df: DataFrame, predicate: str) -> DataFrame:
    return df.filter(check_scalar(df, predicate))


# --- filters -----------------------------------------------------------------------------------------------------


def _contains(c: Column, v: Any, how: str) -> Column:
    text, wanted = F.lower(c.cast("string")), F.lower(F.lit(str(v)))
    return {"contains": F.contains, "starts_with": F.startswith, "ends_with": F.endswith}[how](text, wanted)


def condition(c: str, op: str, value: Any = None) -> Column:
    """A visual filter's condition; text operators ignore case and take the value literally."""
    x = F.col(c)
    if op in ("contains", "starts_with", "ends_with"):
        return _contains(x, value, op)
    if op in ("in", "not_in"):
        return x.isin(list(value)) if op == "in" else ~x.isin(list(value))
    if op in ("is_null", "not_null"):
        return x.isNull() if op == "is_null" else x.isNotNull()
    return {"eq": x == value, "ne": x != value, "gt": x > value, "gte": x >= value, "lt": x < value, "lte": x <= value}[op]


def filter_rows(df: DataFrame, conditions: Sequence[Mapping[str, Any]], combine: str = "and") -> DataFrame:
    tests = [condition(x["column"], x["operator"], x.get("value")) for x in conditions]
    return df.filter(reduce(and_ if combine == "and" else or_, tests)) if tests else df


def browse_condition(c: str, op: str, value: Any = None, upper: Any = None, upper_inclusive: bool = False) -> Column:
    """A data browser's condition: compares as text without case, numbers by a cast that gives null on failure; empty means null or ''."""
    text, number = F.lower(F.col(c).cast("string")), F.col(c).try_cast("double")
    if op in ("contains", "starts_with", "ends_with"):
        return _contains(F.col(c), value, op)
    if op == "equals":
        return text == str(value).lower()
    if op == "not_equals":
        return text != str(value).lower()
    if op == "in":
        return text.isin([str(v).lower() for v in value])
    if op == "regex":
        return F.col(c).cast("string").rlike(str(value))
    if op == "between":
        return (number >= float(value)) & ((number <= float(upper)) if upper_inclusive else (number < float(upper)))
    if op in ("empty", "not_empty"):
        none = F.col(c).isNull() | (F.col(c).cast("string") == "")
        return none if op == "empty" else ~none
    v = float(value)
    return {"gt": number > v, "gte": number >= v, "lt": number < v, "lte": number <= v}[op]


def browse_filter(df: DataFrame, filters: Sequence[Mapping[str, Any]]) -> DataFrame:
    """All conditions hold; on an aggregate's output this is HAVING."""
    for f in filters:
        df = df.filter(browse_condition(**f))
    return df


def search(df: DataFrame, text: str) -> DataFrame:
    """Rows in which any column contains the text, without case."""
    return df.filter(reduce(or_, [F.coalesce(_contains(F.col(c), text, "contains"), F.lit(False)) for c in df.columns]))


def drill(df: DataFrame, filters: Sequence[Mapping[str, Any]], order_by: Sequence[str], limit: int = 100) -> DataFrame:
    """The first rows that all filters (20 at most) let through, with the number of all such rows in matches."""
    if len(filters) > 20:
        raise ValueError("at most 20 filters")
    found = browse_filter(df, filters)
    total = found.agg(F.count("*").alias("matches"))
    return found.orderBy(*orders(order_by)).limit(limit).crossJoin(F.broadcast(total))  # one row


def chart_rows(df: DataFrame, required: Sequence[str], group: str | None = None, groups: Sequence[str] | None = None) -> DataFrame:
    """Rows whose required columns are given and finite and whose group is among groups; an empty list keeps none."""
    for c in required:
        df = df.filter(F.col(c).isNotNull())
        if df.schema[c].dataType.typeName() in ("double", "float"):
            df = df.filter(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")))
    if group is not None and groups is not None:
        df = df.filter(F.col(group).cast("string").isin(list(groups))) if groups else df.filter(F.lit(False))
    return df


# --- joins -------------------------------------------------------------------------------------------------------


def join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], how: str = "inner", right_suffix: str = "_right", coalesce_keys: bool = False) -> DataFrame:
    """Equality join. The right keys are dropped and its other names that clash get the suffix; unmatched right rows of right and full joins
    therefore show null keys, unless coalesce_keys is set."""
    taken, names = set(left.columns), {}
    for c in right.columns:
        names[c] = f"{c}{right_suffix}" if c in taken else c
    right = right.select(*[F.col(c).alias(f"_r_{c}") for c in right.columns])
    on = reduce(and_, [F.col(a) == F.col(f"_r_{b}") for a, b in keys])
    key_of = dict(keys)
    lefts = [F.coalesce(F.col(c), F.col(f"_r_{key_of[c]}")).alias(c) if coalesce_keys and c in key_of else F.col(c) for c in left.columns]
    dropped = {b for _, b in keys}
    rights = [F.col(f"_r_{c}").alias(names[c]) for c in names if c not in dropped]
    return left.join(right, on, "outer" if how == "full" else how).select(*lefts, *rights)


def unmatched_count(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many left rows have no match."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti").agg(F.count("*").alias("unmatched"))


def key_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, null_keys, duplicate_keys (keys that more than one row has)."""
    null = reduce(or_, [F.col(k).isNull() for k in keys])
    per = df.withColumn("_null", null).groupBy(*keys, "_null").agg(F.count("*").alias("_n"))
    return per.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("_null"), F.col("_n"))), F.lit(0)).alias("null_keys"),
        F.count_if(~F.col("_null") & (F.col("_n") > 1)).alias("duplicate_keys"),
    )


def assert_unique_key(df: DataFrame, keys: Sequence[str]) -> None:
    """Hashes of 64 bits meet; the keys themselves only if a hash is met twice, or to tell how many are null."""
    null = reduce(or_, [F.col(k).isNull() for k in keys])
    per = df.groupBy(F.when(~null, F.xxhash64(*keys)).alias("_h")).agg(F.count("*").alias("_n"))
    if not per.agg(F.count_if(F.col("_h").isNull() | (F.col("_n") > 1))).first()[0]:
        return
    found = key_check(df, keys).first()
    if found.null_keys or found.duplicate_keys:
        raise ValueError(f"key {list(keys)}: {found.null_keys} null, {found.duplicate_keys} repeated")


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value of the column other rows have too."""
    many = df.filter(F.col(column).isNotNull()).groupBy(column).count().filter("count > 1").select(column)
    return df.join(many, column, "left_semi")


# --- aggregations ------------------------------------------------------------------------------------------------

AGGREGATES = {
    "count": lambda c: F.count("*") if c == "*" else F.count(c),
    "count_distinct": F.count_distinct,
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
}


def aggregate(df: DataFrame, group_by: Sequence[str], aggregations: Sequence[Mapping[str, str]]) -> DataFrame:
    """aggregations: {function, column, alias}; function is one of AGGREGATES, column may be * for count."""
    return df.groupBy(*group_by).agg(*[AGGREGATES[a["function"]](a["column"]).alias(a["alias"]) for a in aggregations])


def browse_group(df: DataFrame, group_by: Sequence[str], measures: Sequence[tuple[str, str, str]], order_key: str | None = None) -> DataFrame:
    """records and the measures (function, column, alias) of each group; first, last follow order_key; the mode is the smallest of the most frequent values; medians are exact, found in range partitions. Medians and modes follow the other measures."""
    modes, medians = ([m for m in measures if m[0] == how] for how in ("most_frequent", "median"))
    plain = [F.count("*").alias("records")]
    for how, c, alias in measures:
        if how in ("most_frequent", "median"):
            continue
        made = {
            "count_values": lambda c=c: F.count(c), "unique_count": lambda c=c: F.count_distinct(c), "sum": lambda c=c: F.sum(c),
            "average": lambda c=c: F.avg(c), "minimum": lambda c=c: F.min(c), "maximum": lambda c=c: F.max(c),
            "first": lambda c=c: F.min_by(c, order_key), "last": lambda c=c: F.max_by(c, order_key),
        }[how]()
        plain.append(made.alias(alias))
    out = df.groupBy(*group_by).agg(*plain)
    for _, c, alias in medians:  # no group's values are held together
        out = with_quantiles(out, df, group_by, c, {alias: 0.5})
    for _, c, alias in modes:
        counted = df.filter(F.col(c).isNotNull()).groupBy(*group_by, c).count()
        best = counted.groupBy(*group_by).agg(F.min_by(c, F.struct(-F.col("count"), F.col(c))).alias(alias))
        keys = [F.col(g).alias(f"_g_{g}") for g in group_by]
        on = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group_by])
        out = out.join(best.select(*keys, alias), on, "left").drop(*[f"_g_{g}" for g in group_by])
    return out


def group_values(df: DataFrame, column: str, limit: int = 20) -> DataFrame:
    """The most frequent values, ties by text, and whether there are more."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = counted.agg((F.count("*") > limit).alias("truncated"))
    return counted.orderBy(F.desc("n"), "value").limit(limit).crossJoin(F.broadcast(total))  # one row


def column_summary(df: DataFrame, column: str, top: int = 5, exact: bool = True) -> DataFrame:
    """The most frequent values, null among them, with their share; beside each the number of nulls and of distinct values."""
    distinct = F.count_distinct(column) if exact else F.approx_count_distinct(column)
    totals = df.agg(F.count("*").alias("rows"), F.count_if(F.col(column).isNull()).alias("nulls"), distinct.alias("distinct_values"))
    ranked = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), order("value")).limit(top)
    return ranked.crossJoin(F.broadcast(totals)).withColumn("share", F.try_divide(F.col("n").cast("double"), F.col("rows")))  # one row


def inline_describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per column: count, missing (null or ''), unique; mean, min and max if all given values are numbers."""
    parts = []
    for c in columns:
        text = F.col(c).cast("string")
        given, number = F.when(text != "", text), F.when(text != "", text).try_cast("double")
        numeric = F.count(given) == F.count(number)
        parts.append(F.struct(
            F.lit(c).alias("column_name"), F.count(given).alias("count"), (F.count("*") - F.count(given)).alias("missing"),
            F.count_distinct(given).alias("unique_values"), F.when(numeric, F.avg(number)).alias("mean"),
            F.when(numeric, F.min(number)).alias("minimum"), F.when(numeric, F.max(number)).alias("maximum"),
        ))
    return df.agg(F.array(*parts).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Per class: n and the weight rows / (classes * n) that balances them."""
    counted = df.filter(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("class")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()  # over the classes
    return counted.withColumn("weight", F.sum("n").over(whole) / (F.count("*").over(whole) * F.col("n")))


# --- windows, sorts, sets ----------------------------------------------------------------------------------------


def deduplicate(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows, or one row per key: the first in the order of all columns, so that reruns agree."""
    if not columns:
        return df.distinct()
    rest = [F.col(c) for c in df.columns if c not in columns]
    first = df.groupBy(*columns).agg(F.min(F.struct(*rest)).alias("_first"))
    return first.select(*columns, "_first.*").select(*df.columns)


def sort_rows(df: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    return df.orderBy(*[order(c, d) for c, d in columns])


def keyset_page(df: DataFrame, created: str, key: str, after: tuple[Any, Any] | None, size: int, record: tuple[str, Any] | None = None) -> DataFrame:
    """The newest rows before a (created, key) cursor."""
    if record is not None:
        df = df.filter(F.col(record[0]) == record[1])
    if after is not None:
        df = df.filter((F.col(created) < F.lit(after[0])) | ((F.col(created) == F.lit(after[0])) & (F.col(key) < F.lit(after[1]))))
    return df.orderBy(F.desc(created), F.desc(key)).limit(size)


def hash_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows, the same on every run: those with the smallest hash of key and seed."""
    from marlpit.functions.semantics import portable_hash

    return df.withColumn("_h", portable_hash(F.col(key), F.lit(seed))).orderBy("_h", key).limit(n).drop("_h")


def retained(df: DataFrame, created: str, cutoffs: Mapping[Any, Any], scope: str) -> DataFrame:
    """Rows not older than their scope's cutoff; scopes without one keep all."""
    keep = F.lit(True)
    for value, cutoff in cutoffs.items():
        keep = keep & ~((F.col(scope) == F.lit(value)) & (F.col(created) < F.lit(cutoff)))
    return df.filter(F.coalesce(keep, F.lit(True)))


def union(frames: Sequence[DataFrame], by_name: bool = True) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True) if by_name else a.union(b), frames)


def distinct_union(frames: Sequence[DataFrame]) -> DataFrame:
    return union(frames, by_name=False).distinct()


def fair_top(df: DataFrame, group: str, by: Sequence[Column], limit: int) -> DataFrame:
    """limit rows in which groups take turns: first the best of each, then the second of each ..."""
    ranked = df.withColumn("group_rank", F.row_number().over(Window.partitionBy(group).orderBy(*by))).filter(F.col("group_rank") <= limit)  # tasks keep no more of a group either
    return ranked.orderBy("group_rank", order(group)).limit(limit)


def version_numbers(df: DataFrame, family: str, created: str, key: str) -> DataFrame:
    """df with version: the place of a row in its family, from 1, in order of created and key."""
    rows = placed(df.withColumn("_one", F.lit(1)), [family], [F.col(created), F.col(key)], ["_one"])
    return rows.withColumn("version", (F.col("_one_before") + 1).cast("int")).drop("_one", "_one_before", "_one_all")


def group_count_guard(df: DataFrame, group: str, limit: int) -> int:
    """The number of groups; an error if there are more than limit. Reads no more than limit + 1 of them."""
    n = df.select(group).distinct().limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"more than {limit} groups in {group}")
    return n
