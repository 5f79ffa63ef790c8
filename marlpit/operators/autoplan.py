"""From a profile of the columns to suggested features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.functions.semantics import family, safe_div, sample_skewness
from marlpit.operators.profile import distinct_counts

MAX_ONE_HOT = 32
ID_WORDS = ("id", "key", "uuid", "guid", "code", "number")


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """column_name, family, count, nulls, distinct_values, minimum, maximum, mean, sd (of the population), skew, zero_share."""
    columns = list(columns or df.columns)
    parts, nothing = [], F.lit(None).cast("double")
    for c in columns:
        kind, x = family(df.schema[c].dataType), F.col(c).cast("double") if family(df.schema[c].dataType) == "number" else None
        stats = [F.min(x), F.max(x), F.avg(x), F.stddev_pop(x), sample_skewness(x), safe_div(F.count_if(x == 0), F.count(x))] if x is not None else [nothing] * 6
        names = ("minimum", "maximum", "mean", "sd", "skew", "zero_share")
        parts.append(F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("family"), F.count(c).alias("count"), F.count_if(F.col(c).isNull()).alias("nulls"),
                              (F.lit(None).cast("bigint") if exact else F.approx_count_distinct(c)).alias("approx"), *[s.alias(n) for s, n in zip(stats, names, strict=True)]))
    out = df.agg(F.array(*parts).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    if exact:
        return out.drop("approx").join(distinct_counts(df, columns), "column_name", "left").withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0)))
    return out.withColumnRenamed("approx", "distinct_values")


def decisions(profile: DataFrame) -> DataFrame:
    """column_name, decision: identifier, numeric, datetime, one_hot, frequency or unsupported."""
    words = F.split(F.lower("column_name"), "_")
    unique = F.col("distinct_values") >= 0.98 * F.col("count")
    identifier = F.arrays_overlap(words, F.array(*[F.lit(w) for w in ID_WORDS])) & unique
    named = F.exists(words, lambda w: F.endswith(w, F.lit("key")) | F.endswith(w, F.lit("id"))) & unique
    out = F.when(F.col("count") == 0, "unsupported").when(identifier | named, "identifier").when(F.col("family") == "number", "numeric").when(F.col("family") == "date", "datetime")
    out = out.when(F.col("distinct_values") <= MAX_ONE_HOT, "one_hot").when(~unique, "frequency").otherwise("unsupported")
    return profile.select("column_name", out.alias("decision"))


def skew_transforms(profile: DataFrame, threshold: float = 1.0) -> DataFrame:
    """column_name, transform for skewed numbers: log1p where the skew is twice the threshold and no value is negative, sqrt where it is less, else signed_log1p."""
    s = F.abs("skew")
    kind = F.when((s >= 2 * threshold) & (F.col("minimum") >= 0), "log1p").when(F.col("minimum") >= 0, "sqrt").otherwise("signed_log1p")
    return profile.filter(s >= threshold).select("column_name", kind.alias("transform"))


def interaction_pairs(profile: DataFrame, top: int = 5) -> DataFrame:
    """Pairs of numbers by how much both vary (deviation over range) and how complete they are."""
    n = profile.filter("family = 'number' AND maximum > minimum").select("column_name", (F.col("sd") / (F.col("maximum") - F.col("minimum")) * F.col("count") / (F.col("count") + F.col("nulls"))).alias("w"))
    a, b = n.select(F.col("column_name").alias("a"), F.col("w").alias("wa")), n.select(F.col("column_name").alias("b"), F.col("w").alias("wb"))
    pairs = a.join(b, F.col("a") < F.col("b")).select("a", "b", (F.col("wa") * F.col("wb")).alias("score"))  # a row per column on either side
    return pairs.orderBy(F.desc(F.round("score", 9)), "a", "b").limit(top)
