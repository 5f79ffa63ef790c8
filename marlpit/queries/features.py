"""Feature engineering, splits and automatic decisions over orders, lineitem and part."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.operators import autoplan
from marlpit.operators import features as fe
from marlpit.operators import splits as sp
from marlpit.queries.registry import collector, read, rounded

QUERIES, ORACLE_SQL, register = collector()


def h(expr: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5({expr} || '|' || {seed}), 1, 15) AS BIGINT)"


_S = f"({h('o_orderkey', 42)} % 1000000) / 1000000.0::DOUBLE"
#: The rows that operators are fitted on: those that the random split gives to training.
_TRAIN = f"tr AS (SELECT * FROM orders WHERE {_S} >= 0.3)"


def train_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    df = sp.random_split(read(spark, d, "orders"), "o_orderkey")
    return df.filter(F.col(sp.SPLIT) == "training"), df


@register(f"""WITH {_TRAIN}, m AS (SELECT median(nullif(o_custkey, 7)) AS m FROM tr)
SELECT o_orderkey, CAST(coalesce(nullif(o_custkey, 7), m) AS DOUBLE) AS c, nullif(o_custkey, 7) IS NULL AS c__was_missing, coalesce(nullif(o_orderpriority, '1-URGENT'), (SELECT p FROM (SELECT nullif(o_orderpriority, '1-URGENT') AS p, count(*) AS n FROM tr GROUP BY 1) WHERE p IS NOT NULL ORDER BY n DESC, p LIMIT 1)) AS p FROM orders, m""")
def e1_impute(spark: SparkSession, d: str) -> DataFrame:
    train, df = (x.select("o_orderkey", F.nullif("o_custkey", F.lit(7)).cast("double").alias("c"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("p")) for x in train_of(spark, d))
    state = fe.fit_impute(train, [{"column": "c", "method": "median", "add_indicator": True}, {"column": "p", "method": "mode"}])
    return fe.apply_impute(df, state)


@register(f"WITH {_TRAIN}, s AS (SELECT avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS b FROM tr) SELECT o_orderkey, round((o_totalprice - a) / b, 6) AS o_totalprice FROM orders, s")
def e2_scale_standard(spark: SparkSession, d: str) -> DataFrame:
    train, df = train_of(spark, d)
    return rounded(fe.apply_scale(df, fe.fit_scale(train, ["o_totalprice"])).select("o_orderkey", "o_totalprice"))


@register(f"WITH {_TRAIN}, s AS (SELECT min(o_totalprice) AS a, max(o_totalprice) - min(o_totalprice) AS b FROM tr) SELECT o_orderkey, round((o_totalprice - a) / b, 6) AS o_totalprice FROM orders, s")
def e3_scale_minmax(spark: SparkSession, d: str) -> DataFrame:
    train, df = train_of(spark, d)
    return rounded(fe.apply_scale(df, fe.fit_scale(train, ["o_totalprice"], "minmax")).select("o_orderkey", "o_totalprice"))


@register(f"WITH {_TRAIN}, s AS (SELECT median(o_totalprice) AS a, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS b FROM tr) SELECT o_orderkey, round((o_totalprice - a) / b, 6) AS o_totalprice FROM orders, s")
def e4_scale_robust(spark: SparkSession, d: str) -> DataFrame:
    train, df = train_of(spark, d)
    return rounded(fe.apply_scale(df, fe.fit_scale(train, ["o_totalprice"], "robust")).select("o_orderkey", "o_totalprice"))


@register(f"WITH {_TRAIN}, s AS (SELECT quantile_cont(o_totalprice, 0.05) AS a, quantile_cont(o_totalprice, 0.95) AS b FROM tr) SELECT o_orderkey, round(greatest(least(o_totalprice, b), a), 4) AS o_totalprice FROM orders, s")
def e5_winsorize(spark: SparkSession, d: str) -> DataFrame:
    train, df = train_of(spark, d)
    return rounded(fe.apply_winsorize(df, fe.fit_winsorize(train, ["o_totalprice"], 0.05, 0.95)).select("o_orderkey", "o_totalprice"), 4)


_CATS = f"WITH {_TRAIN}, c AS (SELECT o_orderpriority AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS i FROM tr GROUP BY 1)"


def _encoded(spark: SparkSession, d: str, method: str, k: int) -> DataFrame:
    train, df = train_of(spark, d)
    out = fe.apply_encode(df, fe.fit_encode(train, "o_orderpriority", method, max_categories=k))
    return out.select("o_orderkey", *[c for c in out.columns if "__" in c])


@register(_CATS + " SELECT o_orderkey, " + ", ".join(f"(o_orderpriority = (SELECT v FROM c WHERE i = {i}))::INT AS o_orderpriority__{i}" for i in range(3)) + ", (o_orderpriority NOT IN (SELECT v FROM c WHERE i < 3))::INT AS o_orderpriority__other FROM orders")
def e6_one_hot(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d, "one_hot", 3)


@register(_CATS + " SELECT o_orderkey, CAST(coalesce(CASE WHEN i < 4 THEN i END, -1) AS INTEGER) AS o_orderpriority__ordinal FROM orders LEFT JOIN c ON v = o_orderpriority")
def e7_ordinal(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d, "ordinal", 4)


@register(_CATS + " SELECT o_orderkey, round(coalesce(n / (SELECT count(*) FROM tr), 0), 6) AS o_orderpriority__frequency FROM orders LEFT JOIN c ON v = o_orderpriority")
def e8_frequency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_encoded(spark, d, "frequency", 500))


@register("SELECT o_orderkey, " + ", ".join(f"(CAST('0x' || substr(md5(o_orderpriority), 1, 15) AS BIGINT) % 4 = {i})::INT AS o_orderpriority__hash_{i}" for i in range(4)) + " FROM orders")
def e9_hashing(spark: SparkSession, d: str) -> DataFrame:
    _, df = train_of(spark, d)
    out = fe.apply_encode(df, fe.fit_encode(df, "o_orderpriority", "hashing", bins=4))
    return out.select("o_orderkey", *[c for c in out.columns if "__hash_" in c])


_FOLD = f"CAST({h('o_orderkey', 42)} % 3 AS INTEGER)"


@register(f"""WITH t AS (SELECT o_orderkey, o_orderpriority AS v, (o_orderstatus = 'F')::INT::DOUBLE AS y, {_FOLD} AS f, {_S} >= 0.3 AS tr FROM orders), p AS (SELECT avg(y) AS p FROM t WHERE tr),
g AS (SELECT v, f, count(*) AS n, sum(y) AS s FROM t WHERE tr GROUP BY ALL), a AS (SELECT v, sum(n) AS n, sum(s) AS s FROM g GROUP BY 1)
SELECT o_orderkey, CASE WHEN tr THEN 'training' ELSE 'other' END AS side, round(CASE WHEN tr THEN (a.s - g.s + 10 * p) / (a.n - g.n + 10) ELSE (coalesce(a.s, 0) + 10 * p) / (coalesce(a.n, 0) + 10) END, 6) AS v__target
FROM t LEFT JOIN a ON a.v = t.v LEFT JOIN g ON g.v = t.v AND g.f = t.f, p""")
def e10_target_mean(spark: SparkSession, d: str) -> DataFrame:
    df = sp.folds(sp.random_split(read(spark, d, "orders"), "o_orderkey"), "o_orderkey", 3)
    df = df.select("o_orderkey", F.col("o_orderpriority").alias("v"), (F.col("o_orderstatus") == "F").cast("double").alias("y"), sp.FOLD, sp.SPLIT)
    a, b = fe.encode_target_mean(df.filter("split_role = 'training'"), df.filter("split_role <> 'training'"), "v", "y", sp.FOLD)
    out = a.withColumn("side", F.lit("training")).unionByName(b.withColumn("side", F.lit("other")))
    return rounded(out.select("o_orderkey", "side", "v__target"))


@register(f"""WITH t AS (SELECT o_orderkey, o_orderpriority AS v, (o_orderstatus = 'F')::INT::DOUBLE AS y, {h('o_orderkey', 3)} AS k FROM orders), p AS (SELECT avg(y) AS p FROM t)
SELECT o_orderkey, round((coalesce(sum(y) OVER w, 0) + p) / (count(y) OVER w + 1), 6) AS v__ordered FROM t, p WINDOW w AS (PARTITION BY v ORDER BY k, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def e11_ordered_target(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("v"), (F.col("o_orderstatus") == "F").cast("double").alias("y"))
    return rounded(fe.encode_ordered_target(df, "v", "y", "o_orderkey", 3).select("o_orderkey", "v__ordered"))


_CLASSES = ("F", "O", "P")


@register(f"""WITH t AS (SELECT o_orderkey, o_orderpriority AS v, o_orderstatus AS y, {_FOLD} AS f, {_S} >= 0.3 AS tr FROM orders), c AS (SELECT unnest(['F', 'O', 'P']) AS c),
p AS (SELECT c, avg((y = c)::INT) AS p FROM t, c WHERE tr GROUP BY 1), g AS (SELECT v, f, c, count(*) AS n, sum((y = c)::INT) AS s FROM t, c WHERE tr GROUP BY ALL), a AS (SELECT v, c, sum(n) AS n, sum(s) AS s FROM g GROUP BY ALL),
e AS (SELECT o_orderkey, tr, p.c, round(CASE WHEN tr THEN (a.s - g.s + 10 * p) / (a.n - g.n + 10) ELSE (coalesce(a.s, 0) + 10 * p) / (coalesce(a.n, 0) + 10) END, 6) AS e
  FROM t CROSS JOIN p LEFT JOIN a ON a.v = t.v AND a.c = p.c LEFT JOIN g ON g.v = t.v AND g.f = t.f AND g.c = p.c)
SELECT o_orderkey, CASE WHEN any_value(tr) THEN 'training' ELSE 'other' END AS side, max(e) FILTER (WHERE c = 'F') AS v__target_F, max(e) FILTER (WHERE c = 'O') AS v__target_O, max(e) FILTER (WHERE c = 'P') AS v__target_P FROM e GROUP BY 1""")
def e10_target_classes(spark: SparkSession, d: str) -> DataFrame:
    """A target of three classes: the share of each, smoothed towards its share of all training rows."""
    df = sp.folds(sp.random_split(read(spark, d, "orders"), "o_orderkey"), "o_orderkey", 3)
    df = df.select("o_orderkey", F.col("o_orderpriority").alias("v"), F.col("o_orderstatus").alias("y"), sp.FOLD, sp.SPLIT)
    a, b = fe.encode_target_mean(df.filter("split_role = 'training'"), df.filter("split_role <> 'training'"), "v", "y", sp.FOLD, task="classification")
    out = a.withColumn("side", F.lit("training")).unionByName(b.withColumn("side", F.lit("other")))
    return rounded(out.select("o_orderkey", "side", *[f"v__target_{c}" for c in _CLASSES]))


@register(f"""WITH t AS (SELECT o_orderkey, o_orderpriority AS v, o_orderstatus AS y, {h('o_orderkey', 3)} AS k FROM orders), p AS (SELECT avg((y = 'F')::INT) AS pf, avg((y = 'O')::INT) AS po, avg((y = 'P')::INT) AS pp FROM t)
SELECT o_orderkey, round((coalesce(sum((y = 'F')::INT) OVER w, 0) + pf) / (count(y) OVER w + 1), 6) AS v__ordered_F, round((coalesce(sum((y = 'O')::INT) OVER w, 0) + po) / (count(y) OVER w + 1), 6) AS v__ordered_O,
round((coalesce(sum((y = 'P')::INT) OVER w, 0) + pp) / (count(y) OVER w + 1), 6) AS v__ordered_P FROM t, p WINDOW w AS (PARTITION BY v ORDER BY k, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def e11_ordered_classes(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("v"), F.col("o_orderstatus").alias("y"))
    return rounded(fe.encode_ordered_target(df, "v", "y", "o_orderkey", 3, task="classification").select("o_orderkey", *[f"v__ordered_{c}" for c in _CLASSES]))


@register("SELECT true AS refused, CAST(count(*) AS BIGINT) AS unknown FROM orders WHERE o_orderpriority = '1-URGENT'")
def e12_unknown_refused(spark: SparkSession, d: str) -> DataFrame:
    """Whether values that training rows lack are refused."""
    df = read(spark, d, "orders")
    state = fe.fit_encode(df.filter("o_orderpriority <> '1-URGENT'"), "o_orderpriority", "ordinal")
    refused = False
    try:
        fe.apply_encode(df, state, handle_unknown="error")
    except ValueError:
        refused = True
    return df.filter("o_orderpriority = '1-URGENT'").agg(F.lit(refused).alias("refused"), F.count("*").alias("unknown"))


@register("""SELECT s_suppkey, round(s_acctbal * s_acctbal, 4) AS square, round(CASE WHEN s_acctbal >= 0 THEN sqrt(s_acctbal) END, 6) AS sqrt, round(CASE WHEN s_acctbal > 0 THEN ln(s_acctbal) END, 6) AS log,
round(CASE WHEN s_acctbal > -1 THEN ln(1 + s_acctbal) END, 6) AS log1p, round(sign(s_acctbal) * ln(1 + abs(s_acctbal)), 6) AS signed_log1p, round(abs(s_acctbal), 4) AS abs FROM supplier""")
def e13_math(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "supplier")
    for kind in ("square", "sqrt", "log", "log1p", "signed_log1p", "abs"):
        df = fe.math_transform(df, "s_acctbal", kind, kind)
    out = rounded(df.select("s_suppkey", "square", "sqrt", "log", "log1p", "signed_log1p", "abs"))
    return out.withColumns({"square": F.round("square", 4), "abs": F.round("abs", 4)})


@register("""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate__year, CAST(quarter(o_orderdate) AS INTEGER) AS o_orderdate__quarter, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate__month, CAST(dayofweek(o_orderdate) AS INTEGER) AS o_orderdate__day_of_week,
(dayofweek(o_orderdate) IN (0, 6))::INT AS o_orderdate__is_weekend, round(sin(2 * pi() * month(o_orderdate) / 12), 6) AS o_orderdate__month_sin, round(cos(2 * pi() * month(o_orderdate) / 12), 6) AS o_orderdate__month_cos,
round(sin(2 * pi() * dayofweek(o_orderdate) / 7), 6) AS o_orderdate__day_of_week_sin, round(cos(2 * pi() * dayofweek(o_orderdate) / 7), 6) AS o_orderdate__day_of_week_cos FROM orders""")
def e14_datetime(spark: SparkSession, d: str) -> DataFrame:
    out = fe.datetime_features(read(spark, d, "orders"), "o_orderdate", ["year", "quarter", "month", "day_of_week", "is_weekend"], cyclical=True)
    return rounded(out.select("o_orderkey", *[c for c in out.columns if "__" in c]))


@register("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * l_discount, 4) AS product, round(coalesce(l_extendedprice / nullif(l_discount, 0), 0), 3) AS ratio FROM lineitem")
def e15_interaction(spark: SparkSession, d: str) -> DataFrame:
    df = fe.numeric_interaction(read(spark, d, "lineitem"), "l_extendedprice", "l_discount", "multiply", "product")
    df = fe.numeric_interaction(df, "l_extendedprice", "l_discount", "divide", "ratio", "zero")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", F.round("product", 4).alias("product"), F.round("ratio", 3).alias("ratio"))


@register("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE lower(p_brand) END AS label FROM part")
def e16_sql_feature(spark: SparkSession, d: str) -> DataFrame:
    return fe.sql_feature(read(spark, d, "part"), "label", "CASE WHEN p_size > 25 THEN 'big' ELSE lower(p_brand) END").select("p_partkey", "label")


@register("SELECT 'p_size' AS feature, round(var_pop(p_size), 4) AS variance FROM part UNION ALL SELECT 'p_retailprice', round(var_pop(p_retailprice), 4) FROM part UNION ALL SELECT 'one', 0.0 FROM part LIMIT 3")
def e17_variances(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "part").withColumn("one", F.lit(1.0))
    assert "one" not in fe.variance_filter(df, ["p_size", "p_retailprice", "one"]).columns
    return rounded(fe.variances(df, ["p_size", "p_retailprice", "one"]), 4)


_LONG = "l AS (SELECT 'l_quantity' AS feature, l_returnflag AS y, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_returnflag, l_extendedprice FROM lineitem UNION ALL SELECT 'l_tax', l_returnflag, l_tax FROM lineitem)"
_NUMBERS = ["l_quantity", "l_extendedprice", "l_tax"]


@register(f"""WITH {_LONG}, g AS (SELECT feature, y, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS w FROM l GROUP BY ALL), a AS (SELECT feature, avg(x) AS m, count(*) AS t FROM l GROUP BY 1)
SELECT g.feature, round(sum(n * (g.m - a.m) ** 2) / (count(*) - 1) / (sum(w) / (any_value(t) - count(*))), 4) AS score FROM g JOIN a ON a.feature = g.feature GROUP BY 1""")
def e18_f_test(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fe.f_scores(read(spark, d, "lineitem"), _NUMBERS, "l_returnflag"), 4)


@register(f"""WITH {_LONG}, g AS (SELECT feature, y, sum(x) AS o, count(*) AS n FROM l GROUP BY ALL), e AS (SELECT *, sum(o) OVER (PARTITION BY feature) * n / sum(n) OVER (PARTITION BY feature) AS e FROM g)
SELECT feature, round(sum((o - e) ** 2 / e), 3) AS score FROM e GROUP BY 1""")
def e19_chi_square(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fe.chi2_scores(read(spark, d, "lineitem"), _NUMBERS, "l_returnflag"), 3)


@register(None)
def e18_select(spark: SparkSession, d: str) -> DataFrame:
    """The two features that Spark ML's test ranks first."""
    df = read(spark, d, "lineitem").withColumn("y", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    kept = fe.select_by_f(df, _NUMBERS, "y", 2)
    return df.select(*kept)


@register(f"""WITH {_LONG}, z AS (SELECT feature, x, CASE WHEN y = 'R' THEN 1 ELSE 0 END AS y FROM l), g AS (SELECT feature, y, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS w FROM z GROUP BY ALL), a AS (SELECT feature, avg(x) AS m, count(*) AS t FROM z GROUP BY 1),
s AS (SELECT g.feature, sum(n * (g.m - a.m) ** 2) / (sum(w) / (any_value(t) - count(*))) AS score FROM g JOIN a ON a.feature = g.feature GROUP BY 1)
SELECT feature, CAST((SELECT count(*) FROM lineitem) AS BIGINT) AS rows FROM s ORDER BY score DESC LIMIT 2""")
def e18_selected(spark: SparkSession, d: str) -> DataFrame:
    """The names of the two features that Spark ML's test ranks first, against F statistics of two classes."""
    df = read(spark, d, "lineitem").withColumn("y", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    names = spark.createDataFrame([(c,) for c in fe.select_by_f(df, _NUMBERS, "y", 2)], "feature string")
    return names.crossJoin(F.broadcast(df.agg(F.count("*").alias("rows"))))  # one row


@register(f"""WITH {_LONG}, q AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS cuts FROM l GROUP BY 1),
c AS (SELECT l.feature, len(list_filter(cuts, lambda v: x > v)) AS b, y, count(*) AS n FROM l JOIN q ON q.feature = l.feature GROUP BY ALL),
j AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, b) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny FROM c)
SELECT feature, round(sum(n / t * ln(n * t / (nb * ny))), 8) AS score FROM j GROUP BY 1""")
def e20_mutual_information(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fe.mutual_information(read(spark, d, "lineitem"), _NUMBERS, "l_returnflag"), 8)


@register(None)
def e21_l1_scores(spark: SparkSession, d: str) -> DataFrame:
    return fe.l1_scores(read(spark, d, "lineitem"), ["l_quantity", "l_tax", "l_discount"], "l_extendedprice")


@register("""WITH m AS (SELECT count(*) AS n, stddev_samp(l_quantity) AS sx, stddev_samp(l_extendedprice) AS sy, stddev_pop(l_quantity) AS px, covar_pop(l_quantity, l_extendedprice) AS c FROM lineitem)
SELECT 'l_quantity' AS feature, round(greatest(abs(c) / (sx * sy) - 100.0 / sy, 0) / ((n - 1) / n) * sy / sx * px, 2) AS score FROM m""")
def e21_soft_threshold(spark: SparkSession, d: str) -> DataFrame:
    """A lasso of one feature: its correlation, drawn towards zero by the penalty."""
    return rounded(fe.l1_scores(read(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice", 100.0), 2)


@register("SELECT 'l_quantity' AS feature, 1.0::DOUBLE AS score, (SELECT count(*) FROM lineitem) AS rows UNION ALL SELECT 'same', 0.0, count(*) FROM lineitem")
def e22_only_feature(spark: SparkSession, d: str) -> DataFrame:
    """A forest gives all importance to the one feature that tells anything."""
    df = read(spark, d, "lineitem").withColumn("same", F.lit(1.0)).withColumn("y", F.col("l_quantity") * 2)
    out = rounded(fe.importance_scores(df, ["l_quantity", "same"], "y"))
    return out.crossJoin(F.broadcast(df.agg(F.count("*").alias("rows"))))  # one row


@register(None)
def e22_importance(spark: SparkSession, d: str) -> DataFrame:
    return fe.importance_scores(read(spark, d, "lineitem"), ["l_quantity", "l_tax", "l_discount"], "l_extendedprice")


@register("SELECT 'l_extendedprice' AS feature, 1 AS place, CAST(count(*) AS BIGINT) AS rows FROM lineitem UNION ALL SELECT 'l_tax', 2, CAST(count(*) AS BIGINT) FROM lineitem")
def e23_prune_redundant(spark: SparkSession, d: str) -> DataFrame:
    """Features kept of three, one of which copies another."""
    df = read(spark, d, "lineitem").withColumn("copy", F.col("l_extendedprice") * 2)
    kept = fe.prune_redundant(df, {"l_extendedprice": 3.0, "copy": 2.0, "l_tax": 1.0})
    names = spark.createDataFrame([(c, i + 1) for i, c in enumerate(kept)], "feature string, place int")
    return names.crossJoin(F.broadcast(df.agg(F.count("*").alias("rows"))))  # one row


@register("""WITH m AS (SELECT avg(l_quantity) AS mq, avg(l_tax) AS mt, var_pop(l_quantity) AS a, var_pop(l_tax) AS c, covar_pop(l_quantity, l_tax) AS b FROM lineitem),
e AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l2 FROM m), v AS (SELECT *, (l1 - c) / sqrt((l1 - c) ** 2 + b * b) AS vx, b / sqrt((l1 - c) ** 2 + b * b) AS vy FROM e)
SELECT l_orderkey, l_linenumber, l_partkey, round(((l_quantity - mq) * vx + (l_tax - mt) * vy) / sqrt(l1), 4) + 0.0 AS pc_1, round(((l_tax - mt) * vx - (l_quantity - mq) * vy) / sqrt(l2), 4) + 0.0 AS pc_2 FROM lineitem, v""")
def e24_pca_plane(spark: SparkSession, d: str) -> DataFrame:
    """Both whitened components of two features, whose axes have a closed form."""
    df = read(spark, d, "lineitem")
    out = fe.apply_pca(df, fe.fit_pca(df, ["l_quantity", "l_tax"], 2, whiten=True))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("pc_1", "pc_2")])


@register(None)
def e24_pca(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "lineitem")
    out = fe.apply_pca(df, fe.fit_pca(df, ["l_quantity", "l_discount", "l_tax"], 2, whiten=True))
    return out.select("l_orderkey", "l_linenumber", "pc_1", "pc_2")


@register(f"""WITH {_TRAIN}, s AS (SELECT avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS b FROM tr), c AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS i FROM tr GROUP BY 1)
SELECT o_orderkey, round((o_totalprice - a) / b, 6) AS o_totalprice, CAST(coalesce(i, -1) AS INTEGER) AS o_orderpriority__ordinal FROM orders LEFT JOIN c ON v = o_orderpriority, s""")
def e26_transform_saved(spark: SparkSession, d: str) -> DataFrame:
    """A state saved as JSON and applied later."""
    train, df = train_of(spark, d)
    recipe = [{"kind": "scale", "columns": ["o_totalprice"], "method": "standard"}, {"kind": "encode", "column": "o_orderpriority", "method": "ordinal"}]
    saved = json.dumps(fe.fit_recipe(train, recipe)[0])
    return rounded(fe.transform(df, json.loads(saved), recipe).select("o_orderkey", "o_totalprice", "o_orderpriority__ordinal"))


_ROLE = "CASE WHEN s < 0.2 THEN 'test' WHEN s < 0.2 + 0.1 THEN 'validation' ELSE 'training' END"


@register(f"SELECT o_orderkey, {_ROLE.replace('s <', _S + ' <')} AS split_role FROM orders")
def x1_random_split(spark: SparkSession, d: str) -> DataFrame:
    return sp.random_split(read(spark, d, "orders"), "o_orderkey").select("o_orderkey", "split_role")


@register(f"WITH r AS (SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY {h('o_orderkey', 42)}, o_orderkey) - 1) / count(*) OVER (PARTITION BY o_orderstatus) AS s FROM orders) SELECT o_orderkey, {_ROLE} AS split_role FROM r")
def x2_stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return sp.stratified_split(read(spark, d, "orders"), "o_orderkey", "o_orderstatus").select("o_orderkey", "split_role")


@register(f"WITH r AS (SELECT o_orderkey, ({h('o_custkey', 42)} % 1000000) / 1000000.0::DOUBLE AS s FROM orders) SELECT o_orderkey, {_ROLE} AS split_role FROM r")
def x3_group_split(spark: SparkSession, d: str) -> DataFrame:
    return sp.group_split(read(spark, d, "orders"), "o_custkey").select("o_orderkey", "split_role")


@register(f"WITH r AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) - 1) / count(*) OVER () AS s FROM orders) SELECT o_orderkey, {_ROLE} AS split_role FROM r")
def x4_time_split(spark: SparkSession, d: str) -> DataFrame:
    return sp.time_split(read(spark, d, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", "split_role")


@register(f"""SELECT o_orderkey, CAST({h('o_orderkey', 42)} % 5 AS INTEGER) AS kfold, CAST({h('o_custkey', 42)} % 5 AS INTEGER) AS groups, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {h('o_orderkey', 42)}, o_orderkey) - 1) % 5 AS INTEGER) AS strata,
CAST(ntile(5) OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS times, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS blocks FROM orders""")
def x5_folds(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    for name, method, column in (("kfold", "kfold", None), ("groups", "group", "o_custkey"), ("strata", "stratified", "o_orderstatus"), ("times", "time", "o_orderdate"), ("blocks", "unshuffled", None)):
        df = sp.folds(df, "o_orderkey", 5, method, column).withColumnRenamed(sp.FOLD, name)
    return df.select("o_orderkey", "kfold", "groups", "strata", "times", "blocks")


@register(f"WITH r AS (SELECT {_S} AS s FROM orders) SELECT {_ROLE} AS split_role, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1")
def x6_split_report(spark: SparkSession, d: str) -> DataFrame:
    df = sp.random_split(read(spark, d, "orders"), "o_orderkey")
    sp.check_split(df, "o_orderkey")
    return sp.split_report(df)


@register(f"""WITH f AS (SELECT o_totalprice AS x, {_FOLD} AS f FROM orders), k AS (SELECT unnest(range(3)) AS fold), s AS (SELECT fold, avg(x) FILTER (WHERE f <> fold) AS a, stddev_pop(x) FILTER (WHERE f <> fold) AS b FROM f, k GROUP BY 1)
SELECT CAST(fold AS INTEGER) AS cv_fold, CAST(count(*) AS BIGINT) AS n, round(avg((x - a) / b), 6) AS scaled_mean FROM f JOIN s ON f = fold GROUP BY 1""")
def x7_leak_safe_folds(spark: SparkSession, d: str) -> DataFrame:
    """Each fold scaled by what the other folds say."""
    df, parts = sp.folds(read(spark, d, "orders"), "o_orderkey", 3), []
    for k in range(3):
        state = fe.fit_scale(df.filter(F.col(sp.FOLD) != k), ["o_totalprice"])
        parts.append(fe.apply_scale(df.filter(F.col(sp.FOLD) == k), state))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rounded(out.groupBy(sp.FOLD).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("scaled_mean")))


@register("WITH f AS (SELECT o_totalprice AS x, ntile(4) OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS f FROM orders), k AS (SELECT unnest([1, 2, 3]) AS fold) SELECT CAST(fold AS INTEGER) AS fold, CAST(count(*) FILTER (WHERE f < fold) AS BIGINT) AS train_rows, CAST(count(*) FILTER (WHERE f = fold) AS BIGINT) AS test_rows FROM f, k GROUP BY 1")
def x8_forward_chain(spark: SparkSession, d: str) -> DataFrame:
    df, parts = sp.folds(read(spark, d, "orders"), "o_orderkey", 4, "time", "o_orderdate"), []
    for k in (1, 2, 3):
        a, b = sp.forward_chain(df, k)
        parts.append(a.agg(F.lit(k).alias("fold"), F.count("*").alias("train_rows")).crossJoin(F.broadcast(b.agg(F.count("*").alias("test_rows")))))  # one row each
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@register(" UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS count, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_values, round(" + (f"skewness({c}), 5" if c in ("p_partkey", "p_size", "p_retailprice") else "NULL::DOUBLE, 5") + ") AS skew FROM part" for c in _PART))
def h1_column_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(autoplan.column_profile(read(spark, d, "part"), _PART).select("column_name", "count", "distinct_values", "skew"), 5)


@register("""WITH c AS (SELECT count(*) AS n, count(DISTINCT o_custkey) AS u FROM orders) SELECT * FROM (VALUES ('o_orderkey', 'identifier'), ('o_custkey', 'numeric'), ('o_orderstatus', 'one_hot'), ('o_totalprice', 'numeric'), ('o_orderdate', 'datetime'), ('o_orderpriority', 'one_hot')) v(column_name, decision), (SELECT n AS rows FROM c)""")
def h2_decisions(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "orders")
    return autoplan.decisions(autoplan.column_profile(df)).crossJoin(F.broadcast(df.agg(F.count("*").alias("rows"))))  # one row


@register("""WITH s AS (SELECT skewness(value) AS k, min(value) AS lo FROM events) SELECT 'value' AS column_name, CASE WHEN abs(k) >= 2 AND lo >= 0 THEN 'log1p' WHEN lo >= 0 THEN 'sqrt' ELSE 'signed_log1p' END AS transform FROM s WHERE abs(k) >= 1""")
def h3_skew_transforms(spark: SparkSession, d: str) -> DataFrame:
    return autoplan.skew_transforms(autoplan.column_profile(read(spark, d, "events"), ["value", "user_id"]))


_W = " UNION ALL ".join(f"SELECT '{c}' AS c, stddev_pop({c}) / (max({c}) - min({c})) AS w FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


@register(f"WITH n AS ({_W}) SELECT a.c AS a, b.c AS b, round(a.w * b.w, 6) AS score FROM n a JOIN n b ON a.c < b.c ORDER BY round(a.w * b.w, 9) DESC, a.c, b.c LIMIT 5")
def h4_interaction_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(autoplan.interaction_pairs(autoplan.column_profile(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])))
