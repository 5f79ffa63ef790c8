"""Training, scoring and evaluation over orders and lineitem."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.functions.lineage import pinned
from marlpit.functions.semantics import portable_hash
from marlpit.operators import evaluation as ev
from marlpit.operators import models as mo
from marlpit.operators import splits as sp
from marlpit.queries.registry import collector, read, rounded

QUERIES, ORACLE_SQL, register = collector()


def h(expr: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5({expr} || '|' || {seed}), 1, 15) AS BIGINT)"


#: Predictions made from the orders themselves: the actual class, a score with ties that leans towards it, a missing actual now and then.
_P = f"""p AS (SELECT o_orderkey, o_orderpriority, CASE WHEN {h('o_orderkey', 1)} % 20 = 0 THEN NULL ELSE o_orderstatus END AS actual,
CASE WHEN {h('o_orderkey', 2)} % 10 < 7 THEN o_orderstatus WHEN {h('o_orderkey', 3)} % 2 = 0 THEN 'F' ELSE 'O' END AS predicted,
least(99, {h('o_orderkey', 4)} % 100 + CASE WHEN o_orderstatus = 'F' THEN 25 ELSE 0 END) / 100.0::DOUBLE AS score FROM orders)"""
_R = f"r AS (SELECT l_orderkey, l_extendedprice AS actual, l_quantity * 1500.0 + {h('l_orderkey', 5)} % 1000 AS predicted FROM lineitem)"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    hh = lambda seed, m: F.pmod(portable_hash(k, F.lit(seed)), F.lit(m))
    predicted = F.when(hh(2, 10) < 7, F.col("o_orderstatus")).when(hh(3, 2) == 0, "F").otherwise("O")
    score = F.least(F.lit(99), hh(4, 100) + F.when(F.col("o_orderstatus") == "F", 25).otherwise(0)) / F.lit(100.0)
    return read(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.when(hh(1, 20) != 0, F.col("o_orderstatus")).alias("actual"), predicted.alias("predicted"), score.alias("score"))


def numbers(spark: SparkSession, d: str) -> DataFrame:
    noise = F.pmod(portable_hash(F.col("l_orderkey"), F.lit(5)), F.lit(1000))
    return read(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 1500.0 + noise).alias("predicted"))


_C = f"""{_P}, e AS (SELECT * FROM p WHERE actual IS NOT NULL), l AS (SELECT actual AS label FROM e UNION SELECT predicted FROM e),
c AS (SELECT label, (SELECT count(*) FROM e WHERE actual = label) AS support, (SELECT count(*) FROM e WHERE predicted = label) AS predicted, (SELECT count(*) FROM e WHERE predicted = label AND actual = label) AS hits FROM l),
k AS (SELECT *, hits / nullif(predicted, 0) AS precision, hits / nullif(support, 0) AS recall, 2 * hits / nullif(support + predicted, 0) AS f1 FROM c)"""


@register(f"WITH {_C} SELECT label, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, CAST(hits AS BIGINT) AS hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM k")
def r1_class_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.class_report(predictions(spark, d), "actual", "predicted"))


@register(f"""WITH {_C} SELECT CAST(sum(support) AS BIGINT) AS evaluated, round(sum(hits) / sum(support), 6) AS accuracy, round(avg(recall) FILTER (WHERE support > 0), 6) AS balanced_accuracy, round(avg(coalesce(precision, 0)), 6) AS macro_precision,
round(avg(coalesce(recall, 0)), 6) AS macro_recall, round(avg(coalesce(f1, 0)), 6) AS macro_f1, round(sum(coalesce(f1, 0) * support) / sum(support), 6) AS weighted_f1 FROM k""")
def r2_classification_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.classification_summary(predictions(spark, d), "actual", "predicted"))


@register(f"WITH {_C} SELECT a.label AS actual, b.label AS predicted, CAST((SELECT count(*) FROM e WHERE e.actual = a.label AND e.predicted = b.label) AS BIGINT) AS n FROM k a, k b")
def r3_confusion(spark: SparkSession, d: str) -> DataFrame:
    return ev.confusion(predictions(spark, d), "actual", "predicted")


_G = f"""{_P}, g AS (SELECT score, count(*) FILTER (WHERE actual = 'F') AS pos, count(*) FILTER (WHERE actual <> 'F') AS neg FROM p WHERE actual IS NOT NULL GROUP BY 1),
w AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM g)"""


@register(f"WITH {_G} SELECT round(sum(neg * (tp - pos + pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS average_precision FROM w")
def r4_r5_ranking(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.ranking(predictions(spark, d), "actual", "score", "F"))


@register(f"""WITH {_G}, b AS (SELECT CAST(ceil(sum(pos + neg) OVER (ORDER BY score DESC) * 100.0::DOUBLE / (SELECT sum(pos + neg) FROM g)) AS INTEGER) AS bin, score, pos, neg FROM g), s AS (SELECT bin, min(score) AS threshold, sum(pos) AS pos, sum(neg) AS neg FROM b GROUP BY 1),
t AS (SELECT *, sum(pos) OVER (ORDER BY bin) AS tp, sum(neg) OVER (ORDER BY bin) AS fp, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM s)
SELECT bin, threshold, round(tp / ap, 6) AS tpr, round(fp / an, 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM t""")
def r6_curves(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.curves(predictions(spark, d), "actual", "score", "F"))


@register(f"WITH {_P}, y AS (SELECT (actual = 'F')::INT AS y, score AS p, least(greatest(score, 1e-15), 1 - 1e-15) AS q FROM p WHERE actual IS NOT NULL) SELECT round(avg((p - y) ** 2), 6) AS brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss FROM y")
def r7_losses(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.probability_losses(predictions(spark, d), "actual", "score", "F"))


@register(f"WITH {_P} SELECT CAST(least(9, floor(score * 10)) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS mean_score, round(avg((actual = 'F')::INT), 6) AS rate FROM p WHERE actual IS NOT NULL GROUP BY 1")
def r8_calibration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.calibration(predictions(spark, d), "actual", "score", "F"))


@register(f"WITH {_P} SELECT actual, CAST(least(19, floor(score * 20)) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n FROM p WHERE actual IS NOT NULL GROUP BY ALL")
def r9_score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ev.score_histogram(predictions(spark, d), "actual", "score")


@register(f"""WITH {_R}, m AS (SELECT *, actual - predicted AS e, (SELECT avg(actual) FROM r) AS m FROM r)
SELECT CAST(count(*) AS BIGINT) AS evaluated, round(avg(abs(e)), 3) AS mae, round(sqrt(avg(e * e)), 3) AS rmse, round(1 - sum(e * e) / sum((actual - m) ** 2), 6) AS r2, round(avg(e), 3) AS mean_residual, round(avg(abs(e / nullif(actual, 0))), 6) AS mape,
round(stddev_samp(e), 3) AS residual_sd, round(quantile_cont(e, 0.05), 3) AS p05, round(quantile_cont(e, 0.5), 3) AS p50, round(quantile_cont(e, 0.95), 3) AS p95 FROM m""")
def r10_regression_summary(spark: SparkSession, d: str) -> DataFrame:
    out = ev.regression_summary(numbers(spark, d), "actual", "predicted").withColumns({"r2": F.round("r2", 6), "mape": F.round("mape", 6)})
    return out.withColumns({c: F.round(c, 3) for c in ("mae", "rmse", "mean_residual", "residual_sd", "p05", "p50", "p95")})


@register(f"""WITH {_R}, e AS (SELECT actual - predicted AS e FROM r), b AS (SELECT min(e) AS lo, max(e) AS hi FROM e), c AS (SELECT CAST(least(19, floor((e - lo) / ((hi - lo) / 20))) AS INTEGER) AS bin, count(*) AS n FROM e, b GROUP BY 1)
SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + (hi - lo) / 20 * g.bin, 3) AS lower, round(CASE WHEN g.bin = 19 THEN hi ELSE lo + (hi - lo) / 20 * (g.bin + 1) END, 3) AS upper, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest(range(20)) AS bin) g LEFT JOIN c ON c.bin = g.bin, b""")
def r11_residual_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.residual_histogram(numbers(spark, d), "actual", "predicted"), 3)


_PROBS = ", ".join(f"{i / 100}" for i in range(1, 100))
_NORMALS = ", ".join(f"{NormalDist().inv_cdf(i / 100):.12f}" for i in range(1, 100))


@register(f"WITH {_R}, q AS (SELECT quantile_cont(actual - predicted, [{_PROBS}]) AS q FROM r) SELECT CAST(i AS INTEGER) AS p, round(q[i], 3) AS residual, round(([{_NORMALS}]::DOUBLE[])[i], 6) AS normal FROM q, (SELECT unnest(range(1, 100)) AS i)")
def r12_qq_points(spark: SparkSession, d: str) -> DataFrame:
    out = ev.qq_points(numbers(spark, d), "actual", "predicted")
    return out.withColumns({"residual": F.round("residual", 3), "normal": F.round("normal", 6) + F.lit(0.0)})


@register(f"WITH {_P} SELECT o_orderkey, actual, predicted FROM p WHERE actual IS NOT NULL ORDER BY {h('o_orderkey', 11)}, o_orderkey LIMIT 500")
def r13_sample(spark: SparkSession, d: str) -> DataFrame:
    from marlpit.operators.transforms import hash_sample

    return hash_sample(predictions(spark, d).filter("actual IS NOT NULL"), "o_orderkey", 11, 500).select("o_orderkey", "actual", "predicted")


@register(f"WITH {_P} SELECT CAST(count(*) AS BIGINT) AS scanned, CAST(count(actual) AS BIGINT) AS evaluated, CAST(count(*) - count(actual) AS BIGINT) AS excluded, 'evaluated' AS status FROM p")
def r14_scope(spark: SparkSession, d: str) -> DataFrame:
    return ev.scope(predictions(spark, d), "actual")


@register(f"""WITH {_P}, a AS (SELECT o_orderkey, actual FROM p WHERE actual IS NOT NULL AND o_orderkey % 7 <> 0) SELECT CAST(count(*) AS BIGINT) AS predictions, CAST(count(a.o_orderkey) AS BIGINT) AS matched, CAST((SELECT count(*) FROM a) AS BIGINT) AS actuals,
CAST(count(*) - count(a.o_orderkey) AS BIGINT) AS unmatched_predictions, CAST(0 AS BIGINT) AS unmatched_actuals, round(avg((a.actual = predicted)::INT), 6) AS accuracy FROM p LEFT JOIN a ON a.o_orderkey = p.o_orderkey""")
def r15_performance(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    truth = p.filter("actual IS NOT NULL AND o_orderkey % 7 <> 0").select("o_orderkey", F.col("actual").alias("status"))
    joined, diagnostics = ev.join_actuals(p.drop("actual"), truth, "o_orderkey", "o_orderkey", "status")
    accuracy = ev.classification_summary(joined, "actual", "predicted").select("accuracy")
    return rounded(diagnostics.crossJoin(F.broadcast(accuracy)))  # one row each


@register(f"WITH {_P} SELECT CAST(count(*) AS BIGINT) AS n, round(avg((actual = predicted)::INT), 6) AS accuracy FROM p WHERE actual IS NOT NULL")
def m14_in_flight(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mo.in_flight(predictions(spark, d).filter("actual IS NOT NULL"), "actual", "predicted", "classification"))


@register("WITH c AS (SELECT o_orderstatus AS prediction, count(*) AS n FROM orders GROUP BY 1) SELECT prediction, round(n / (SELECT sum(n) FROM c), 6) AS share FROM c ORDER BY n DESC, prediction LIMIT 1")
def m2_baseline(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mo.baseline(read(spark, d, "orders"), "o_orderstatus", "classification"))


_FOLDS = f"WITH {_P}, f AS (SELECT CAST({h('o_orderkey', 42)} % 5 AS INTEGER) AS f, avg((actual = predicted)::INT) AS accuracy, count(actual) AS n FROM p WHERE actual IS NOT NULL GROUP BY 1)"


@register(f"{_FOLDS} SELECT round(avg(accuracy), 6) AS mean, round(sum(accuracy * n) / sum(n), 6) AS weighted_mean, round(stddev_samp(accuracy), 6) AS sd, round(min(accuracy), 6) AS minimum, round(max(accuracy), 6) AS maximum, CAST(count(*) AS BIGINT) AS folds FROM f")
def m11_fold_summary(spark: SparkSession, d: str) -> DataFrame:
    p = sp.folds(predictions(spark, d), "o_orderkey", 5)
    scores = ev.classification_summary(p, "actual", "predicted", [sp.FOLD])
    return rounded(ev.fold_summary(scores, "accuracy", "evaluated"))


_HIGH = f"WITH l AS (SELECT CAST({h('l_orderkey', 42)} % 4 AS INTEGER) AS f, l_returnflag AS feature, avg(l_quantity) AS q FROM lineitem GROUP BY ALL), c AS (SELECT f, max_by(feature, (round(q, 9), feature)) AS feature FROM l GROUP BY 1)"


@register(f"{_HIGH} SELECT feature, CAST(count(*) AS BIGINT) AS folds, round(count(*) / 4, 6) AS share FROM c GROUP BY 1")
def m11_selection_frequency(spark: SparkSession, d: str) -> DataFrame:
    """How often each is chosen over four folds (here: the flag with the largest mean quantity of the fold)."""
    means = sp.folds(read(spark, d, "lineitem"), "l_orderkey", 4).groupBy(sp.FOLD, F.col("l_returnflag").alias("feature")).agg(F.avg("l_quantity").alias("q"))
    chosen = means.groupBy(sp.FOLD).agg(F.max_by("feature", F.struct(F.round("q", 9), "feature")).alias("feature"))
    return rounded(ev.selection_frequency(chosen))


@register(f"WITH {_G} SELECT round(sum(neg * (tp - pos + pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS average_precision FROM w".replace("actual = 'F'", "actual = 'P'").replace("actual <> 'F'", "actual <> 'P'"))
def r4_inferred_positive(spark: SparkSession, d: str) -> DataFrame:
    """No positive class is given: it is the last of F, O and P."""
    return rounded(ev.ranking(predictions(spark, d), "actual", "score"))


# --- models whose solution has a closed form ----------------------------------------------------------------------

_SPLIT = f"s AS (SELECT *, {h('o_orderkey', 42)} % 1000000 / 1000000.0 AS u FROM o)"
_FLAGS = f"""o AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'other' END AS label, CAST(o_totalprice > 150000 AS DOUBLE) AS dear, CAST(o_orderdate < TIMESTAMP '1995-06-01' AS DOUBLE) AS old,
CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS DOUBLE) AS urgent, CASE WHEN (o_orderdate < TIMESTAMP '1995-06-01') = ({h('o_orderkey', 9)} % 10 < 8) THEN 'yes' ELSE 'no' END AS noisy,
CASE WHEN {h('o_orderkey', 12)} % 10 < 2 THEN substr('abc', CAST({h('o_orderkey', 13)} % 3 AS INT) + 1, 1) WHEN o_orderdate < TIMESTAMP '1995-06-01' THEN 'a' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'b' ELSE 'c' END AS trio,
CASE WHEN {h('o_orderkey', 14)} % 10 < CASE WHEN o_orderdate < TIMESTAMP '1995-06-01' THEN 3 ELSE 1 END THEN 'yes' ELSE 'no' END AS scarce, o_totalprice / 1000 AS price, CAST(datediff('day', o_orderdate, TIMESTAMP '1999-01-01') AS DOUBLE) AS age FROM orders), {_SPLIT},
tr AS (SELECT * FROM s WHERE u >= 0.3), te AS (SELECT * FROM s WHERE u < 0.2)"""


def flags(spark: SparkSession, d: str) -> DataFrame:
    """orders with classes, three flags and two numbers, split by a hash. noisy follows the age in four of five rows, trio a cell of two flags; scarce has few rows of one class."""
    df = read(spark, d, "orders")
    is_true = {"dear": F.col("o_totalprice") > 150000, "old": F.col("o_orderdate") < "1995-06-01", "urgent": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")}
    df = df.withColumns({c: x.cast("double") for c, x in is_true.items()} | {"price": F.col("o_totalprice") / 1000, "age": F.datediff(F.lit("1999-01-01"), "o_orderdate").cast("double")})
    df = df.withColumn("label", F.when(F.col("o_orderstatus") == "F", "F").otherwise("other"))
    mostly = F.pmod(portable_hash(F.col("o_orderkey"), F.lit(9)), F.lit(10)) < 8
    df = df.withColumn("noisy", F.when((F.col("old") == 1) == mostly, "yes").otherwise("no"))
    drawn = lambda seed, m: F.pmod(portable_hash(F.col("o_orderkey"), F.lit(seed)), F.lit(m))
    cell = F.when(F.col("old") == 1, "a").when(F.col("urgent") == 1, "b").otherwise("c")
    df = df.withColumn("trio", F.when(drawn(12, 10) < 2, F.get(F.array(*map(F.lit, "abc")), drawn(13, 3).cast("int"))).otherwise(cell))
    df = df.withColumn("scarce", F.when(drawn(14, 10) < F.when(F.col("old") == 1, 3).otherwise(1), "yes").otherwise("no"))
    return pinned(sp.random_split(df.select("o_orderkey", "o_totalprice", "label", "noisy", "trio", "scarce", "dear", "old", "urgent", "price", "age"), "o_orderkey"))


def scored(spark: SparkSession, d: str, spec: mo.Spec) -> DataFrame:
    """Test rows scored by a model of the training rows."""
    df = flags(spark, d)
    return mo.score(df.filter("split_role = 'test'"), mo.fit(df.filter("split_role = 'training'"), spec), "o_orderkey", ["dear"])


@register(f"WITH {_FLAGS}, r AS (SELECT old, avg((label = 'other')::INT) AS p FROM tr GROUP BY 1) SELECT o_orderkey, CASE WHEN p > 0.5 THEN 'other' ELSE 'F' END AS prediction, round(p, 3) AS prediction_score FROM te JOIN r ON r.old = te.old")
def m3_logistic_rates(spark: SparkSession, d: str) -> DataFrame:
    """Of one flag an unpenalised logistic model learns the two rates. Every test row is scored (M13)."""
    out = scored(spark, d, mo.Spec("classification", "label", ("old",), "logistic", {"tol": 1e-9}))
    return out.select("o_orderkey", "prediction", F.round("prediction_score", 3).alias("prediction_score"))


@register(f"""WITH {_FLAGS}, m AS (SELECT covar_pop(age, age) AS saa, covar_pop(urgent, urgent) AS suu, covar_pop(age, urgent) AS sau, covar_pop(age, price) AS say, covar_pop(urgent, price) AS suy, avg(age) AS ma, avg(urgent) AS mu, avg(price) AS my FROM tr),
b AS (SELECT (say * suu - suy * sau) / (saa * suu - sau * sau) AS ba, (suy * saa - say * sau) / (saa * suu - sau * sau) AS bu, ma, mu, my FROM m)
SELECT o_orderkey, round(my + ba * (age - ma) + bu * (urgent - mu), 3) AS prediction FROM te, b""")
def m4_least_squares(spark: SparkSession, d: str) -> DataFrame:
    out = scored(spark, d, mo.Spec("regression", "price", ("age", "urgent"), "linear"))
    return out.select("o_orderkey", F.round("prediction", 3).alias("prediction"))


def _rates(family: str) -> str:
    return f"WITH {_FLAGS}, r AS (SELECT old, avg(price) AS p FROM tr GROUP BY 1) SELECT o_orderkey, round(p, 2) AS prediction FROM te JOIN r ON r.old = te.old"


@register(_rates("poisson"))
def m5_poisson_rates(spark: SparkSession, d: str) -> DataFrame:
    """Of one flag the model learns the two means, whatever its family."""
    out = scored(spark, d, mo.Spec("regression", "price", ("old",), "glm", {"family": "poisson", "link": "log", "tol": 1e-9}))
    return out.select("o_orderkey", F.round("prediction", 2).alias("prediction"))


@register(_rates("tweedie"))
def m5_tweedie_rates(spark: SparkSession, d: str) -> DataFrame:
    out = scored(spark, d, mo.Spec("regression", "price", ("old",), "glm", {"family": "tweedie", "variancePower": 1.5, "linkPower": 0.0, "tol": 1e-9}))
    return out.select("o_orderkey", F.round("prediction", 2).alias("prediction"))


@register(f"WITH {_FLAGS}, r AS (SELECT old, avg((noisy = 'yes')::INT) AS p FROM tr GROUP BY 1) SELECT o_orderkey, CASE WHEN p > 0.5 THEN 'yes' ELSE 'no' END AS prediction, round(p, 6) AS prediction_score FROM te JOIN r ON r.old = te.old")
def m6_tree_rates(spark: SparkSession, d: str) -> DataFrame:
    """A tree of one flag that tells the classes apart has a leaf for each of its values (leaves with one prediction would be merged)."""
    out = scored(spark, d, mo.Spec("classification", "noisy", ("old",), "decision_tree", {"maxDepth": 2}))
    return out.select("o_orderkey", "prediction", F.round("prediction_score", 6).alias("prediction_score"))


_CELLS = "old, urgent"
_TRIO = f"r AS (SELECT {_CELLS}, " + ", ".join(f"1 / (1 + exp(-2 * (2 * avg((trio = '{c}')::INT) - 1))) AS p{c}" for c in "abc") + " FROM tr GROUP BY ALL)"


@register(f"""WITH {_FLAGS}, {_TRIO}, q AS (SELECT {_CELLS}, pa / (pa + pb + pc) AS a, pb / (pa + pb + pc) AS b, pc / (pa + pb + pc) AS c FROM r)
SELECT o_orderkey, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS prediction, round(greatest(a, b, c), 6) AS prediction_score,
round(a, 6) AS probability_a, round(b, 6) AS probability_b, round(c, 6) AS probability_c FROM te JOIN q USING ({_CELLS})""")
def m6_boosting_classes(spark: SparkSession, d: str) -> DataFrame:
    """Three classes by boosting, one against the rest each. The one tree of a single round has the mean of -1 and 1 of each cell in its leaf."""
    return rounded(scored(spark, d, mo.Spec("classification", "trio", ("old", "urgent"), "gradient_boosting", {"maxIter": 1, "maxDepth": 2})).drop("dear"))


_MAJORITY = f"m AS (SELECT {_CELLS}, max_by(trio, n) AS prediction FROM (SELECT {_CELLS}, trio, count(*) AS n FROM tr GROUP BY ALL) GROUP BY ALL)"


@register(f"WITH {_FLAGS}, {_MAJORITY} SELECT o_orderkey, prediction, 1.0::DOUBLE AS total, true AS inside FROM te JOIN m USING ({_CELLS})")
def m3_svc_classes(spark: SparkSession, d: str) -> DataFrame:
    """Three classes by linear SVC with calibrated probabilities: the prediction is each cell's usual class, probabilities lie between 0 and 1 and sum to 1."""
    out = scored(spark, d, mo.Spec("classification", "trio", ("old", "urgent"), "linear_svc", {"maxIter": 15}, calibrate=0.3, key="o_orderkey"))
    shares = [F.col(f"probability_{c}") for c in "abc"]
    return out.select("o_orderkey", "prediction", F.round(sum(shares[1:], shares[0]), 6).alias("total"), F.forall(F.array(*shares), lambda x: x.between(0, 1)).alias("inside"))


@register(f"""WITH {_FLAGS}, r AS (SELECT old, avg((noisy = 'yes')::INT) AS p FROM tr WHERE {h('o_orderkey', 11)} % 1000000 / 1000000.0 < 0.3 GROUP BY 1)
SELECT o_orderkey, CASE WHEN p > 0.5 THEN 'yes' ELSE 'no' END AS prediction, round(p, 3) AS prediction_score, round(1 - p, 3) AS probability_no, round(p, 3) AS probability_yes FROM te JOIN r ON r.old = te.old""")
def m13_calibrated_rates(spark: SparkSession, d: str) -> DataFrame:
    """Of two margins the calibration learns the rates of the rows that were held out for it."""
    return rounded(scored(spark, d, mo.Spec("classification", "noisy", ("old",), "linear_svc", {"maxIter": 15}, calibrate=0.3, key="o_orderkey")).drop("dear"), 3)


_BALANCED = f"""WITH {_FLAGS}, n AS (SELECT count(*) AS n, count_if(scarce = 'yes') AS y FROM tr), w AS (SELECT n / (2.0 * y) AS wy, n / (2.0 * (n - y)) AS wn FROM n),
r AS (SELECT old, sum(CASE WHEN scarce = 'yes' THEN wy ELSE 0 END) / sum(CASE WHEN scarce = 'yes' THEN wy ELSE wn END) AS p FROM tr, w GROUP BY 1)
SELECT o_orderkey, CASE WHEN p > 0.5 THEN 'yes' ELSE 'no' END AS prediction, round(p, DIGITS) AS prediction_score FROM te JOIN r ON r.old = te.old"""


@register(_BALANCED.replace("DIGITS", "6"))
def a7_weighted_tree(spark: SparkSession, d: str) -> DataFrame:
    """Balanced class weights in a tree: the leaves of a flag have weighted rates."""
    out = scored(spark, d, mo.Spec("classification", "scarce", ("old",), "decision_tree", {"maxDepth": 2}, class_weight="balanced"))
    return rounded(out.select("o_orderkey", "prediction", "prediction_score"))


@register(_BALANCED.replace("DIGITS", "3"))
def a7_weighted_logistic(spark: SparkSession, d: str) -> DataFrame:
    out = scored(spark, d, mo.Spec("classification", "scarce", ("old",), "logistic", {"tol": 1e-9}, class_weight="balanced"))
    return rounded(out.select("o_orderkey", "prediction", "prediction_score"), 3)


def _macro_f1(rows: str, by: str) -> str:
    """SQL: macro F1 of (actual, p) by some keys; labels that are only predicted count as 0."""
    sides = f"SELECT {by}, actual AS label, 1 AS s, 0 AS q, (actual = p)::INT AS h FROM {rows} UNION ALL SELECT {by}, p, 0, 1, 0 FROM {rows}"
    return f"SELECT {by}, avg(f1) AS score FROM (SELECT {by}, label, 2.0 * sum(h) / (sum(s) + sum(q)) AS f1 FROM ({sides}) GROUP BY {by}, label) GROUP BY {by}"


@register(f"""WITH {_FLAGS}, f AS (SELECT *, CAST({h('o_orderkey', 42)} % 3 AS INT) AS cv_fold FROM o), g AS (SELECT cv_fold, old, noisy, count(*) AS n FROM f GROUP BY ALL),
t AS (SELECT k.cv_fold, old, noisy, sum(n) AS n FROM g JOIN (SELECT DISTINCT cv_fold FROM g) k ON k.cv_fold <> g.cv_fold GROUP BY ALL),
one AS (SELECT cv_fold, old, max_by(noisy, n) AS p FROM t GROUP BY ALL), none AS (SELECT cv_fold, max_by(noisy, n) AS p FROM (SELECT cv_fold, noisy, sum(n) AS n FROM t GROUP BY ALL) GROUP BY ALL),
x AS (SELECT 'maxDepth=0' AS params, cv_fold, noisy AS actual, p FROM f JOIN none USING (cv_fold) UNION ALL SELECT 'maxDepth=1', cv_fold, noisy, p FROM f JOIN one USING (cv_fold, old)),
n AS (SELECT params, cv_fold, count(*) AS evaluated FROM x GROUP BY ALL)
SELECT params, cv_fold, evaluated, round(score, 6) AS score FROM ({_macro_f1('x', 'params, cv_fold')}) JOIN n USING (params, cv_fold)""")
def m9_fold_scores(spark: SparkSession, d: str) -> DataFrame:
    """A search over the depth of a tree of one flag: macro F1 of every fold, learned from the other folds."""
    df = sp.folds(flags(spark, d), "o_orderkey", 3)
    return rounded(mo.fold_scores(df, mo.Spec("classification", "noisy", ("old",), "decision_tree"), {"maxDepth": [0, 1]}, sp.FOLD, "f1_macro"))


@register(f"""WITH {_FLAGS}, {_MAJORITY}, x AS (SELECT algorithm, trio AS actual, prediction AS p FROM s JOIN m USING ({_CELLS}), (SELECT unnest(['logistic', 'decision_tree', 'gradient_boosting', 'mlp']) AS algorithm) WHERE u >= 0.2 AND u < 0.3)
SELECT algorithm, 'f1_macro' AS metric, round(score, 6) AS score FROM ({_macro_f1('x', 'algorithm')})""")
def m10_compare_classes(spark: SparkSession, d: str) -> DataFrame:
    """Four algorithms of three classes, one of them a network, under one metric. All learn each cell's usual class."""
    df = flags(spark, d)
    params = {"logistic": {}, "decision_tree": {"maxDepth": 2}, "gradient_boosting": {"maxIter": 2, "maxDepth": 2}, "mlp": {"layers": [2, 5, 3], "maxIter": 60}}
    specs = [mo.Spec("classification", "trio", ("old", "urgent"), a, p) for a, p in params.items()]
    return rounded(mo.compare(df.filter("split_role = 'training'"), df.filter("split_role = 'validation'"), specs)[1])


@register(f"""WITH {_FLAGS}, e AS (SELECT 1e-9 * greatest(var_pop(price), var_pop(age)) AS e FROM tr), c AS (SELECT label, ln(count(*) / (SELECT count(*) FROM tr)) AS prior, avg(price) AS mp, var_pop(price) + any_value(e) AS vp, avg(age) AS ma, var_pop(age) + any_value(e) AS va FROM tr, e GROUP BY 1),
l AS (SELECT o_orderkey, label, prior - 0.5 * (ln(vp) + (price - mp) ** 2 / vp + ln(va) + (age - ma) ** 2 / va) AS l FROM (SELECT o_orderkey, price, age FROM te), c)
SELECT o_orderkey, max_by(label, l) AS prediction FROM l GROUP BY 1""")
def m7_gaussian_rows(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, mo.Spec("classification", "label", ("price", "age"), "naive_bayes", {"modelType": "gaussian"})).select("o_orderkey", "prediction")


@register(f"""WITH {_FLAGS}, k AS (SELECT label, count(*) AS n, sum(dear) AS dear, sum(old) AS old, sum(urgent) AS urgent FROM tr GROUP BY 1),
c AS (SELECT label, ln(n + 1) - ln(sum(n) OVER () + 2) AS prior, (dear + 1) / (n + 2) AS pd, (old + 1) / (n + 2) AS po, (urgent + 1) / (n + 2) AS pu FROM k),
l AS (SELECT o_orderkey, c.label, prior + ln(CASE WHEN dear = 1 THEN pd ELSE 1 - pd END) + ln(CASE WHEN old = 1 THEN po ELSE 1 - po END) + ln(CASE WHEN urgent = 1 THEN pu ELSE 1 - pu END) AS l FROM te, c)
SELECT o_orderkey, max_by(label, l) AS prediction, round(1 / (1 + exp(max(l) FILTER (WHERE label = 'F') - max(l) FILTER (WHERE label = 'other'))), 6) AS prediction_score FROM l GROUP BY 1""")
def m7_bernoulli_rows(spark: SparkSession, d: str) -> DataFrame:
    out = scored(spark, d, mo.Spec("classification", "label", ("dear", "old", "urgent"), "naive_bayes", {"modelType": "bernoulli"}))
    return out.select("o_orderkey", "prediction", F.round("prediction_score", 6).alias("prediction_score"))


# --- models: no SQL form -----------------------------------------------------------------------------------------

_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "age")
_BIG = ("l_quantity", "l_discount", "l_tax")


def learnable(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Some columns of lineitem with a unique row id, its age and a class to learn. Equal keys have equal ids, so rows meet by the keys, before what follows from them is computed."""
    from marlpit.operators.transforms import hash_identifier

    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    df = read(spark, d, "lineitem").dropDuplicates(keys).withColumn("age", F.datediff(F.lit("1999-01-01"), "l_shipdate").cast("double"))
    df = df.withColumn("label", F.when(F.col("l_quantity") * 1000 + F.col("age") * 5 > 33000, "high").otherwise("low"))
    return hash_identifier(df, "row_id", keys).select("row_id", *columns)


def _trained(spark: SparkSession, d: str, task: str, algorithm: str, params: dict | None = None) -> DataFrame:
    spec = mo.Spec(task, "label" if task == "classification" else "l_extendedprice", _NUMERIC if task == "classification" else _BIG, algorithm, params or {})
    df = sp.random_split(learnable(spark, d, *spec.features, spec.target), "row_id")
    df = pinned(df.withColumn("row_id", F.when(F.col("split_role") == "test", F.unhex("row_id"))))  # in half the bytes, and of the rows that are scored
    fitted = mo.fit(df.filter("split_role = 'training'"), spec)
    scored = mo.score(df.filter("split_role = 'test'"), fitted, "row_id", [spec.target])
    return ev.classification_summary(scored, "label", "prediction") if task == "classification" else ev.regression_summary(scored, "l_extendedprice", "prediction")


@register(None)
def m3_logistic(spark: SparkSession, d: str) -> DataFrame:
    return _trained(spark, d, "classification", "logistic", {"regParam": 0.01, "elasticNetParam": 0.5})


@register(None)
def m3_linear_svc(spark: SparkSession, d: str) -> DataFrame:
    return _trained(spark, d, "classification", "linear_svc", {"maxIter": 20})


@register(None)
def m4_linear(spark: SparkSession, d: str) -> DataFrame:
    return _trained(spark, d, "regression", "linear", {"regParam": 0.1})


@register(None)
def m4_huber(spark: SparkSession, d: str) -> DataFrame:
    return _trained(spark, d, "regression", "linear", {"loss": "huber", "maxIter": 30})


@register(None)
def m5_glm_poisson(spark: SparkSession, d: str) -> DataFrame:
    return _trained(spark, d, "regression", "glm", {"family": "poisson", "link": "log", "maxIter": 10})


@register(None)
def m5_glm_tweedie(spark: SparkSession, d: str) -> DataFrame:
    return _trained(spark, d, "regression", "glm", {"family": "tweedie", "variancePower": 1.5, "maxIter": 10})


@register(None)
def m6_random_forest(spark: SparkSession, d: str) -> DataFrame:
    return _trained(spark, d, "classification", "random_forest", {"numTrees": 10, "maxDepth": 5})


@register(None)
def m6_gradient_boosting(spark: SparkSession, d: str) -> DataFrame:
    return _trained(spark, d, "regression", "gradient_boosting", {"maxIter": 5, "maxDepth": 4})


@register(None)
def m6_decision_tree(spark: SparkSession, d: str) -> DataFrame:
    return _trained(spark, d, "classification", "decision_tree", {"maxDepth": 5})


@register(None)
def m7_naive_bayes(spark: SparkSession, d: str) -> DataFrame:
    return _trained(spark, d, "classification", "naive_bayes", {"modelType": "gaussian"})


@register(None)
def m7_complement(spark: SparkSession, d: str) -> DataFrame:
    """Scores of test rows by complement naive Bayes on counts."""
    return scored(spark, d, mo.Spec("classification", "label", ("dear", "old", "urgent", "price"), "naive_bayes", {"modelType": "complement"}))


@register(None)
def m8_mlp(spark: SparkSession, d: str) -> DataFrame:
    return _trained(spark, d, "classification", "mlp", {"layers": [5, 4, 2], "maxIter": 15})


@register(None)
def m9_search(spark: SparkSession, d: str) -> DataFrame:
    df = sp.folds(learnable(spark, d, *_NUMERIC, "label"), "row_id", 3)  # the search keeps what it needs of it
    spec = mo.Spec("classification", "label", _NUMERIC, "logistic", {"maxIter": 10})
    return mo.search(df, spec, {"regParam": [0.001, 0.1], "elasticNetParam": [0.0, 1.0]}, folds=sp.FOLD, n=3)[1]


@register(None)
def m10_compare(spark: SparkSession, d: str) -> DataFrame:
    df = pinned(sp.random_split(learnable(spark, d, *_NUMERIC, "label"), "row_id"))
    specs = [mo.Spec("classification", "label", _NUMERIC, a, p) for a, p in (("logistic", {"maxIter": 10}), ("decision_tree", {"maxDepth": 4}))]
    return mo.compare(df.filter("split_role = 'training'"), df.filter("split_role = 'validation'"), specs)[1]


@register(None)
def m13_batch_scoring(spark: SparkSession, d: str) -> DataFrame:
    df = learnable(spark, d, *_NUMERIC, "label")
    df = pinned(df.withColumn("row_id", F.unhex("row_id")))  # kept and checked in half the bytes
    out = mo.score(df, mo.fit(df, mo.Spec("classification", "label", _NUMERIC, "logistic", {"maxIter": 10})), "row_id", ["label"])
    return out.withColumn("row_id", F.lower(F.hex("row_id")))


@register(None)
def m15_permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    df = pinned(learnable(spark, d, "l_quantity", "age", "l_tax", "label"))
    fitted = mo.fit(df, mo.Spec("classification", "label", ("l_quantity", "age", "l_tax"), "decision_tree", {"maxDepth": 4}))
    return mo.permutation_importance(df, fitted, "row_id", sample=None, repeats=3)


@register(f"""WITH {_FLAGS}, m AS (SELECT old, max_by(noisy, n) AS p FROM (SELECT old, noisy, count(*) AS n FROM tr GROUP BY ALL) GROUP BY 1),
a AS (SELECT old, noisy, row_number() OVER (ORDER BY {h('o_orderkey', 7)}, o_orderkey) AS i FROM o), b AS (SELECT old AS dealt, row_number() OVER (ORDER BY {h('o_orderkey', 8)}, o_orderkey) AS i FROM o),
w AS (SELECT avg((noisy = p)::INT) AS whole FROM o JOIN m USING (old)), sh AS (SELECT avg((noisy = p)::INT) AS shuffled FROM a JOIN b USING (i) JOIN m ON m.old = dealt)
SELECT 'old' AS feature, round(whole - shuffled, 6) AS importance FROM w, sh UNION ALL SELECT 'urgent', 0.0""")
def m15_importance_of_a_flag(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy that is lost when the flag that a tree of one split uses is shuffled, and none for the other."""
    df = flags(spark, d)
    fitted = mo.fit(df.filter("split_role = 'training'"), mo.Spec("classification", "noisy", ("old", "urgent"), "decision_tree", {"maxDepth": 1}))
    return rounded(mo.permutation_importance(df, fitted, "o_orderkey", sample=None, repeats=1, metric="accuracy"))


def _replayed() -> str:
    from marlpit.queries.monitoring import _L

    return f"""WITH {_L}, c AS (SELECT *, user_id % 4 = 0 AS quarter FROM log WHERE role = 'champion'), r AS (SELECT quarter, avg((prediction_value = '1')::INT) AS p FROM c GROUP BY 1)
SELECT request_id, record_id, CASE WHEN p > 0.5 THEN '1' ELSE '0' END AS prediction, round(p, 6) AS prediction_score FROM c JOIN r ON r.quarter = c.quarter WHERE ts < (SELECT max(ts) FROM events)"""


@register(_replayed())
def m16_replayed_rates(spark: SparkSession, d: str) -> DataFrame:
    """Requests whose payload holds one flag, scored again by a tree that learned what was predicted for either value."""
    from marlpit.queries.monitoring import log

    e = log(spark, d).withColumn("input_json", F.to_json(F.struct((F.col("user_id") % 4 == 0).cast("double").alias("quarter"))))
    rows = e.filter("role = 'champion'").withColumn("_p", F.from_json("input_json", "quarter double")).select("_p.*", "prediction_value")
    fitted = mo.fit(rows, mo.Spec("classification", "prediction_value", ("quarter",), "decision_tree", {"maxDepth": 1}))
    since, until = e.agg(F.min("scored_at").cast("string"), F.max("scored_at").cast("string")).first()
    return rounded(mo.replay(e, "input_json", "quarter double", fitted, since, until).select("request_id", "record_id", "prediction", "prediction_score"))


@register(None)
def m16_replay(spark: SparkSession, d: str) -> DataFrame:
    """Logged requests scored by a challenger that learned from actual values."""
    from marlpit.queries.monitoring import log

    e = log(spark, d)
    rows = e.withColumn("_p", F.from_json("input_json", "user_id double, value double")).select("record_id", "_p.*", "prediction_value")
    fitted = mo.fit(rows, mo.Spec("classification", "prediction_value", ("user_id", "value"), "logistic", {"maxIter": 10}))
    since, until = e.agg(F.min("scored_at").cast("string"), F.max("scored_at").cast("string")).first()
    return mo.replay(e, "input_json", "user_id double, value double", fitted, since, until)
