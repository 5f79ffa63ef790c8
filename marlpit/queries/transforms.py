"""Projections, filters, joins, aggregations, windows, sorts and unions over the sales tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlpit.functions.semantics import portable_hash
from marlpit.operators import transforms as t
from marlpit.plans import dag, sql
from marlpit.queries.registry import collector, read, rounded

QUERIES, ORACLE_SQL, register = collector()

DE_DEFINITION = {
    "inputs": ["orders", "customer"],
    "steps": [
        {"id": "joined", "kind": "join", "inputs": ["orders", "customer"], "config": {"keys": [("o_custkey", "c_custkey")], "how": "inner"}},
        {"id": "large", "kind": "filter_rows", "inputs": ["joined"], "config": {"conditions": [{"column": "o_totalprice", "operator": "gte", "value": 1000.0}]}},
        {"id": "derived", "kind": "derive_column", "inputs": ["large"], "config": {"name": "gross", "tree": {"op": "multiply", "args": [{"column": "o_totalprice"}, {"literal": 1.23}]}}},
        {"id": "checked", "kind": "contract", "inputs": ["derived"], "config": {"expectations": [("o_orderkey", "nullable", None, "reject"), ("gross", "minimum", 0.0, "reject")]}},
        {"id": "by_segment", "kind": "aggregate", "inputs": ["checked"], "config": {"group_by": ["c_mktsegment"], "aggregations": [
            {"function": "count", "column": "*", "alias": "n"}, {"function": "sum", "column": "gross", "alias": "gross"}, {"function": "avg", "column": "c_acctbal", "alias": "balance"}]}},
    ],
    "outputs": ["by_segment"],
}


@register("""SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice * 1.23::DOUBLE), 2) AS gross, round(avg(c_acctbal), 2) AS balance
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= 1000 GROUP BY 1""")
def de_orders_by_segment(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: join, filter, derive, contract and aggregate as one lazy plan."""
    out = dag.run(DE_DEFINITION, {"orders": read(spark, d, "orders"), "customer": read(spark, d, "customer")})
    return rounded(out["by_segment"], 2)


@register("SELECT o_orderkey, o_orderpriority FROM orders")
def p1_select_columns(spark: SparkSession, d: str) -> DataFrame:
    return t.select_columns(read(spark, d, "orders"), ["o_orderkey", "o_orderpriority"])


@register("SELECT r_regionkey AS region_id, r_name AS region FROM region")
def p2_rename_columns(spark: SparkSession, d: str) -> DataFrame:
    return t.rename_columns(read(spark, d, "region"), {"r_regionkey": "region_id", "r_name": "region"})


@register("""SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS INTEGER) AS l_extendedprice, CAST(l_quantity AS BIGINT) AS l_quantity, CAST(l_partkey AS VARCHAR) AS l_partkey,
CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem""")
def p3_cast_columns(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_partkey", "l_shipdate")
    return t.cast_columns(df, {"l_extendedprice": "INTEGER", "l_quantity": "BIGINT", "l_partkey": "VARCHAR", "l_shipdate": "DATE"})


@register("""SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * 0.7310585::DOUBLE / nullif(l_quantity - 10, 0), 4) AS unit_price, l_returnflag || l_linestatus AS flags FROM lineitem""")
def p4_derive_column(spark: SparkSession, d: str) -> DataFrame:
    net = {"op": "multiply", "args": [{"column": "l_extendedprice"}, {"op": "subtract", "args": [{"literal": 1.0}, {"column": "l_discount"}]}, {"literal": 0.7310585}]}
    df = t.derive_column(read(spark, d, "lineitem"), "unit_price", {"op": "divide", "args": [net, {"op": "subtract", "args": [{"column": "l_quantity"}, {"literal": 10}]}]})
    df = t.derive_column(df, "flags", {"op": "concat", "args": [{"column": "l_returnflag"}, {"column": "l_linestatus"}]})
    return rounded(df.select("l_orderkey", "l_linenumber", "unit_price", "flags"), 4)


@register("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def p5_map_categories(spark: SparkSession, d: str) -> DataFrame:
    return t.map_categories(read(spark, d, "orders"), "o_orderstatus", {"F": "final", "O": "open"}, "status").select("o_orderkey", "status")


@register("""SELECT c_custkey, sha256('V' || length(c_name) || ':' || c_name || ';' ||
CASE WHEN nullif(c_nationkey, 3) IS NULL THEN 'N;' ELSE 'V' || length(CAST(c_nationkey AS VARCHAR)) || ':' || c_nationkey || ';' END) AS row_hash FROM customer""")
def p6_hash_identifier(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "customer").withColumn("nation", F.nullif("c_nationkey", F.lit(3)))
    return t.hash_identifier(df, "row_hash", ["c_name", "nation"]).select("c_custkey", "row_hash")


@register("SELECT event_id, CAST(99 + row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS seq FROM events")
def p7_sequence_identifier(spark: SparkSession, d: str) -> DataFrame:
    return t.sequence_identifier(read(spark, d, "events").select("event_id", "ts"), "seq", ["ts", "event_id"], 100).select("event_id", F.col("seq").cast("bigint").alias("seq"))


@register("""WITH s AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, nullif(event_type, 'click') AS kind, nullif(user_id % 7, 3) AS u FROM events),
k AS (SELECT * FROM s WHERE u IS NOT NULL),
m AS (SELECT kind FROM s WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)
SELECT event_id, round(coalesce(value, (SELECT median(value) FROM k)), 6) AS value, coalesce(kind, (SELECT kind FROM m)) AS kind, u, value IS NULL AS value__was_missing FROM k""")
def p8_impute_missing(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"), F.nullif("event_type", F.lit("click")).alias("kind"), F.nullif(F.col("user_id") % 7, F.lit(3)).alias("u"))
    rules = [{"column": "value", "method": "median", "add_indicator": True}, {"column": "kind", "method": "mode"}, {"column": "u", "method": "drop_rows"}]
    return rounded(t.impute_missing(df, rules))


@register("""SELECT n_name, CAST(count(*) AS BIGINT) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name""")
def p9_custom_sql(spark: SparkSession, d: str) -> DataFrame:
    text = "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM people JOIN places ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name"
    return sql.select_over({"people": read(spark, d, "customer"), "places": read(spark, d, "nation")}, text)


@register("""WITH q AS (SELECT p_brand, CAST(count(*) AS BIGINT) AS n, round(avg(p_retailprice), 4) AS price FROM part GROUP BY p_brand)
SELECT *, CAST((SELECT count(*) FROM q) AS BIGINT) AS total_rows FROM q ORDER BY p_brand LIMIT 10""")
def p10_query(spark: SparkSession, d: str) -> DataFrame:
    rows, total = sql.query(read(spark, d, "part"), "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM dataset GROUP BY p_brand ORDER BY p_brand", 10)
    return rows.withColumn("total_rows", F.lit(total).cast("bigint"))


@register("SELECT s_suppkey, s_name FROM supplier")
def p11_visible_columns(spark: SparkSession, d: str) -> DataFrame:
    return t.visible_columns(read(spark, d, "supplier"), ["s_suppkey", "gone", "s_name"])


@register("SELECT 's_acctbal' AS column_name, 'measure' AS role UNION ALL SELECT 's_suppkey', 'identifier'")
def p12_inherit_roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles set on the source are those of the view's surviving columns."""
    from marlpit.sources import tables

    df = tables.with_roles(read(spark, d, "supplier"), {"s_suppkey": "identifier", "s_acctbal": "measure", "s_name": "text"})
    return tables.roles_frame(df.filter("s_acctbal > 0").select("s_suppkey", "s_acctbal"))


@register("""SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority ILIKE '%high%' AND o_orderstatus IN ('F', 'P') AND o_totalprice >= 1000 AND o_custkey <> 5 AND o_orderpriority IS NOT NULL""")
def f1_filter_rows(spark: SparkSession, d: str) -> DataFrame:
    tests = [("o_orderpriority", "contains", "HIGH"), ("o_orderstatus", "in", ["F", "P"]), ("o_totalprice", "gte", 1000.0), ("o_custkey", "ne", 5), ("o_orderpriority", "not_null", None)]
    return t.filter_rows(read(spark, d, "orders"), [dict(zip(("column", "operator", "value"), x, strict=True)) for x in tests]).select("o_orderkey", "o_orderpriority")


@register("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity * l_discount > 2 OR l_returnflag = 'R'")
def f2_filter_sql(spark: SparkSession, d: str) -> DataFrame:
    return t.filter_sql(read(spark, d, "lineitem"), "l_quantity * l_discount > 2 OR l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")


@register("""SELECT p_partkey, p_brand, p_size FROM part WHERE regexp_matches(p_brand, '#[1-3]') AND p_size >= 5 AND p_size < 40 AND p_retailprice > 900 AND p_name IS NOT NULL AND p_name <> '' AND lower(p_type) <> 'x'""")
def f3_browse_filter(spark: SparkSession, d: str) -> DataFrame:
    filters = [{"c": "p_brand", "op": "regex", "value": "#[1-3]"}, {"c": "p_size", "op": "between", "value": 5, "upper": 40}, {"c": "p_retailprice", "op": "gt", "value": 900}, {"c": "p_name", "op": "not_empty"}, {"c": "p_type", "op": "not_equals", "value": "X"}]
    return t.browse_filter(read(spark, d, "part"), filters).select("p_partkey", "p_brand", "p_size")


@register("SELECT s_suppkey, s_name FROM supplier WHERE contains(CAST(s_suppkey AS VARCHAR), '7') OR contains(lower(s_name), '7') OR contains(CAST(s_nationkey AS VARCHAR), '7')")
def f4_search(spark: SparkSession, d: str) -> DataFrame:
    return t.search(read(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "7").select("s_suppkey", "s_name")


@register("SELECT c_mktsegment, c_nationkey, CAST(count(*) AS BIGINT) AS records, round(avg(c_acctbal), 4) AS balance FROM customer GROUP BY ALL HAVING count(*) >= 10")
def f5_having(spark: SparkSession, d: str) -> DataFrame:
    grouped = t.browse_group(read(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], [("average", "c_acctbal", "balance")])
    return rounded(t.browse_filter(grouped, [{"c": "records", "op": "gte", "value": 10}]), 4)


@register("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND lower(l_returnflag) = 'a')
SELECT *, CAST((SELECT count(*) FROM f) AS BIGINT) AS matches FROM f ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 50""")
def f6_drill(spark: SparkSession, d: str) -> DataFrame:
    filters = [{"c": "l_quantity", "op": "between", "value": 10, "upper": 20}, {"c": "l_returnflag", "op": "equals", "value": "A"}]
    return t.drill(read(spark, d, "lineitem"), filters, ["l_orderkey", "l_linenumber", "l_partkey"], 50).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "matches")


@register("SELECT event_id, value FROM events WHERE value IS NOT NULL AND isfinite(value) AND event_type IN ('click', 'view')")
def f7_chart_rows(spark: SparkSession, d: str) -> DataFrame:
    return t.chart_rows(read(spark, d, "events"), ["value"], "event_type", ["click", "view"]).select("event_id", "value")


@register("SELECT event_id, event_type FROM events WHERE regexp_matches(event_type, '(?i)^(CLICK|err)')")
def f8_preview_filter(spark: SparkSession, d: str) -> DataFrame:
    return t.browse_filter(read(spark, d, "events"), [{"c": "event_type", "op": "regex", "value": "(?i)^(CLICK|err)"}]).select("event_id", "event_type")


@register("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey")
def j1_join(spark: SparkSession, d: str) -> DataFrame:
    rich = read(spark, d, "customer").filter("c_acctbal > 5000")
    return t.join(read(spark, d, "orders"), rich, [("o_custkey", "c_custkey")], "left").select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


@register("""SELECT coalesce(a.k, b.k) AS k, a.x, b.x AS x_right FROM (SELECT n_nationkey AS k, n_name AS x FROM nation WHERE n_nationkey < 15) a
FULL JOIN (SELECT n_nationkey AS k, n_regionkey AS x FROM nation WHERE n_nationkey > 9) b ON a.k = b.k""")
def j1_full_join_keys(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation")
    a, b = n.filter("n_nationkey < 15").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("x")), n.filter("n_nationkey > 9").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("x"))
    return t.join(a, b, [("k", "k")], "full", coalesce_keys=True)


@register("SELECT CAST(count(*) AS BIGINT) AS unmatched FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j6_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return t.unmatched_count(read(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), read(spark, d, "orders"), ["o_custkey"])


@register("""WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS null_keys, CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS duplicate_keys FROM k""")
def j7_key_check(spark: SparkSession, d: str) -> DataFrame:
    return t.key_check(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1)")
def j8_repeated_values(spark: SparkSession, d: str) -> DataFrame:
    return t.repeated_values(read(spark, d, "part"), "p_name").select("p_partkey", "p_name")


@register("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount, min(l_tax) AS low, max(l_tax) AS high FROM lineitem GROUP BY ALL")
def a1_aggregate(spark: SparkSession, d: str) -> DataFrame:
    aggs = [("count", "*", "n"), ("count_distinct", "l_suppkey", "suppliers"), ("sum", "l_quantity", "quantity"), ("avg", "l_discount", "discount"), ("min", "l_tax", "low"), ("max", "l_tax", "high")]
    return rounded(t.aggregate(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], [dict(zip(("function", "column", "alias"), a, strict=True)) for a in aggs]))


@register("""WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL),
m AS (SELECT o_orderstatus, min_by(o_orderpriority, (-n, o_orderpriority)) AS usual FROM c GROUP BY 1)
SELECT o.o_orderstatus, CAST(count(*) AS BIGINT) AS records, round(median(o_totalprice), 4) AS middle, CAST(count(DISTINCT o_custkey) AS BIGINT) AS buyers,
min_by(o_custkey, o_orderkey) AS first_buyer, max_by(o_custkey, o_orderkey) AS last_buyer, any_value(usual) AS usual FROM orders o JOIN m ON m.o_orderstatus = o.o_orderstatus GROUP BY 1""")
def a2_browse_group(spark: SparkSession, d: str) -> DataFrame:
    measures = [("median", "o_totalprice", "middle"), ("unique_count", "o_custkey", "buyers"), ("first", "o_custkey", "first_buyer"), ("last", "o_custkey", "last_buyer"), ("most_frequent", "o_orderpriority", "usual")]
    return rounded(t.browse_group(read(spark, d, "orders"), ["o_orderstatus"], measures, "o_orderkey"), 4)


@register("""WITH c AS (SELECT CAST(p_size AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1)
SELECT value, n, (SELECT count(*) FROM c) > 12 AS truncated FROM c ORDER BY n DESC, value LIMIT 12""")
def a4_group_values(spark: SparkSession, d: str) -> DataFrame:
    return t.group_values(read(spark, d, "part"), "p_size", 12)


@register("""WITH e AS (SELECT nullif(event_type, 'click') AS k FROM events), s AS (SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE k IS NULL) AS BIGINT) AS nulls, CAST(count(DISTINCT k) AS BIGINT) AS distinct_values FROM e)
SELECT k AS value, CAST(count(*) AS BIGINT) AS n, any_value(rows) AS rows, any_value(nulls) AS nulls, any_value(distinct_values) AS distinct_values, round(count(*) / any_value(rows), 6) AS share FROM e, s GROUP BY k ORDER BY n DESC, k NULLS LAST LIMIT 3""")
def a5_column_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(t.column_summary(read(spark, d, "events").select(F.nullif("event_type", F.lit("click")).alias("k")), "k", 3))


@register("""WITH e AS (SELECT event_type AS a, CASE WHEN event_id % 10 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS b FROM events)
SELECT 'a' AS column_name, CAST(count(a) AS BIGINT) AS count, CAST(0 AS BIGINT) AS missing, CAST(count(DISTINCT a) AS BIGINT) AS unique_values, NULL::DOUBLE AS mean, NULL::DOUBLE AS minimum, NULL::DOUBLE AS maximum FROM e
UNION ALL SELECT 'b', CAST(count(nullif(b, '')) AS BIGINT), CAST(count(*) FILTER (WHERE b = '') AS BIGINT), CAST(count(DISTINCT nullif(b, '')) AS BIGINT), round(avg(CAST(nullif(b, '') AS DOUBLE)), 6), min(CAST(nullif(b, '') AS DOUBLE)), max(CAST(nullif(b, '') AS DOUBLE)) FROM e""")
def a6_inline_describe(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "events").select(F.col("event_type").alias("a"), F.when(F.col("event_id") % 10 == 0, "").otherwise(F.col("user_id").cast("string")).alias("b"))
    return rounded(t.inline_describe(df, ["a", "b"]))


@register("""WITH c AS (SELECT o_orderstatus AS class, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1) SELECT class, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c""")
def a7_class_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(t.class_weights(read(spark, d, "orders"), "o_orderstatus"))


@register("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def w1_deduplicate(spark: SparkSession, d: str) -> DataFrame:
    return t.deduplicate(read(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"])


@register("""WITH r AS (SELECT *, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INTEGER) AS group_rank FROM (SELECT event_id, event_type, value FROM events))
SELECT event_id, event_type, value, group_rank FROM r ORDER BY group_rank, event_type LIMIT 23""")
def w7_fair_top(spark: SparkSession, d: str) -> DataFrame:
    return t.fair_top(read(spark, d, "events").select("event_id", "event_type", "value"), "event_type", [F.desc("value"), F.col("event_id")], 23)


@register("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS version FROM orders")
def w12_version_numbers(spark: SparkSession, d: str) -> DataFrame:
    return t.version_numbers(read(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "version")


@register("""SELECT s_suppkey, nullif(s_nationkey, 4) AS nation, s_acctbal, CAST(row_number() OVER (ORDER BY nullif(s_nationkey, 4) DESC NULLS LAST, s_acctbal, s_suppkey) AS INTEGER) AS place FROM supplier""")
def l1_sort_rows(spark: SparkSession, d: str) -> DataFrame:
    """Sorted rows; the place column shows the order that they come in."""
    df = read(spark, d, "supplier").select("s_suppkey", F.nullif("s_nationkey", F.lit(4)).alias("nation"), "s_acctbal")
    ordered = t.sort_rows(df, [("nation", "desc"), ("s_acctbal", "asc"), ("s_suppkey", "asc")])
    return t.sequence_identifier(ordered.withColumn("minus", -F.col("nation")), "place", ["minus", "s_acctbal", "s_suppkey"]).drop("minus").withColumn("place", F.col("place").cast("int"))


@register("SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS records, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def l2_browser_sort(spark: SparkSession, d: str) -> DataFrame:
    grouped = t.browse_group(read(spark, d, "customer"), ["c_mktsegment"], [("sum", "c_acctbal", "total")])
    return rounded(t.sort_rows(grouped, [("records", "desc"), ("c_mktsegment", "asc")]), 2)


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def l3_top_k(spark: SparkSession, d: str) -> DataFrame:
    return t.sort_rows(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", "desc"), ("o_orderkey", "asc")]).limit(25)


@register("SELECT o_orderkey FROM orders ORDER BY CAST('0x' || substr(md5(o_orderkey || '|' || 42), 1, 15) AS BIGINT), o_orderkey LIMIT 500")
def l4_reservoir(spark: SparkSession, d: str) -> DataFrame:
    return t.hash_sample(read(spark, d, "orders"), "o_orderkey", 42, 500).select("o_orderkey")


@register("SELECT event_id FROM events ORDER BY CAST('0x' || substr(md5(event_id || '|' || 7), 1, 15) AS BIGINT), event_id LIMIT 256")
def l5_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return t.hash_sample(read(spark, d, "events"), "event_id", 7, 256).select("event_id")


@register("""WITH c AS (SELECT ts, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1 OFFSET 499)
SELECT event_id, e.ts FROM events e, (SELECT ts AS t0, event_id AS e0 FROM c) WHERE (e.ts < t0 OR (e.ts = t0 AND event_id < e0)) AND event_type = 'click' ORDER BY e.ts DESC, event_id DESC LIMIT 20""")
def l6_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "events")
    last = df.orderBy(F.desc("ts"), F.desc("event_id")).limit(500).agg(F.min(F.struct("ts", "event_id")).alias("c")).select("c.*").first()
    return t.keyset_page(df, "ts", "event_id", (last.ts, last.event_id), 20, ("event_type", "click")).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@register("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1995-01-01') AND NOT (o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-06-01')")
def l7_retention(spark: SparkSession, d: str) -> DataFrame:
    from datetime import datetime

    return t.retained(read(spark, d, "orders"), "o_orderdate", {"F": datetime(1995, 1, 1), "O": datetime(1996, 6, 1)}, "o_orderstatus").select("o_orderkey")


@register("SELECT n_nationkey AS k, n_name AS name, NULL::INTEGER AS region FROM nation UNION ALL SELECT r_regionkey, r_name, r_regionkey FROM region")
def u1_union_by_name(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    r = read(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("region"))
    return t.union([n, r])


@register("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def u2_union_all(spark: SparkSession, d: str) -> DataFrame:
    return t.union([read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), read(spark, d, "supplier").select("s_suppkey", "s_name")], by_name=False)


@register("SELECT l_returnflag AS label FROM lineitem UNION SELECT o_orderstatus FROM orders")
def u3_distinct_union(spark: SparkSession, d: str) -> DataFrame:
    return t.distinct_union([read(spark, d, "lineitem").select(F.col("l_returnflag").alias("label")), read(spark, d, "orders").select("o_orderstatus")])


@register("SELECT DISTINCT p_brand, p_size FROM part")
def u4_distinct(spark: SparkSession, d: str) -> DataFrame:
    return t.deduplicate(read(spark, d, "part").select("p_brand", "p_size"))


@register("SELECT CAST(count(DISTINCT event_type) AS BIGINT) AS groups FROM events")
def v12_group_guard(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "events")
    n = t.group_count_guard(df, "event_type", 20)
    return df.agg((F.count_distinct("event_type") * 0 + n).cast("bigint").alias("groups"))


@register("SELECT o_orderkey, o_totalprice, o_totalprice > 2 * avg(o_totalprice) OVER (PARTITION BY o_orderstatus) AS large FROM orders")
def j9_group_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rows beside their group's statistics, by a join with the aggregate (small: groups are guarded)."""
    df = read(spark, d, "orders")
    t.group_count_guard(df, "o_orderstatus", 20)
    stats = df.groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("mean"))
    return df.join(F.broadcast(stats), "o_orderstatus").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") > 2 * F.col("mean")).alias("large"))


@register("SELECT event_id, round(value - (SELECT avg(value) FROM events), 6) AS centred FROM events")
def j10_one_row(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "events")
    return rounded(df.crossJoin(F.broadcast(df.agg(F.avg("value").alias("mean")))).select("event_id", (F.col("value") - F.col("mean")).alias("centred")))  # one row


@register("SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, CAST(sum(count(*)) OVER (ORDER BY o_orderpriority) AS BIGINT) AS running FROM orders GROUP BY 1")
def w5_w6_totals(spark: SparkSession, d: str) -> DataFrame:
    """Running and whole totals over the aggregate's rows."""
    n = read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return rounded(n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).withColumn("running", F.sum("n").over(Window.orderBy("o_orderpriority"))))


@register("SELECT o_orderkey, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT) % 97 AS bucket FROM orders")
def fn_portable_hash(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", (portable_hash(F.col("o_orderkey")) % 97).alias("bucket"))


