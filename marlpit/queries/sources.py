"""Files: CSV and Parquet in and out, previews, views, logs. Inputs are written from the given tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.functions.lineage import shared_folder
from marlpit.operators import contracts
from marlpit.queries.registry import collector, read
from marlpit.sources import tables

QUERIES, ORACLE_SQL, register = collector()


def work_folder(spark: SparkSession) -> str:
    """A new folder under the one that executors share."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex[:12]}"


@register("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def s1_read_csv(spark: SparkSession, d: str) -> DataFrame:
    path = work_folder(spark)
    read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").write.option("header", True).csv(path)
    return tables.read_csv(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@register("""SELECT * FROM (VALUES ('event_id', 'number'), ('event_type', 'text'), ('flag', 'boolean'), ('ts', 'date'), ('mix', 'mixed'), ('none', 'empty')) v(column_name, kind),
(SELECT CAST(count(*) AS BIGINT) AS rows FROM events)""")
def s2_inspect_csv(spark: SparkSession, d: str) -> DataFrame:
    path = work_folder(spark)
    e = read(spark, d, "events")
    e = e.select("event_id", "event_type", (F.col("event_id") % 2 == 0).alias("flag"), "ts", F.when(F.col("event_id") % 3 == 0, F.lit("x")).otherwise(F.col("event_id").cast("string")).alias("mix"), F.lit("").alias("none"))
    e.write.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return tables.inspect_csv(spark, path, header=True).select("column_name", "kind").crossJoin(F.broadcast(e.agg(F.count("*").alias("rows"))))  # one row


@register("""SELECT * FROM (VALUES (';'), ('tab'), ('|')) s(sep), (VALUES ('c_custkey', 'number'), ('note', 'text'), ('c_acctbal', 'number')) v(column_name, kind), (SELECT CAST(count(*) AS BIGINT) AS given FROM customer)""")
def s2_inspect_dialects(spark: SparkSession, d: str) -> DataFrame:
    """Files with other separators, which also stand in quoted texts, inspected without a word on either."""
    df, out = read(spark, d, "customer"), None
    for sep in (";", "\t", "|"):
        path = work_folder(spark)
        df.select("c_custkey", F.concat("c_name", F.lit(f"{sep} of "), "c_mktsegment").alias("note"), "c_acctbal").write.options(header=True, sep=sep, quoteAll=True).csv(path)
        found = tables.inspect_csv(spark, path).select(F.lit("tab" if sep == "\t" else sep).alias("sep"), "column_name", "kind", "given")
        out = found if out is None else out.unionByName(found)
    return out


@register("SELECT n_nationkey AS column_1, n_name AS name, n_regionkey AS name_2 FROM nation")
def s3_normalize_names(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").toDF(*tables.normalize_column_names(["", "name", "name"]))


@register("SELECT p_partkey, p_retailprice FROM part WHERE p_size > 20")
def s4_read_parquet(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").filter("p_size > 20").select("p_partkey", "p_retailprice")


@register("SELECT 'embedding' AS column_name, CAST(count(*) AS BIGINT) AS rows FROM embeddings")
def s5_flat_schema(spark: SparkSession, d: str) -> DataFrame:
    """Columns that keep a table from being flat."""
    tables.flat_schema_check(read(spark, d, "documents"))
    df = read(spark, d, "embeddings")
    bad = spark.createDataFrame([(c,) for c, _ in tables.nested_columns(df)], "column_name string")
    return bad.crossJoin(F.broadcast(df.agg(F.count("*").alias("rows"))))  # one row


@register("SELECT event_id, ts, nullif(event_type, 'click') AS kind, value FROM events")
def s6_read_typed_csv(spark: SparkSession, d: str) -> DataFrame:
    path = work_folder(spark)
    read(spark, d, "events").select("event_id", "ts", F.when(F.col("event_type") != "click", F.col("event_type")).alias("kind"), "value").write.options(header=True, nullValue="", timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    df = tables.read_typed_csv(spark, path, "event_id long, ts timestamp, kind string, value double", timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, CAST((SELECT count(*) FROM orders) AS BIGINT) AS written FROM orders GROUP BY 1")
def s7_write_parquet(spark: SparkSession, d: str) -> DataFrame:
    path = work_folder(spark)
    n, _ = tables.write_parquet(read(spark, d, "orders"), path)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.lit(n).cast("bigint").alias("written"))


@register("SELECT o_custkey, CAST(count(*) AS BIGINT) AS orders FROM orders GROUP BY 1")
def s8_materialize_view(spark: SparkSession, d: str) -> DataFrame:
    root = work_folder(spark)
    definition = {"source": d, "group_by": ["o_custkey"]}
    build = lambda: read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    tables.materialize_view(spark, root, definition, build)
    return tables.materialize_view(spark, root, definition, build)


@register("SELECT o_custkey, round(sum(o_totalprice), 2) AS spent, CAST(1 AS BIGINT) AS revisions FROM orders GROUP BY 1")
def s8_view_revisions(spark: SparkSession, d: str) -> DataFrame:
    """A view whose definition changes: only the newest revision's folder is left."""
    from marlpit.functions.lineage import hadoop_path

    root = work_folder(spark)
    df = read(spark, d, "orders").groupBy("o_custkey")
    tables.materialize_view(spark, root, {"source": d, "measure": "rows"}, lambda: df.agg(F.count("*").alias("orders")), view="by_customer")
    out = tables.materialize_view(spark, root, {"source": d, "measure": "spent"}, lambda: df.agg(F.round(F.sum("o_totalprice"), 2).alias("spent")), view="by_customer")
    fs, where = hadoop_path(spark, f"{root}/by_customer")
    return out.withColumn("revisions", F.lit(len(fs.listStatus(where))).cast("bigint"))


@register("""WITH k AS (SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1995-01-15') AND NOT (o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-06-01'))
SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total, (SELECT count(*) FROM orders) - (SELECT count(*) FROM k) AS deleted, CAST(1 AS BIGINT) AS rewritten, true AS untouched FROM k GROUP BY 1""")
def l7_retention_on_disk(spark: SparkSession, d: str) -> DataFrame:
    """Orders in folders by status and month, pruned on disk: whole months go, the month of a cutoff is rewritten, other files stay."""
    from datetime import datetime

    path = work_folder(spark)
    tables.write_periods(read(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus"), path, "o_orderdate", "o_orderstatus", "month")
    before = {r.path: r.at for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).selectExpr("path", "modificationTime AS at").collect()}  # a row for each file
    deleted, rewritten = tables.prune_expired(spark, path, "o_orderdate", "o_orderstatus", {"F": datetime(1995, 1, 15), "O": datetime(1996, 6, 1)}, "month")
    after = {r.path: r.at for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).selectExpr("path", "modificationTime AS at").collect()}
    new = [p for p in after if p not in before]
    untouched = all(before[p] == after[p] for p in after if p in before) and all("1995-01-01" in p for p in new)
    df = spark.read.parquet(path)
    out = df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return out.withColumns({"deleted": F.lit(deleted).cast("bigint"), "rewritten": F.lit(rewritten).cast("bigint"), "untouched": F.lit(untouched)})


@register("SELECT o_orderkey, o_custkey, CAST((SELECT count(*) FROM orders) AS BIGINT) AS total_rows, true AS has_next, true AS has_previous FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def s9_preview(spark: SparkSession, d: str) -> DataFrame:
    return tables.preview(read(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 50, 100)


@register("""WITH n AS (SELECT o_orderkey, o_totalprice, o_orderstatus, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS _quality_source_row_number FROM orders)
SELECT o_orderkey, _quality_source_row_number, concat_ws('; ', CASE WHEN o_totalprice > 200000 THEN 'o_totalprice.maximum' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'o_orderstatus.allowed_values' END) AS _quality_rejection_reason
FROM n WHERE o_totalprice > 200000 OR o_orderstatus NOT IN ('F', 'O')""")
def s10_write_rejected(spark: SparkSession, d: str) -> DataFrame:
    path = work_folder(spark)
    e = [contracts.Expectation("o_totalprice", "maximum", 200000.0), contracts.Expectation("o_orderstatus", "allowed_values", ["F", "O"])]
    tables.write_parquet(contracts.rejected_rows(read(spark, d, "orders"), e, ["o_orderkey"]), path)
    return spark.read.parquet(path).select("o_orderkey", F.col("_quality_source_row_number").cast("bigint").alias("_quality_source_row_number"), "_quality_rejection_reason")


@register("""SELECT event_id AS request_id, user_id, value FROM events WHERE ts >= (SELECT min(ts) + INTERVAL 2 DAY FROM events) AND ts < (SELECT min(ts) + INTERVAL 9 DAY FROM events) AND user_id % 3 = 0 AND event_id < 900000000""")
def s11_inference_log(spark: SparkSession, d: str) -> DataFrame:
    from datetime import timedelta

    e = read(spark, d, "events")
    start = e.agg(F.min("ts")).first()[0]
    requests = e.select(F.col("event_id").alias("request_id"), F.col("ts").alias("created_at"), "user_id")
    role = F.when(F.col("user_id") % 3 == 0, "champion").otherwise("challenger")
    items = e.select(F.col("event_id").alias("request_id"), role.alias("role"), F.col("ts").alias("logged_at"), "value")
    at = lambda days: str(start + timedelta(days=days))
    return tables.inference_log(requests, items, at(2), at(9), at(3650)).select("request_id", "user_id", "value")
