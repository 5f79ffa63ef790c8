"""Mixing sources to target weights with a low-discrepancy schedule over equal-word blocks.

Each source's documents are shuffled by a keyed hash and laid end to end, pass after pass; the stream is cut into
blocks of ``block_words`` words. Slot t of the mix is the point frac((t + 1/2) * golden ratio); the interval of
cumulative source weights that holds it names the slot's source, and the slot's rank within its source names the block.
Everything is DataFrame operations.

Defined results: null text has size 0; null sources form one source, last in order; repeated rows are rows of their
own, and so are rows that share an id or have none; an empty table gives an empty mix; columns of the input beside id, text and
source are not read by ``mix_sources`` and are kept by ``with_mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.llm.common import free_names, materialize, word_count

GOLDEN = 0.6180339887498949
#: Slots ranked together; bounds every window of the ranking.
CHUNK = 1 << 16
#: Documents expected in one bucket of a source's shuffled order.
BUCKET_DOCS = 1_000
#: Up to so many sources (one row each) are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 20_000


def shuffled_position(doc_id: Column, text: Column, seed: int) -> Column:
    """A keyed 60-bit place of an id and its text (many rows may share an id, or have none), the same in any engine that has md5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_passes: float) -> DataFrame:
    """One row per source: sidx, source, source_size, target. Targets share ``share`` of all words by weight; none is
    above ``max_passes`` times its source's size, and what that frees is shared again by weight."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sidx", F.row_number().over(by_name) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sidx") % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_passes)))
    everything = Window.partitionBy()
    by_fill = Window.orderBy((F.col("cap") / F.col("w")).asc(), "sidx")
    below = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    above = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("w").over(above)
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(everything))
    target = F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap"))
    return s.select("sidx", "source", "source_size", target.alias("target"))


def mixing_schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """The schedule: slot, sidx, block (rank of the slot within its source, from 0). Each source gets exactly
    ceil(target / block_words) slots: surplus points are passed over, missing slots follow at the end."""
    spark = sources.sparkSession
    q = sources.select("sidx", F.ceil(F.round("target") / block_words).cast("long").alias("quota"))
    total, n_sources = q.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    hint = F.broadcast if n_sources <= BROADCAST_SOURCES else lambda df: df
    cells = max(1024, 4 * n_sources)
    order = Window.orderBy("sidx")
    hi = F.sum("quota").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.lit(float(max(total, 1)))
    lo = (F.sum("quota").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("quota")) / F.lit(float(max(total, 1)))
    spans = q.filter("quota > 0").select("sidx", "quota", lo.alias("lo"), hi.alias("hi"))
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.col("hi") * cells))))
    at = (F.col("id") + F.lit(0.5)) * F.lit(GOLDEN)
    points = spark.range(total).select(F.col("id").alias("slot"), (at - F.floor(at)).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * cells))
    slots = points.join(hint(spans), "cell").filter("u >= lo AND u < hi").select("slot", "sidx", "quota")
    slots = slots.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    chunks = slots.groupBy("chunk", "sidx").agg(F.count("*").alias("n"))
    before = Window.partitionBy("sidx").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("chunk", "sidx", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("chunk", "sidx").orderBy("slot"))
    ranked = slots.join(chunks, ["chunk", "sidx"]).withColumn("block", F.col("before") + within - 1)
    ranked = materialize(ranked.filter("block < quota").select("slot", "sidx", "block"), "slots", total)
    got = ranked.groupBy("sidx").agg(F.count("*").alias("got"))
    late = q.join(got, "sidx", "left").select("sidx", "quota", F.coalesce("got", F.lit(0)).alias("got")).filter("got < quota")
    late = late.select("sidx", F.explode(F.sequence(F.col("got"), F.col("quota") - 1)).alias("block"))
    late = late.withColumn("slot", F.lit(total) + F.row_number().over(Window.orderBy("block", "sidx")) - 1)
    return ranked.unionByName(late.select("slot", "sidx", "block"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_passes: int = 2,
    block_words: int = 2048,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(schedule, pieces). pieces: for each document (sidx, bucket, nth identify its row; row_col, a unique number of docs' rows, is carried along as ``row`` if it is named)
    and each slot that takes a part of it: id, source, size, source_size, target, slot, block, start and words within the document; a document that no slot takes has one row of 0 words."""
    row = F.col(row_col).cast("long") if row_col else F.lit(None).cast("long")
    place = shuffled_position(F.col(id_col), F.col(text_col), seed)
    cut = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), place.alias("pos"), row.alias("row"))
    sizes = materialize(cut, "sizes")
    n_docs = sizes.count()
    sources = materialize(source_targets(sizes, weights, share, max_passes), "sources", 1)
    n_sources = sources.count()
    hint = F.broadcast if n_sources <= BROADCAST_SOURCES else lambda df: df
    buckets = max(1, n_docs // BUCKET_DOCS)
    schedule = mixing_schedule(sources, block_words)
    here = sizes.join(hint(sources.withColumnRenamed("source", "named")), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    here = here.withColumn("bucket", F.floor(F.col("pos") / (2**60 / buckets)))
    sums = here.groupBy("sidx", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("sidx").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sidx", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("sidx", "bucket").orderBy("pos", "doc_id", "size", "row")
    laid = here.withColumn("nth", F.row_number().over(inside)).withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    laid = laid.join(sums, ["sidx", "bucket"]).withColumn("at", F.col("before") + F.col("upto") - F.col("size"))
    words = F.round("target").cast("long")
    passes = F.when((F.col("size") > 0) & (F.col("at") < words), F.sequence(F.lit(0).cast("long"), F.floor((words - 1 - F.col("at")) / F.col("source_size"))))
    laid = laid.withColumn("pass", F.explode_outer(passes)).withColumn("from", F.col("at") + F.col("pass") * F.col("source_size"))
    last = F.least(F.col("from") + F.col("size"), words) - 1
    laid = laid.withColumn("block", F.explode_outer(F.when(F.col("pass").isNotNull(), F.sequence(F.floor(F.col("from") / block_words), F.floor(last / block_words)))))
    joined = laid.join(schedule, ["sidx", "block"], "left")
    begin = F.greatest("from", F.col("block") * block_words)
    end = F.least(F.col("from") + F.col("size"), (F.col("block") + 1) * block_words, words)
    pieces = joined.select(
        "sidx", "bucket", "nth", "row", "doc_id", "source", "size", "source_size", "target", "slot", "block", (begin - F.col("from")).alias("start"),
        F.when(F.col("slot").isNotNull(), end - begin).otherwise(F.lit(0)).cast("long").alias("words"),
    )
    return schedule, pieces


def mixed_documents(pieces: DataFrame) -> DataFrame:
    """What the mix takes of each document: row, doc_id, size, source_size, target, taken, source."""
    rows = pieces.groupBy("sidx", "bucket", "nth").agg(
        *[F.first(c).alias(c) for c in ("row", "doc_id", "source", "size", "source_size", "target")], F.sum("words").alias("taken")
    )
    return rows.select("row", "doc_id", "size", "source_size", "target", "taken", "source")


def with_mix(docs: DataFrame, **options) -> DataFrame:
    """docs, every row and column kept, plus size, source_size, target and taken of the row itself (with underscores in front where docs has such a name). options: of mix_sources."""
    row, *names = free_names(docs, "row", "size", "source_size", "target", "taken")
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    taken = mixed_documents(mix_sources(keyed, row_col=row, **options)[1])
    taken = taken.select(F.col("row").alias(row), *[F.col(c).alias(n) for c, n in zip(("size", "source_size", "target", "taken"), names, strict=True)])
    return keyed.join(taken, row).drop(row)


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || md5(COALESCE(text, ''))), 1, 15) AS BIGINT) AS pos
  FROM documents),
s0 AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sidx FROM s0),
s2 AS (SELECT *, CASE sidx % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, (SUM(source_size) OVER () * 1.5::DOUBLE - COALESCE(SUM(cap) OVER (ORDER BY cap / w, sidx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / SUM(w) OVER (ORDER BY cap / w, sidx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS (SELECT *, MAX(CASE WHEN level <= cap / w THEN level END) OVER () AS fill FROM s3),
s5 AS (SELECT source, source_size, COALESCE(least(cap, fill * w), cap) AS target FROM s4),
s6 AS (SELECT *, CAST(round(target) AS BIGINT) AS words FROM s5),
o AS (SELECT d.doc_id, d.source, d.size, s6.source_size, s6.target, s6.words,
             SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.pos, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS off
      FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0
            ELSE size * (words // source_size) + greatest(0, least(off + size, words % source_size) - off) END AS BIGINT) AS taken, source
FROM o
"""
