"""Incremental line dedup: sharded cuckoo filters in front of exact reference-count tables.

The index keeps, for every line key (ASCII-trimmed, A-Z lower-cased, 10 code points or more), how many documents hold it
and which ids do, in exact tables cut into shards by key, and for each shard a cuckoo filter of its keys. The tables are only
added to: a batch writes its own signed counts and holders, and counts are summed when they are read. A new batch asks the filters
first: keys they don't hold are new and need no look at the exact counts; only the others are looked up.
Deleting a document adds negative counts and takes keys without holders out of the filters, so line dedup is reversible.

Defined results: null text is one empty line; short keys are never dropped; a key repeated within the smallest document
that holds it stays there; rows with one doc_id are one document; rows with a null doc_id keep all their lines and aren't
indexed; an empty table gives an empty result; other columns of the input are passed over or kept as the caller asks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlpit.llm.common import ROWS_PER_FILE, free_names, heavy_safe_join, map_arrow, materialize
from marlpit.llm.cuckoo import CuckooFilter, CuckooFull, filter_of

MIN_CHARS = 10
#: Keys expected in a shard; a shard's keys meet in one row.
SHARD_KEYS = 50_000


def line_key(line: bytes) -> bytes | None:
    """The 128-bit hash of a line's key, or None for a short one."""
    key = line.strip().lower()
    if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode("utf-8", "replace")) < MIN_CHARS):
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key: each key of each row once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = {line_key(x) for x in (text.as_py() or b"").split(b"\n")} - {None}
                ids += [doc_id] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_arrow(cut.filter("doc_id IS NOT NULL"), run, "doc_id long, key binary")


def as_words(keys: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(keys.to_pylist()), dtype="<u8").reshape(-1, 2)


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.StructArray | None, bytes | None]]:
    """(shard, its rows, its filter) of rows (shard, rows: array of structs, cells), one shard at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), batch.column(1)[i].values, batch.column(2)[i].as_py()


#: Batches after which an index sums up its tables.
COMPACT_AFTER = 32


class LineIndex:
    """The state, as tables in the shared folder that are never rewritten, but for the shards of filters whose keys changed: counts (key, shard, n, min_doc) and holders (doc_id, key, since),
    one of each for a batch; gone (doc_id, until) for deletions; filters (shard, cells). Summed counts are what counts: n documents hold a key, min_doc is the smallest of them that was inserted.
    A change takes up its tables when all are written, so a failed one leaves the index as it was."""

    def __init__(self, spark: SparkSession, expected: int):
        """expected: about how many (document, key) rows the index will hold."""
        self.spark, self.rows, self.shards, self.batch = spark, expected, max(1, expected // SHARD_KEYS), 0
        self.counts: list[DataFrame] = []
        self.held: list[DataFrame] = []
        self.gone: list[DataFrame] = []
        self.filters = spark.createDataFrame([], "shard int, cells binary")

    def _with_shard(self, df: DataFrame) -> DataFrame:
        return df.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int"))

    def holders(self) -> DataFrame:
        """doc_id, key of all documents that are in the index."""
        if not self.held:
            return self.spark.createDataFrame([], "doc_id long, key binary")
        every = reduce(DataFrame.unionByName, self.held)
        if self.gone:
            last = reduce(DataFrame.unionByName, self.gone).groupBy(F.col("doc_id").alias("_gone")).agg(F.max("until").alias("until"))
            every = every.join(last, (F.col("doc_id") == F.col("_gone")) & (F.col("since") < F.col("until")), "left_anti")
        return every.select("doc_id", "key")

    def refs(self, only: DataFrame | None = None) -> DataFrame:
        """key, shard, n, min_doc of all keys that documents hold, or of some (key, each once), whose counts alone are then summed."""
        if not self.counts:
            return self.spark.createDataFrame([], "key binary, shard int, n long, min_doc long")
        counts = reduce(DataFrame.unionByName, self.counts)
        sums = (counts if only is None else counts.join(only, "key", "left_semi")).groupBy("key").agg(F.first("shard").alias("shard"), F.sum("n").alias("n"), F.min("min_doc").alias("min_doc"), F.count_if(F.col("n") < 0).alias("taken"))
        sums = sums.filter("n > 0")
        if self.gone:  # where documents were taken out the smallest may be another
            found = self.holders().join(sums.filter("taken > 0").select("key"), "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("lowest"))
            sums = sums.join(found, "key", "left").withColumn("min_doc", F.coalesce("lowest", "min_doc"))
        return sums.select("key", "shard", "n", "min_doc")

    def insert(self, holders: DataFrame) -> None:
        """Add documents, given as (doc_id, key) rows; documents that the index holds already must be deleted first."""
        batch = self.batch + 1
        new = self._with_shard(holders.groupBy("key").agg(F.countDistinct("doc_id").alias("n"), F.min("doc_id").alias("min_doc")))
        grouped = new.groupBy("shard").agg(F.collect_list(F.struct("key", "n", "min_doc")).alias("rows")).join(self.filters, "shard", "left").select("shard", "rows", "cells")

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, rows, cells in shards_of(batches):
                keys = rows.field("key")
                maybe = CuckooFilter(table=cells).contains(as_words(keys)) if cells is not None else np.zeros(len(keys), dtype=bool)
                columns = [keys, pa.array(np.full(len(keys), shard, dtype=np.int32)), rows.field("n"), rows.field("min_doc"), pa.array(maybe)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "shard", "n", "min_doc", "maybe"])

        asked = materialize(map_arrow(grouped, probe, "key binary, shard int, n long, min_doc long, maybe boolean"), "asked", self.rows)
        fresh = asked.filter("NOT maybe").select("key", "shard")
        if self.counts:  # false positives of the filters are new keys too
            unsure = asked.filter("maybe").select("key", "shard")
            fresh = fresh.unionByName(unsure.join(self.refs(unsure.select("key")).select("key"), "key", "left_anti"))
        counts, held = asked.drop("maybe"), materialize(holders.distinct().withColumn("since", F.lit(batch)), "holders", self.rows)
        self._changed(fresh, [*self.counts, counts], lambda f, keys: f.insert(keys))
        self.held, self.batch = [*self.held, held], batch
        self._compact()

    def delete(self, doc_ids: DataFrame) -> None:
        """Take documents (doc_id) out again."""
        batch = self.batch + 1
        ids = materialize(doc_ids.select(F.col("doc_id").cast("long")).distinct().withColumn("until", F.lit(batch)), "gone")
        lost = self.holders().join(ids, "doc_id", "left_semi").groupBy("key").agg(F.count("*").alias("fewer"))
        lost = materialize(self._with_shard(lost.select("key", (-F.col("fewer")).alias("n"), F.lit(None).cast("long").alias("min_doc"))).select("key", "shard", "n", "min_doc"), "lost")
        emptied = lost.select("key", "shard", "n").unionByName(reduce(DataFrame.unionByName, self.counts).select("key", "shard", "n").join(lost.select("key"), "key", "left_semi")) if self.counts else lost
        emptied = emptied.groupBy("key", "shard").agg(F.sum("n").alias("left")).filter("left = 0").select("key", "shard")
        self.gone, self.batch = [*self.gone, ids], batch
        self._changed(emptied, [*self.counts, lost], lambda f, keys: f.delete(keys))
        self._compact()

    def _compact(self) -> None:
        """After COMPACT_AFTER batches: one table of the counts and one of the holders as they are now, in place of one of each for a batch."""
        if len(self.counts) <= COMPACT_AFTER:
            return
        counts, held = materialize(self.refs(), "counts"), materialize(self.holders().withColumn("since", F.lit(self.batch)), "holders")
        self.counts, self.held, self.gone = [counts], [held], []

    def _changed(self, keys: DataFrame, counts: list[DataFrame], change) -> None:
        """Take up counts and the filters after change(filter, keys) in each shard with changed keys; a full one is rebuilt from the counts, with room to double."""

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, rows, cells in shards_of(batches):
                words = as_words(rows.field("key"))
                if cells is None:
                    made = filter_of(words, 2.0).to_bytes()
                else:
                    held = CuckooFilter(table=cells)
                    try:
                        change(held, words)
                        made = held.to_bytes()
                    except CuckooFull:
                        made = None
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([made], pa.binary())], ["shard", "cells"])

        def grouped(rows: DataFrame) -> DataFrame:
            return rows.groupBy("shard").agg(F.collect_list(F.struct("key")).alias("rows"))

        few = self.shards * (ROWS_PER_FILE // 8)
        made = materialize(map_arrow(grouped(keys).join(self.filters, "shard", "left").select("shard", "rows", "cells"), one, "shard int, cells binary"), "filters", few)
        full = made.filter("cells IS NULL").select("shard")
        before, self.counts = self.counts, counts
        if not full.isEmpty():
            again = grouped(self.refs().join(full, "shard", "left_semi")).withColumn("cells", F.lit(None).cast("binary"))
            made = materialize(made.filter("cells IS NOT NULL").unionByName(map_arrow(again, one, "shard int, cells binary")), "filters", few)
        same = self.filters.join(made.select("shard"), "shard", "left_anti")
        self.filters = materialize(made.unionByName(same), "filters", few) if before else made

    def drops(self) -> DataFrame:
        """doc_id, keys: the keys whose lines each document loses, as another document with a smaller id holds them too."""
        holders = self.holders()
        repeated = materialize(self.refs().filter("n > 1").select("key", "min_doc", "n"), "repeated", self.rows)
        lost = heavy_safe_join(holders, repeated, "key", holders.count(), "n").filter("doc_id <> min_doc")
        return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def index_lines(docs: DataFrame, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    """An index of all rows, which arrive in ``batches`` commits (every row in one of them, by the hash of its id)."""
    spark = docs.sparkSession
    holders = materialize(line_keys(docs, id_col, text_col), "lines")
    index = LineIndex(spark, holders.count())
    for b in range(batches):
        index.insert(holders.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b))
    return index


def without_lines(docs: DataFrame, drops: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: str = "_") -> DataFrame:
    """docs, every column kept, plus n_lines, n_dropped and kept_text (the text without the lines whose keys drops has for its id), their names after the prefix; columns of docs with such a name are replaced."""
    added = [f"{prefix}{c}" for c in ("n_lines", "n_dropped", "kept_text")]
    docs = docs.drop(*added)
    doc, keys = free_names(docs, "_doc", "_keys")
    drops = drops.select(F.col("doc_id").alias(doc), F.col("keys").alias(keys))
    joined = docs.join(drops, F.col(id_col).cast("long") == F.col(doc), "left").drop(doc)
    schema = StructType(list(docs.schema.fields)).add(added[0], "long").add(added[1], "long").add(added[2], "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, gone in zip(batch.column(batch.schema.get_field_index(text_col)), batch.columns[-1], strict=True):
                lines, gone = (text.as_py() or "").split("\n"), set(gone.as_py() or ())
                stay = [x for x in lines if line_key(x.encode()) not in gone] if gone else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append("\n".join(stay))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], [*batch.schema.names[:-1], *added])

    return map_arrow(joined, run, schema)


def line_dedup(docs: DataFrame, batches: int = 2, prefix: str = "_") -> DataFrame:
    """docs, every column kept, plus n_lines, n_dropped and kept_text, their names after the prefix."""
    return without_lines(docs, index_lines(docs, batches).drops(), prefix=prefix)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


LINE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(COALESCE(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, min(doc_id) AS low FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
f AS (SELECT k.*, g.low IS NOT NULL AND k.doc_id <> g.low AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(COALESCE(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM f GROUP BY r, doc_id
"""
