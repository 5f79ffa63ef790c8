"""Token counts as rollups that batches of signed changes keep up to date.

A ledger is a folder with one subfolder per committed batch: ``rows`` (a signed row per document and tokenizer version, in
buckets of the document id) and ``totals`` (their sums by source, language and tokenizer version). An insert adds rows, a
delete adds the document's rows with the sign turned, a revision does both; equal rows of opposite sign cancel. Totals are sums
of sums, so reading them never touches documents, and a batch reads only the buckets that its ids fall in. A batch is written
beside the ledger and renamed into place, which makes it take effect as a whole; committing an id that is there already does
nothing, so a batch can be replayed after a failure. The rename takes effect at once on file systems that rename folders so (HDFS, local disks), not on object stores. Many batches are compacted into a snapshot in the same way. One writer at a time.

Defined results: null and empty texts count as documents of 0 tokens; null sources and languages are groups of their own; a
batch deletes before it inserts, so an id in both is a revision; rows with equal ids in one batch each count, and a later delete
or revision of the id covers all of them; rows with a null id can be inserted but not deleted; an empty batch commits nothing
but its id; other columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.llm.common import hadoop_path, heavy_safe_join, map_arrow, materialize, scratch_path, word_count

#: How a byte-level BPE of this kind cuts a text before merging (fixed value of the public vocabulary).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROWS = "doc_id long, source string, lang string, tokenizer string, n_tokens long, sign int"
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
GROUP = ["source", "lang", "tokenizer"]
#: Texts are encoded in pieces of so many characters, cut before a blank, so that a very long one needs no more memory.
PIECE_CHARS = 1 << 18
#: A blank between two words.
CUT = re.compile(r"(?<=\S) (?!\s)")
#: Buckets of document ids, and commits after which a snapshot is taken.
BUCKETS, COMPACT_AFTER = 16, 32
_encodings: dict[str, object] = {}


def encoding(ranks_path: str):
    """The tokenizer of a file of ranks; loaded once in a worker."""
    if ranks_path not in _encodings:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[ranks_path] = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return _encodings[ranks_path]


def n_tokens(text: str, ranks_path: str) -> int:
    enc, total, at = encoding(ranks_path), 0, 0
    while at < len(text):
        cut = CUT.search(text, at + PIECE_CHARS)
        end = cut.start() if cut else len(text)
        total += len(enc.encode_ordinary(text[at:end]))
        at = end
    return total


def token_rows(docs: DataFrame, tokenizers: Mapping[str, str | None]) -> DataFrame:
    """ROWS of sign 1 for each document and tokenizer version. tokenizers: version -> path of its file of ranks on every machine, or None for words."""
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text")
    paths = {name: path for name, path in tokenizers.items() if path is not None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3)
            for name, path in paths.items():
                counts = [n_tokens(t.as_py() or "", path) for t in texts]
                extra = [pa.array([name] * len(counts)), pa.array(counts, pa.int64()), pa.array([1] * len(counts), pa.int32())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *extra], ["doc_id", "source", "lang", "tokenizer", "n_tokens", "sign"])

    parts = [map_arrow(cut, run, ROWS)] if paths else []
    for name in tokenizers.keys() - paths.keys():
        parts.append(cut.select("doc_id", "source", "lang", F.lit(name).alias("tokenizer"), word_count(F.col("text")).alias("n_tokens"), F.lit(1).alias("sign")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class TokenLedger:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, compact_after: int = COMPACT_AFTER):
        """buckets must be the same each time that a ledger is opened."""
        self.spark, self.path, self.buckets, self.compact_after = spark, path.rstrip("/"), buckets, compact_after

    def _names(self, folder: str) -> list[str]:
        fs, where = hadoop_path(self.spark, f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []

    def _snapshot(self) -> tuple[str | None, set[str]]:
        """(folder of the newest snapshot, the batches that it holds)."""
        made = self._names("snapshots")
        if not made:
            return None, set()
        last = f"{self.path}/snapshots/{made[-1]}"
        return last, {r[0] for r in self.spark.read.schema("batch string").parquet(f"{last}/batches").collect()}

    def batches(self) -> list[str]:
        return sorted(self._snapshot()[1] | set(self._names("commits")))

    def _read(self, kind: str, schema: str) -> DataFrame:
        last, held = self._snapshot()
        folders = ([last] if last else []) + [f"{self.path}/commits/{b}" for b in self._names("commits") if b not in held]
        if not folders:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).parquet(f"{x}/{kind}") for x in folders]  # compaction bounds their number
        return reduce(DataFrame.unionByName, parts)

    def rows(self) -> DataFrame:
        """ROWS and their bucket."""
        return self._read("rows", f"{ROWS}, bucket int")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
        sums = self._read("totals", TOTALS).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 OR n_tokens <> 0")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def commit(self, batch_id: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Commit a batch: deletes (doc_id) take ids out, then upserts (ROWS of sign 1) replace what the ledger has of their ids and tokenizers. False if the batch was there."""
        known = self.batches()
        if batch_id in known:
            return False
        change = self.spark.createDataFrame([], ROWS) if upserts is None else upserts
        if known:
            change = materialize(change, "change")
            change = change.unionByName(self._replaced(change, deletes))
        net = change.groupBy("doc_id", *GROUP, "n_tokens").agg(F.sum("sign").alias("sign")).filter("sign <> 0") if known else change
        self._put(net, f"staged-{batch_id}", f"commits/{batch_id}")
        if len(self._names("commits")) > self.compact_after:
            self.compact()
        return True

    def _replaced(self, change: DataFrame, deletes: DataFrame | None) -> DataFrame:
        """The ledger's rows that a batch takes out, each once, with the sign turned; of the ledger only buckets that the batch meets are read."""
        gone = change.select("doc_id", "tokenizer").distinct()
        if deletes is not None:
            gone = gone.unionByName(deletes.select(F.col("doc_id").cast("long"), F.lit(None).cast("string").alias("tokenizer")).distinct())
        gone = materialize(gone.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_set("tokenizer").alias("only"), F.count_if(F.col("tokenizer").isNull()).alias("whole")), "gone")
        met = [r[0] for r in gone.select(self._bucket()).distinct().collect()]  # BUCKETS numbers at most
        old = self.rows().filter(F.col("bucket").isin(met)).drop("bucket").join(gone, "doc_id")
        return old.filter((F.col("whole") > 0) | F.array_contains("only", F.col("tokenizer"))).drop("only", "whole").withColumn("sign", -F.col("sign"))

    def _put(self, rows: DataFrame, staged: str, place: str, batches: list[str] | None = None) -> None:
        """Write rows and their totals beside the ledger, then rename them into place."""
        staged = f"{self.path}/{staged}"
        bucketed = rows.select("doc_id", *GROUP, "n_tokens", F.col("sign").cast("int"), self._bucket().alias("bucket"))
        bucketed.write.mode("overwrite").partitionBy("bucket").parquet(f"{staged}/rows")
        written = self.spark.read.schema(f"{ROWS}, bucket int").parquet(f"{staged}/rows")
        sums = written.groupBy(*GROUP).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{staged}/totals")
        if batches is not None:
            self.spark.createDataFrame([(b,) for b in batches], "batch string").write.mode("overwrite").parquet(f"{staged}/batches")
        fs, done = hadoop_path(self.spark, f"{self.path}/{place}")
        fs.mkdirs(done.getParent())
        if not fs.rename(hadoop_path(self.spark, staged)[1], done):
            raise OSError(f"{place} could not be put in place")

    def compact(self) -> None:
        """Sum the signed rows of all batches into a new snapshot; what it holds is then deleted."""
        old, batches = self._names("snapshots"), self.batches()
        net = self.rows().groupBy("doc_id", *GROUP, "n_tokens").agg(F.sum("sign").alias("sign")).filter("sign <> 0")
        self._put(net, "staged-snapshot", f"snapshots/{len(batches):012d}", batches)
        for gone in [f"snapshots/{x}" for x in old] + [f"commits/{b}" for b in self._names("commits") if b in set(batches)]:
            fs, where = hadoop_path(self.spark, f"{self.path}/{gone}")
            fs.delete(where, True)


def later_copies(docs: DataFrame) -> DataFrame:
    """doc_id of each document whose text a document with a smaller id has too."""
    prints = docs.select("doc_id", F.sha2("text", 256).alias("h")).filter("h IS NOT NULL")
    first = materialize(prints.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "copies")
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return heavy_safe_join(prints, first, "h", total, "n").filter("doc_id > first").select("doc_id")


def masked(docs: DataFrame) -> DataFrame:
    """Revisions for a ledger that counted the documents as they were: of each id with numbers in a text all its rows, each run of digits turned into one zero.
    Rows without an id can't be revised and are left out."""
    per = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("_n"), F.coalesce(F.bool_or(F.col("text").rlike("[0-9]")), F.lit(False)).alias("_some"))
    some = materialize(per.filter("_some").drop("_some"), "numbered")
    total = some.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    rows = heavy_safe_join(docs.select("doc_id", "source", "lang", "text"), some, "doc_id", total, "_n")
    return rows.withColumn("text", F.regexp_replace("text", "[0-9]+", "0"))


def new_ledger(spark: SparkSession) -> TokenLedger:
    """A ledger in the shared folder."""
    return TokenLedger(spark, scratch_path(spark, "ledger"))
