"""Substring dedup by seed and extend on winnowed anchors.

Seed: every window of ``length`` words has one anchor, the smallest hash (the last of equals) among its runs of
``anchor`` words. Equal windows have equal anchors, so a window can repeat only if its anchor does. Anchors are
counted over all texts and those met twice are the seeds on which documents are joined. Extend: around each seed the
match is extended both ways, to all the words that its windows cover. Places of a seed that agree in all of them repeat as a whole; where places
differ the windows of each are compared, by the seed's and their own 64-bit hash. Runs of repeated windows are the maximal
repeats. A seed of c places costs c rows, never c * c pairs.

Defined results: null text has no words; repeated rows repeat each other; null ids are ids like any other; texts shorter
than ``length`` words lose nothing; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.llm.common import heavy_safe_join, map_arrow, materialize

LENGTH = 35
ANCHOR = 16
#: Largest size of a filter of seeds, which goes to every task. It only spares work: what it lets through is verified exactly.
MAX_FILTER_BYTES = 1 << 26
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype="<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def running(h: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the words' hashes times powers of base, and the powers of its inverse: (sums[j] - sums[i]) * inverse[i] is the same for equal words i to j wherever they stand."""
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * powers(base, len(h))[:-1], out=sums[1:])
    return sums, powers(pow(base, -1, 1 << 64), len(h))


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of every run of ``size`` words, from the words' hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    sums, down = running(h, base)
    return scrambled((sums[size:] - sums[:-size]) * down[:n])


def anchors(runs: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` consecutive runs the place of its smallest hash, the last of equals."""
    low, at = runs.copy(), np.arange(len(runs))
    have, want = 1, width
    while have < want:
        step = min(have, want - have)
        if len(low) <= step:
            return np.empty(0, dtype=np.int64)
        later = low[step:] <= low[:-step]
        at = np.where(later, at[step:], at[:-step])
        low = np.where(later, low[step:], low[:-step])
        have += step
    return at


def probe_places(h: np.ndarray, bits: int) -> np.ndarray:
    """Four bit places of each hash in a filter of 2**bits bits."""
    mask = np.uint64((1 << bits) - 1)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & mask for i in range(4)])


def seed_anchors(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """anchor: a row for each place of an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty(0, dtype=np.uint64)]
            for text in batch.column(0):
                words = (text.as_py() or b"").split()
                if len(words) >= length:
                    runs = rolling(word_hashes(words)[0], anchor, BASES[0])
                    found.append(runs[np.unique(anchors(runs, length - anchor + 1))])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["anchor"])

    return map_arrow(docs.select(F.col("text").cast("binary").alias("text")), run, "anchor long")


def passes(filled: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be in a filter."""
    place = probe_places(h, (len(filled) * 64).bit_length() - 1).astype(np.int64)
    return ((filled[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0)


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A Bloom filter of the seeds (anchor), of two bytes a seed but MAX_FILTER_BYTES at most, whatever their number; Spark ors its words together."""
    bits = min(max(seeds.count() * 16, 1 << 20), MAX_FILTER_BYTES * 8).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(probe_places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits).ravel().astype(np.int64))
            word, bit = at >> 6, np.left_shift(np.uint64(1), (at & 63).astype(np.uint64))
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.empty(0, dtype=np.int64)
            ored = np.bitwise_or.reduceat(bit, start) if len(start) else np.empty(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word[start]), pa.array(ored.view(np.int64))], ["word", "bits"])

    words = map_arrow(seeds, run, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits"))
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    for batch in words.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return out


def seeded_spans(docs: DataFrame, seeds, length: int, anchor: int) -> DataFrame:
    """A row for each place of an anchor that passes the filter of seeds: doc_id, row, start (of its first window), anchor, off (of the anchor from start), span (hash of all
    words that its windows cover), hashes (of its windows, one word apart)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = seeds.value
        for batch in batches:
            ids, rows, parts, sizes = [], [], [], [np.zeros(1, dtype=np.int32)]
            hashes = [np.empty(0, dtype=np.int64)]
            for doc_id, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = (text.as_py() or b"").split()
                if len(words) < length:
                    continue
                h1, h2 = word_hashes(words)
                runs = rolling(h1, anchor, BASES[0])
                used, first, n = np.unique(anchors(runs, length - anchor + 1), return_index=True, return_counts=True)
                met = passes(filled, runs[used])
                if not met.any():
                    continue
                sums, down = running(h2, BASES[1])
                used, start, n_met = used[met], first[met], n[met]
                span = scrambled((sums[start + n_met - 1 + length] - sums[start]) * down[start])
                parts.append(np.stack([start, runs[used].view(np.int64), used - start, span.view(np.int64)]))
                ids += [doc_id] * len(used)
                rows += [row] * len(used)
                sizes.append(n_met.astype(np.int32))
                hashes.append(rolling(h2, length, BASES[1])[np.repeat(met, n)].view(np.int64))
            cut = np.concatenate(parts, axis=1) if parts else np.empty((4, 0), dtype=np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pa.array(np.concatenate(hashes)))
            columns = [pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(cut[0].astype(np.int32)), pa.array(cut[1]), pa.array(cut[2].astype(np.int32)), pa.array(cut[3]), listed]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "start", "anchor", "off", "span", "hashes"])

    return map_arrow(docs, run, "doc_id long, row long, start int, anchor long, off int, span long, hashes array<long>")


def passing(spans: DataFrame, filled) -> DataFrame:
    """The rows whose anchor passes a filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor = batch.column(batch.schema.get_field_index("anchor")).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(passes(filled.value, anchor)))

    return map_arrow(spans, run, spans.schema)


def repeated_starts(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """docs: doc_id, row, text (binary). doc_id, row, start, n, mask: bit k is set if the window of ``length`` words at start + k (k < n) starts anywhere else too.

    Places whose whole span is equal are counted as one; only where a seed has several spans, as at the ends of a match, are their windows compared one by one,
    those of equal spans once."""
    spark = docs.sparkSession
    seeds = materialize(seed_anchors(docs, length, anchor).groupBy("anchor").count().filter("count > 1").select("anchor"), "seeds")
    met = spark.sparkContext.broadcast(seed_filter(seeds))
    spans = materialize(seeded_spans(docs, met, length, anchor), "spans").withColumn("n", F.size("hashes"))
    key = F.struct("anchor", "off", "n", "span")
    counted = materialize(spans.groupBy("anchor", "off", "n", "span").agg(F.count("*").alias("times")), "counted")
    contested = counted.groupBy("anchor").agg(F.count("*").alias("spans")).filter("spans > 1").select("anchor")
    unsure = spark.sparkContext.broadcast(seed_filter(materialize(contested, "contested")))
    some = passing(spans.select("anchor", "off", "n", "span", "hashes"), unsure).groupBy("anchor", "off", "n", "span")
    some = some.agg(F.first("hashes").alias("hashes"), F.least(F.count("*"), F.lit(2)).alias("times"))
    some = materialize(some.select(key.alias("s"), "times", F.posexplode("hashes").alias("k", "h")).withColumn("w", F.struct("s.anchor", (F.col("s.off") - F.col("k")).alias("off"), "h")), "contested")
    twice = some.groupBy("w").agg(F.sum("times").alias("times"), F.count("*").alias("rows")).filter("times > 1").select("w", "rows")
    twice = materialize(twice, "twice")
    total = twice.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    masks = heavy_safe_join(some.select("s", "k", "w"), twice, "w", total, "rows").groupBy("s").agg(F.sum(F.expr("shiftleft(1L, k)")).alias("mask"))
    known = counted.select(key.alias("s"), "times").join(masks, "s", "left")
    known = known.withColumn("mask", F.when(F.col("times") > 1, F.expr("shiftleft(1L, s.n) - 1")).otherwise(F.col("mask"))).filter("mask <> 0")
    known = materialize(known, "known")
    total = known.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    places = spans.select("doc_id", "row", "start", "n", key.alias("s"))
    return heavy_safe_join(places, known, "s", total, "times").select("doc_id", "row", "start", "n", "mask")


def covered(n_words: int, runs: list[dict], length: int) -> np.ndarray:
    """For each word whether a repeated window covers it. runs: start, n and mask of windows."""
    step = np.zeros(n_words + 1, dtype=np.int64)
    starts = np.array([r["start"] + k for r in runs for k in range(r["n"]) if r["mask"] >> k & 1], dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:-1]) > 0


def substring_dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, repeats (first and past-the-last word of each maximal repeat) for each row."""
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(text_col).cast("binary").alias("text"))
    starts = repeated_starts(cut, length, anchor).groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "n", "mask")).alias("starts"))
    starts = starts.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), "starts")
    joined = cut.join(starts, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row")), "left").select("doc_id", "text", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or b"").split()
                gone = covered(len(words), found.as_py() or [], length)
                edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0])).reshape(-1, 2)
                kept = words if not len(edges) else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                for column, value in zip(out, (len(words), int(gone.sum()), b" ".join(kept).decode("utf-8", "replace"), edges.tolist()), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["doc_id", "n_words", "n_removed", "kept_text", "repeats"])

    return map_arrow(joined, run, "doc_id long, n_words long, n_removed long, kept_text string, repeats array<array<int>>")
