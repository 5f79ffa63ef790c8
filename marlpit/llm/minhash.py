"""MinHash near-dedup with tensored banding.

A set of shingles is hashed to two collections of GROUPS half keys, each the minima of ROWS hash functions. A table belongs to a pair of half keys, one of each collection, so
GROUPS^2 tables with keys of 2 * ROWS minima cost 2 * GROUPS * ROWS functions, the square root of what tables of their own would. Two sets of similarity s meet in some table with
probability (1 - (1 - s^ROWS)^GROUPS)^2: of pairs at 0.8 two in 100,000 are missed.

Only half keys that two sets share are paired up. Tables' buckets with the same members are taken once; members of a bucket whose sizes and minima agree well enough are candidates
(a pair at 0.8 has fewer than AGREE equal minima once in ten million). What candidates connect is a family, and every likely pair of a family is checked on the full sets unless
checked pairs connect it already. A bucket of over TILE sets meets in pairs of tiles, as does a family with very many shingles.

Defined results: sets hold 64-bit hashes of distinct shingles; equal sets share a class; a text without words, or none, is a class of its own; null ids are never the smallest of a class that has
another, and a class of null ids alone has a null component_id and keeps its rows; repeated rows each get a row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.llm.common import heavy_bound, heavy_safe_join, map_arrow, materialize
from marlpit.llm.simhash import apart_pairs, connected_components, hashed_texts, near_duplicate_groups, shingle_set, verified_links

GROUPS, ROWS = 16, 3
FUNCTIONS = 2 * GROUPS * ROWS
#: Equal bytes of two signatures of FUNCTIONS bytes from which sets are candidates: the mean at 0.8 is 77, its deviation 4.
AGREE = 56
#: Sets of a bucket that meet in one row.
TILE = 4096
#: Odd multipliers of the functions, and one that mixes; shingles that are hashed at a time.
MULTIPLIERS = np.random.default_rng(12).integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX, SLICE = np.uint64(0x9E3779B97F4A7C15), 8192


def minima(h: np.ndarray) -> np.ndarray:
    """The smallest value of each function over the hashes."""
    out = np.full(FUNCTIONS, ~np.uint64(0))
    for at in range(0, len(h), SLICE):
        np.minimum(out, (MULTIPLIERS[:, None] * h[None, at : at + SLICE]).min(axis=1), out=out)
    return out


def half_keys(low: np.ndarray) -> np.ndarray:
    """GROUPS keys of the first collection, then GROUPS of the second; those of different places differ."""
    parts = low.reshape(2 * GROUPS, ROWS)
    key = np.arange(1, 2 * GROUPS + 1, dtype=np.uint64) * MIX
    for row in range(ROWS):
        key = (key ^ parts[:, row]) * MIX
        key ^= key >> np.uint64(29)
    return key


def sketches(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, fp (digest of the set, a byte of each minimum, size: 64-bit numbers), n_shingles, text_hash, halves for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, halves = [], [], []
            for text in batch.column(1):
                h = shingle_set(text.as_py(), k)
                low = minima(h)
                fps.append(xxhash.xxh3_128_digest(h.tobytes()) + ((low * MIX) >> np.uint64(56)).astype(np.uint8).tobytes() + len(h).to_bytes(8, "big"))
                sizes.append(len(h))
                halves.append(half_keys(low).view(np.int64))
            flat = pa.array(np.concatenate(halves) if halves else np.array([], dtype=np.int64))
            keys = pa.ListArray.from_arrays(np.arange(0, 2 * GROUPS * len(halves) + 1, 2 * GROUPS, dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), batch.column(2), keys], ["doc_id", "fp", "n_shingles", "text_hash", "halves"])

    return map_arrow(hashed_texts(docs, id_col, text_col), run, "doc_id long, fp binary, n_shingles long, text_hash long, halves array<long>")


def likely_signatures(similarity: float):
    """Which rows' sizes and minima agree well enough with one row's. A row: two numbers of digest, the signature, the size."""

    def likely(row: np.ndarray, rows: np.ndarray) -> np.ndarray:
        size, sizes = row[-1].astype(np.int64), rows[:, -1].astype(np.int64)
        mask = np.minimum(size, sizes) >= similarity * np.maximum(size, sizes) - 1e-6
        if mask.any():
            equal = np.ascontiguousarray(row[2:-1]).view(np.uint8) == np.ascontiguousarray(rows[mask, 2:-1]).view(np.uint8)
            mask[mask] = equal.sum(axis=1) >= AGREE
        return mask

    return likely


def shared_buckets(sets: DataFrame, n: int) -> DataFrame:
    """key, sid, n (members) of tables' buckets that at least two sets share, one of each that have the same members. sets: sid, halves; n: how many."""
    each = sets.select("sid", F.posexplode("halves").alias("at", "half"))
    counted = each.groupBy("half").agg(F.count("*").alias("_n")).filter("_n > 1")
    counted = materialize(counted, "halves-shared")
    mine = heavy_safe_join(each, counted, "half", 2 * GROUPS * n, "_n")
    sides = [F.collect_list(F.when(side, F.col("half"))) for side in (F.col("at") < GROUPS, F.col("at") >= GROUPS)]
    tables = mine.groupBy("sid").agg(sides[0].alias("one"), sides[1].alias("two"))  # GROUPS of each at most
    tables = tables.withColumn("one", F.explode("one")).withColumn("two", F.explode("two"))
    filled = materialize(tables.select(F.xxhash64("one", "two").alias("key"), "sid"), "tables")
    members = [F.bit_xor(F.xxhash64("sid")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "sid")).alias("x2")]
    chosen = filled.groupBy("key").agg(F.count("*").alias("n"), *members).filter("n > 1").groupBy("n", "x1", "x2").agg(F.min("key").alias("key"))
    chosen = materialize(chosen.select("key", "n", F.col("n").alias("_n")), "buckets")
    most, total = chosen.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return heavy_safe_join(filled, chosen, "key", total, "_n") if most > heavy_bound(total) else filled.join(chosen.drop("_n"), "key")


def candidate_links(sets: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """Links (a, b) between fp of sets (fp, halves) that share a bucket and agree, thinned to a forest in each bucket (or pair of a large one's tiles)."""
    sets = materialize(sets.withColumn("sid", F.xxhash64("fp")), "sets")  # two sets with one sid would both take its places
    n = sets.count()
    found = shared_buckets(sets, n)
    tiles = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("sid", F.lit(3)), F.col("tiles")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.struct(F.least("tile", u).alias("t"), F.greatest("tile", u).alias("u"), (F.col("tile") > u).alias("second")))
    dealt = found.withColumn("tiles", tiles).withColumn("tile", own).withColumn("meet", F.explode(meets)).select("key", "meet.t", "meet.u", "meet.second", "sid")
    rows = dealt.join(sets.select("sid", "fp"), "sid").groupBy("key", "t", "u").agg(F.collect_list(F.struct("second", "fp")).alias("members"))
    rows = rows.select("members", (F.col("t") == F.col("u")).alias("same"))
    likely = likely_signatures(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for members, same in zip(*batch.columns, strict=True):
                found: tuple[list, list] = ([], [])
                for m in members.as_py():
                    found[m["second"]].append(m["fp"])
                one, two = (sorted(set(x)) for x in (found[0], found[0] if same.as_py() else found[1]))
                if not one or not two:  # a tile that no set fell into
                    continue
                a, b = (np.frombuffer(b"".join(x), dtype=">u8").astype(np.uint64).reshape(len(x), -1) for x in (one, two))
                for i, j in apart_pairs(a, b, same.as_py(), likely, lambda i, j: True):
                    left.append(one[i])
                    right.append(two[j])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return map_arrow(rows, run, "a binary, b binary")


def minhash_groups(docs: DataFrame, k: int = 4, similarity: float = 0.8, tile: int = TILE, tile_shingles: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row: classes of documents that links of the similarity of their sets of k-word shingles connect."""
    prints = materialize(sketches(docs, k, id_col, text_col), "sketches")
    some = prints.filter("n_shingles > 0")

    def links(fps: DataFrame) -> DataFrame:
        n = fps.count()
        families = connected_components(candidate_links(some.select("fp", "halves").dropDuplicates(["fp"]), similarity, tile), n)
        cut = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        return verified_links(cut, fps, families, similarity, tile_shingles, k, likely_signatures(similarity))

    grouped = near_duplicate_groups(some.drop("halves"), links).select("doc_id", "n_shingles", "component_id")
    alone = prints.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
