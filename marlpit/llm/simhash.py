"""SimHash fingerprints, tiled exact Hamming comparison and the groups that its links form.

Defined results: null text counts as empty; a text of fewer words than the shingle length has one shingle, its whole
word sequence; a text without words has the fingerprint zero and is linked like any other; equal texts share a
fingerprint and so a group; null ids take part but are never the smallest id of a group that has another; repeated rows
each get a row; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.llm.common import free_names, heavy_bound, heavy_safe_join, map_arrow, materialize

#: Fingerprints in a tile, on average.
TILE = 4096
#: For each byte value its eight bits, most significant first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
#: Odd multipliers that turn one 64-bit hash into further lanes.
LANE_MULTIPLIERS = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """All k-word shingles, repeats included; of fewer words the whole sequence; of none nothing."""
    if not words:
        return []
    if len(words) <= k:
        return [b" ".join(words)]
    return list(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))


def mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """The lane'th hash derived from h: h itself for lane 0, else a multiply and shift mix."""
    if lane == 0:
        return h
    h = (h ^ (h >> np.uint64(31))) * np.uint64(LANE_MULTIPLIERS[lane])
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def majority(h: np.ndarray) -> int:
    """The 64-bit number whose bit is 1 where over half of the hashes have 1."""
    if not len(h):
        return 0
    each = h.astype(">u8").view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(0, 2048, 256)
    ones = (np.bincount(each.ravel(), minlength=2048).reshape(8, 256) @ BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprint(text: bytes | None, k: int, lanes: int = 1) -> tuple[list[int], int]:
    """(a signed 64-bit number per lane, number of shingles) of an A-Z lower-cased text."""
    parts = shingles((text or b"").lower().split(), k)
    h = np.frombuffer(b"".join([xxhash.xxh64_digest(s, 42) for s in parts]), dtype=">u8").astype(np.uint64)
    with np.errstate(over="ignore"):
        out = [majority(mixed(h, lane)) for lane in range(lanes)]
    return [x - (1 << 64) if x >> 63 else x for x in out], len(parts)


def fingerprints(docs: DataFrame, k: int = 3, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (binary of 8 bytes a lane), n_shingles for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), k, lanes) for t in batch.column(1)]
            fps = [np.array(f, dtype=">i8").tobytes() for f, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary()), pa.array([n for _, n in found], pa.int64())], ["doc_id", "fp", "n_shingles"])

    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_arrow(cut, run, "doc_id long, fp binary, n_shingles long")


def popcount_cells(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of the population counts of a fingerprint's parts that two fingerprints within radius can have; of each pair d, -d only one."""
    steps = [d for d in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius]
    return [d for d in steps if d >= (0,) * parts]


def popcount_tiles(fps: DataFrame, radius: int, parts: int = 4) -> tuple[DataFrame, list[int]]:
    """For 64-bit fingerprints: fps with cell, the population counts of its parts packed 8 bits each; and the steps between cells to compare."""
    bits = 64 // parts
    number = F.conv(F.hex("fp"), 16, -10).cast("long")
    cell = F.lit(0).cast("long")
    for i in range(parts):
        cell = cell * 256 + F.bit_count(F.shiftrightunsigned("number", i * bits).bitwiseAND(F.lit((1 << bits) - 1))).cast("long")
    steps = [sum(d * 256 ** (parts - 1 - i) for i, d in enumerate(s)) for s in popcount_cells(parts, radius)]
    return fps.withColumn("number", number).withColumn("cell", cell).drop("number"), steps


def may_be_similar(na: np.ndarray, nb: np.ndarray, far: np.ndarray, similarity: float) -> np.ndarray:
    """Whether two unequal shingle sets of these sizes can be as similar as that, and their fingerprints differ in few enough bits for it."""
    low, high = np.minimum(na, nb), np.maximum(na, nb)
    most = np.where(low == high, (low - 1) / (low + 1), low / np.maximum(high, 1))
    return (most >= similarity) & (far <= np.where(low < SMALL_SET, SMALL_RADIUS, STAGE_RADIUS))


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool, similarity: float | None = None) -> list[tuple[int, int]]:
    """Indexes (i, j) of links between rows of a and of b (lanes in columns), as many as keep connected what all links connect.
    With a similarity the last column is the size of a shingle set, and links are those which may_be_similar lets through."""
    if similarity is not None:
        a, na, b, nb = a[:, :-1], a[:, -1].astype(np.int64), b[:, :-1], b[:, -1].astype(np.int64)
    parent = np.arange(len(a) + (0 if same else len(b)))
    shift, out = 0 if same else len(a), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    rows = max(1, (1 << 17) // max(1, len(b)))
    for at in range(0, len(a), rows):
        far = np.zeros((min(rows, len(a) - at), len(b)), dtype=np.uint16)
        for lane in range(a.shape[1]):
            far += np.bitwise_count(a[at : at + rows, None, lane] ^ b[None, :, lane])
        i, j = np.nonzero(far <= radius)
        if similarity is not None:
            some = may_be_similar(na[i + at], nb[j], far[i, j], similarity)
            i, j = i[some], j[some]
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        while len(i):
            new = parent[i] != parent[j + shift]
            i, j = i[new], j[new]
            if not len(i):
                break
            _, first = np.unique(parent[i] * len(parent) + parent[j + shift], return_index=True)
            for x, y in zip(i[first].tolist(), j[first].tolist(), strict=True):
                p, q = root(x), root(y + shift)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((x, y))
            while (parent != (up := parent[parent])).any():
                parent = up
    return out


def tiled_links(fps: DataFrame, steps: list[int], radius: int, tile: int = TILE, similarity: float | None = None) -> DataFrame:
    """fps: distinct fp with its cell. Links (a, b) between fingerprints at radius or fewer differing bits in cells that one of steps apart, thinned in each
    pair of tiles to a forest of the same components. Tiles whose cells are further apart are never paired. similarity: see forest."""
    n = fps.count()
    counts = materialize(fps.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "cells", 1)  # as many rows as there are cells
    dealt = fps.join(counts, "cell").withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    tiles = materialize(dealt.groupBy("cell", "tile").agg(F.collect_list("fp").alias("fps")), "tiles", n)
    near = tiles.withColumn("step", F.explode(F.array(*[F.lit(s).cast("long") for s in steps]))).withColumn("other", F.col("cell") + F.col("step"))
    near = near.join(counts.select(F.col("cell").alias("other"), "tiles"), "other")
    near = near.withColumn("other_tile", F.explode(F.sequence(F.when(F.col("step") == 0, F.col("tile")).otherwise(F.lit(0)), F.col("tiles") - 1)))
    right = tiles.select(F.col("cell").alias("other"), F.col("tile").alias("other_tile"), F.col("fps").alias("others"))
    pairs = near.join(right, ["other", "other_tile"])
    pairs = pairs.select("fps", "others", ((F.col("step") == 0) & (F.col("tile") == F.col("other_tile"))).alias("same"))

    def lanes(x: pa.ListScalar) -> np.ndarray:
        flat = b"".join(x.as_py())
        return np.frombuffer(flat, dtype=">u8").astype(np.uint64).reshape(len(x), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for one, two, same in zip(*batch.columns, strict=True):
                a, b = lanes(one), lanes(two)
                for i, j in forest(a, b, radius, same.as_py(), similarity):
                    left.append(a[i].astype(">u8").tobytes())
                    right.append(b[j].astype(">u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    # a few pairs of full tiles hold some hundred kB each; batches stay small because rows are dealt evenly
    return map_arrow(pairs, run, "a binary, b binary")


def connected_components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """node, component (its smallest node) of all nodes in links (a, b), by alternating large-star and small-star steps; no group meets in one task but as a minimum,
    and the edges of a node with very many stay where they are. rows: about how many links there are, if known."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = materialize(edges, "edges", rows), None
    while True:
        per = edges.groupBy("b").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"))
        now = rows, most, _ = per.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.expr("bit_xor(x)")).first()
        if now == before:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")).withColumn("low", F.least("a", "low"))
        large = heavy_safe_join(both, low, "a", 2 * rows, "n") if most > heavy_bound(2 * rows) else both.join(low, "a")
        large = large.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        # a node has as many edges here as it has smaller neighbours left after a large-star step
        small = large.join(low, "a").filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = materialize(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "edges", rows)
    return edges.groupBy("a").agg(F.min("b").alias("component")).unionByName(edges.select(F.col("b").alias("a"), F.col("b").alias("component")).distinct()).withColumnRenamed("a", "node")


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles of an A-Z lower-cased text."""
    parts = set(shingles(text.lower().split(), k))
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(s, 42) for s in parts]), dtype=">u8").astype(np.uint64))


def set_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (four lanes over the distinct shingles and, as a fifth number, how many these are), n_shingles, text_hash for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes = [], []
            for text in batch.column(1):
                h = shingle_set(text.as_py(), STAGE_SHINGLE)
                with np.errstate(over="ignore"):
                    fps.append(b"".join(majority(mixed(h, lane)).to_bytes(8, "big") for lane in range(STAGE_LANES)) + len(h).to_bytes(8, "big"))
                sizes.append(len(h))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), batch.column(2)], ["doc_id", "fp", "n_shingles", "text_hash"])

    return map_arrow(hashed_texts(docs, id_col, text_col), run, "doc_id long, fp binary, n_shingles long, text_hash long")


def hashed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (binary, null as empty), text_hash."""
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    return cut.withColumn("text_hash", F.xxhash64("text"))


def size_cell(n: str, similarity: float) -> F.Column:
    """Of two sets as similar as that the cells are the same or neighbours."""
    return F.floor(F.log(F.greatest(F.col(n), F.lit(1))) / F.log(F.lit(1 / similarity))).cast("long")


def likely_prints(similarity: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Which rows of fingerprints (their last number the size of the set) may belong to sets as similar as that to one row's."""

    def likely(row: np.ndarray, rows: np.ndarray) -> np.ndarray:
        far = np.bitwise_count(row[:-1] ^ rows[:, :-1]).sum(axis=1)
        return may_be_similar(row[-1].astype(np.int64), rows[:, -1].astype(np.int64), far, similarity)

    return likely


def apart_pairs(a: np.ndarray, b: np.ndarray, same: bool, likely, check: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Indexes (i, j) of rows of a and of b (of a itself if same) that are likely and pass the check, as many as keep connected what all such pairs connect:
    a pair is passed over only if pairs that passed connect it already, so a group of copies costs a look at each."""
    shift, out = 0 if same else len(a), []
    parent = np.arange(len(a) if same else len(a) + len(b))
    for i in range(len(a)):
        at = i + 1 if same else 0
        others = at + np.flatnonzero(parent[at + shift :] != parent[i])
        for j in others[likely(a[i], b[others])].tolist() if len(others) else ():
            p, q = parent[i], parent[j + shift]
            if p != q and check(i, j):
                parent[parent == max(p, q)] = min(p, q)
                out.append((i, j))
    return out


def verified_forest(a: np.ndarray, b: np.ndarray, sets_a: list[np.ndarray], sets_b: list[np.ndarray], same: bool, similarity: float, likely=None) -> list[tuple[int, int]]:
    """apart_pairs of rows whose shingle sets have the similarity."""

    def check(i: int, j: int) -> bool:
        common = len(np.intersect1d(sets_a[i], sets_b[j], assume_unique=True))
        return common / (len(sets_a[i]) + len(sets_b[j]) - common) >= similarity

    return apart_pairs(a, b, same, likely or likely_prints(similarity), check)


def verified_links(docs: DataFrame, fps: DataFrame, families: DataFrame, similarity: float, tile_shingles: int | None = None, k: int | None = None, likely=None) -> DataFrame:
    """Links (a, b) between fingerprints of one family (node, component) whose texts' distinct shingles have the similarity.
    fps: distinct fp (whole 64-bit numbers, of which likely tells which pairs are worth a check) with n_shingles and first, a row (no_id, doc_id, text_hash) that has it.

    The shingle sets of a family meet in one row. A family of more than tile_shingles is split by size and hash into tiles, and each two tiles that can
    hold a link meet in a row. Links are thinned to a forest of each row only after the exact check."""
    most, words = tile_shingles or TILE_SHINGLES, k or STAGE_SHINGLE
    n = fps.count()
    members = fps.join(families.select(F.col("node").alias("fp"), F.col("component").alias("family")), "fp")
    members = materialize(members.withColumn("size", size_cell("n_shingles", similarity)), "members", n)
    cells = materialize(members.groupBy("family", "size").agg(F.sum("n_shingles").alias("weight"), F.count("*").alias("n")), "family-cells", n)
    whole = cells.groupBy("family").agg((F.sum("weight") <= most).alias("whole"))
    tiles = cells.select("family", "size", F.ceil(F.col("weight") / most).cast("int").alias("tiles"))
    cells = cells.join(whole, "family").join(tiles, ["family", "size"])
    for name, step in (("before", 1), ("after", -1)):
        cells = cells.join(tiles.select("family", (F.col("size") + step).alias("size"), F.col("tiles").alias(name)), ["family", "size"], "left")
    cells = materialize(cells.drop("weight"), "family-tiles", n)
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dealt = heavy_safe_join(members, cells, ["family", "size"], total, "n").withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))

    def meeting(c1, t1, c2, t2, side):
        return F.struct(F.concat_ws(" ", *[x.cast("string") for x in (c1, t1, c2, t2)]).alias("key"), side.cast("int").alias("side"))

    size, tile = F.col("size"), F.col("tile")
    own = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: meeting(size, F.least(tile, u), size, F.greatest(tile, u), tile > u))
    after = F.when(F.col("after") > 0, F.transform(F.sequence(F.lit(0), F.col("after") - 1), lambda u: meeting(size, tile, size + 1, u, F.lit(0))))
    before = F.when(F.col("before") > 0, F.transform(F.sequence(F.lit(0), F.col("before") - 1), lambda u: meeting(size - 1, u, size, tile, F.lit(1))))
    none = F.array().cast("array<struct<key:string,side:int>>")
    split = F.concat(own, F.coalesce(after, none), F.coalesce(before, none))
    meets = F.when(F.col("whole"), F.array(F.struct(F.lit("").alias("key"), F.lit(0).alias("side")))).otherwise(split)
    dealt = materialize(dealt.select("fp", "family", F.col("first.doc_id").alias("first_doc"), F.col("first.text_hash").alias("first_hash"), meets.alias("meets")), "dealt", n)
    texts = hashed_texts(docs).join(dealt, F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("text_hash") == F.col("first_hash"))).select("family", "meets", "fp", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shingle_set(t.as_py(), words).tobytes() for t in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], found], ["family", "meets", "fp", "shingles"])

    found = map_arrow(texts, sets, "family binary, meets array<struct<key:string,side:int>>, fp binary, shingles binary")
    rows = found.select("family", "fp", "shingles", F.explode("meets").alias("meet")).select("family", "meet.key", F.struct("meet.side", "fp", "shingles").alias("member"))
    rows = rows.groupBy("family", "key").agg(F.collect_list("member").alias("members")).select("key", "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for key, members in zip(*batch.columns, strict=True):
                # rows that repeat an id and a text come more than once
                sides: tuple[dict, dict] = ({}, {})
                for m in members:
                    sides[m["side"].as_py()][m["fp"].as_py()] = np.frombuffer(m["shingles"].as_py(), dtype=np.uint64)
                c1, t1, c2, t2 = key.as_py().split(" ") if key.as_py() else "0000"
                same = (c1, t1) == (c2, t2)
                a, b = list(sides[0]), list(sides[0 if same else 1])
                if not a or not b:  # a tile that no set fell into
                    continue
                one, two = (np.frombuffer(b"".join(x), dtype=">u8").astype(np.uint64).reshape(len(x), -1) for x in (a, b))
                for i, j in verified_forest(one, two, list(sides[0].values()), list(sides[0 if same else 1].values()), same, similarity, likely):
                    left.append(a[i])
                    right.append(b[j])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return map_arrow(rows, run, "a binary, b binary")


def near_duplicate_groups(prints: DataFrame, links_of) -> DataFrame:
    """prints: doc_id, fp. links_of(distinct fp, with n_shingles and a first row if prints has n_shingles and text_hash) gives links. Adds component_id: the smallest doc_id reachable by equal fingerprints and links."""
    n = prints.count()
    more = [F.max("n_shingles").alias("n_shingles"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")] if "text_hash" in prints.columns else []
    per = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("min_doc"), F.count("*").alias("n"), *more), "distinct", n)
    parts = connected_components(links_of(per.drop("min_doc", "n")), n)
    joined = materialize(per.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "joined", n)
    ids = joined.groupBy("component").agg(F.min("min_doc").alias("component_id"))
    known = materialize(joined.join(ids, "component").select("fp", "component_id", "n"), "known", n)
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return heavy_safe_join(prints, known, "fp", total, "n")


def simhash_groups(docs: DataFrame, k: int = 3, radius: int = 2, parts: int = 4, tile: int = TILE) -> DataFrame:
    """doc_id, fp, component_id: documents linked where 64-bit fingerprints over k-word shingles differ in radius or fewer bits."""
    prints = materialize(fingerprints(docs, k).select("doc_id", "fp"), "fingerprints")
    return near_duplicate_groups(prints, lambda fps: tiled_links(*popcount_tiles(fps, radius, parts), radius, tile))


#: Fingerprint of the near-duplicate stage: four lanes are 256 bits over the distinct 5-word shingles. It only finds candidates. Two sets of similarity 0.8 differ in
#: 39 bits on average; over STAGE_RADIUS bits differ for less than one pair in 10,000. Of sets of 4 and 5 shingles 48 bits differ on average, so pairs with a set under SMALL_SET have a radius of their own.
STAGE_SHINGLE, STAGE_LANES, STAGE_RADIUS, STAGE_SIMILARITY = 5, 4, 64, 0.8
SMALL_SET, SMALL_RADIUS = 5, 80
#: Shingles of a family, or of a tile of a larger one, that meet in a row.
TILE_SHINGLES = 1 << 18


def near_duplicates(docs: DataFrame, similarity: float = STAGE_SIMILARITY, tile: int = TILE, tile_shingles: int | None = None) -> DataFrame:
    """doc_id, fp, n_shingles, component_id: documents linked where the similarity of their sets of 5-word shingles (64-bit hashes) is at least that much."""
    prints = materialize(set_fingerprints(docs), "fingerprints")

    def links(fps: DataFrame) -> DataFrame:
        cells = fps.select("fp", size_cell("n_shingles", similarity).alias("cell"))
        families = connected_components(tiled_links(cells, [0, 1], SMALL_RADIUS, tile, similarity), fps.count())
        return verified_links(docs, fps, families, similarity, tile_shingles)

    return near_duplicate_groups(prints, links).drop("text_hash")


def first_of_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of docs but those whose id isn't its group's smallest. Rows with one id are one document; rows without an id stay."""
    (name,) = free_names(docs, "_gone")
    gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
