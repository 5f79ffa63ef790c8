"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact similarity of shingles.

For every benchmark item of m words, windows of m words are taken at each start of a document where they hold at least one
of the item's 5-word shingles (elsewhere their similarity is zero). A window's fingerprint is looked up in an index of the
items' fingerprints by eight blocks: items within ``radius`` differ by radius // 8 bits or fewer in some block, so none
is missed. What is found within the radius is verified by the exact similarity of shingles weighted by how often they occur: the sum of the smaller
counts over the sum of the larger.

Words are lower-cased runs without blanks and punctuation. Defined results: an item of fewer words than a shingle has one
shingle, its whole word sequence, and matches where that occurs; a document shorter than an item is compared as a whole; null
and empty texts and items match nothing; null ids are ids like any other; repeated rows each match; empty tables give empty
results; other columns are kept or not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlpit.llm.common import free_names, map_arrow
from marlpit.llm.simhash import BITS, majority
from marlpit.llm.substring import BASES, rolling

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 20, 8
#: Items that are held by every task at a time; a larger benchmark is searched in so many passes more.
ITEMS_PER_PASS = 20_000
WIDE_MARKS = re.compile("[ -¿ -⁯　-〿]")
#: ASCII that isn't a letter or digit becomes a blank.
MARKS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def normal_words(text: str) -> list[bytes]:
    text = text.lower()
    if not text.isascii() and WIDE_MARKS.search(text):
        text = WIDE_MARKS.sub(" ", text)
    return text.encode("utf-8", "replace").translate(MARKS).split()


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype="<u8")
    return rolling(h, size, BASES[0])


def window_prints(h: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """The fingerprints of the windows of ``size`` shingles at starts, by running sums of the shingles' bits."""
    low = int(starts.min())
    part = h[low : int(starts.max()) + size]
    bits = BITS[part.astype(">u8").view(np.uint8).reshape(-1, 8)].reshape(len(part), 64)
    sums = np.zeros((len(part) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    ones = sums[starts - low + size] - sums[starts - low]
    return np.packbits(2 * ones > size, axis=1).view(">u8").ravel().astype(np.uint64)


@dataclass
class ItemIndex:
    """Items by shingle and by fingerprint block."""

    ids: list[int | None]
    counts: list[Counter]
    sizes: np.ndarray  # in shingles
    shingles: np.ndarray  # sorted, distinct
    first: np.ndarray  # of each shingle's items in holders
    holders: np.ndarray
    prints: np.ndarray
    blocks: np.ndarray  # [block, byte]: packed flags of the items within radius // BLOCKS bits
    short: dict[int, dict[int, list[int | None]]]  # of fewer words than a shingle: number of words -> hash of the word sequence -> ids

    def near(self, print_: np.uint64, radius: int) -> np.ndarray:
        """Numbers of the items within radius bits."""
        own = np.array([print_], dtype=np.uint64).astype(">u8").view(np.uint8)
        flags = np.bitwise_or.reduce(self.blocks[np.arange(BLOCKS), own], axis=0)
        some = np.flatnonzero(np.unpackbits(flags, count=len(self.ids)))
        return some[np.bitwise_count(self.prints[some] ^ print_) <= radius]


def build_index(items: list[tuple[int | None, str | None]], radius: int = RADIUS) -> ItemIndex | None:
    hashed: list[tuple[int | None, np.ndarray]] = []
    short: dict[int, dict[int, list[int | None]]] = {}
    for i, t in items:
        words = normal_words(t or "")
        if len(words) >= SHINGLE:
            hashed.append((i, shingle_hashes(words)))
        elif words:
            short.setdefault(len(words), {}).setdefault(int(shingle_hashes(words, len(words))[0]), []).append(i)
    if not hashed and not short:
        return None
    pairs = np.unique(np.concatenate([np.empty((0, 2), dtype=np.uint64), *(np.stack([h, np.full(len(h), n, dtype=np.uint64)], axis=1) for n, (_, h) in enumerate(hashed))]), axis=0)
    shingles, first = np.unique(pairs[:, 0], return_index=True)
    prints = np.array([majority(h) for _, h in hashed], dtype=np.uint64)
    own = prints.astype(">u8").view(np.uint8).reshape(-1, BLOCKS)
    flips = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])
    blocks = np.stack([np.packbits(flips[:, own[:, b]] <= radius // BLOCKS, axis=1) for b in range(BLOCKS)])
    return ItemIndex([i for i, _ in hashed], [Counter(h.tolist()) for _, h in hashed], np.array([len(h) for _, h in hashed]), shingles, np.r_[first, len(pairs)], pairs[:, 1].astype(np.int64), prints, blocks, short)


def weighted_similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (a.total() + b.total() - both)


def short_matches(words: list[bytes], index: ItemIndex) -> list[dict]:
    """The first place of each item of fewer words than a shingle whose word sequence occurs."""
    out = []
    for size, items in sorted(index.short.items()):
        h = shingle_hashes(words, size)
        found, first = np.unique(h, return_index=True)
        for x, start in zip(found.tolist(), first.tolist(), strict=True):
            out += [{"item_id": i, "start": start, "n_words": size, "similarity": 1.0} for i in items.get(x, ())]
    return out


def matches(text: str, index: ItemIndex, radius: int, similarity: float) -> list[dict]:
    """For each item found in the text its best window."""
    words = normal_words(text)
    out = short_matches(words, index)
    if len(words) < SHINGLE or not len(index.shingles):
        return out
    h = shingle_hashes(words)
    at = np.minimum(np.searchsorted(index.shingles, h), len(index.shingles) - 1)
    met = np.flatnonzero(index.shingles[at] == h)
    if not len(met):
        return out
    starts: dict[int, set[int]] = {}
    for p in met.tolist():
        for item in index.holders[index.first[at[p]] : index.first[at[p] + 1]].tolist():
            size = min(int(index.sizes[item]), len(h))
            starts.setdefault(size, set()).update(range(max(0, p - size + 1), min(p, len(h) - size) + 1))
    best: dict[int, dict] = {}
    for size, some in starts.items():
        order = np.array(sorted(some))
        for cut in np.split(order, np.flatnonzero(np.diff(order) > 4 * size) + 1):
            for start, print_ in zip(cut.tolist(), window_prints(h, size, cut), strict=True):
                near = index.near(print_, radius)
                near = near[np.minimum(index.sizes[near], len(h)) == size]
                if not len(near):
                    continue
                window = Counter(h[start : start + size].tolist())
                for item in near.tolist():
                    s = weighted_similarity(window, index.counts[item])
                    if s >= similarity and (item not in best or s > best[item]["similarity"]):
                        best[item] = {"item_id": index.ids[item], "start": start, "n_words": size + SHINGLE - 1, "similarity": s}
    return out + [best[k] for k in sorted(best)]


HITS = "array<struct<item_id: bigint, start: int, n_words: int, similarity: double>>"


def with_hits(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", radius: int = RADIUS, similarity: float = SIMILARITY, per_pass: int = ITEMS_PER_PASS, name: str = "_hits"
) -> DataFrame:
    """docs, every column kept, plus the benchmark items (item_id, text) that each text holds, in a column of that name (which docs must not have)."""
    spark = docs.sparkSession
    n_items = benchmark.count()
    passes = max(1, -(-n_items // per_pass))
    keyed = benchmark.select(F.col("item_id").cast("long"), "text")
    out = docs.withColumn(name, F.array().cast(HITS))
    schema = StructType([*docs.schema.fields, out.schema[name]])
    for turn in range(passes):
        # a stated query set in blocks: together the passes hold every item
        items = keyed.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == turn) if passes > 1 else keyed
        shared = spark.sparkContext.broadcast(build_index([tuple(r) for r in items.collect()], radius))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                old, where = batch.columns[-1], batch.schema.get_field_index(text_col)
                found = [before + (matches(t.as_py(), index, radius, similarity) if index and t.is_valid else []) for before, t in zip(old.to_pylist(), batch.column(where), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, old.type)], batch.schema.names)

        out = map_arrow(out, run, schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, item_id, start, n_words, similarity: a row for each item that a document holds."""
    found = with_hits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, **options)
    return found.select("doc_id", F.explode("_hits").alias("hit")).select("doc_id", "hit.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no item."""
    (name,) = free_names(docs, "_hits")
    return with_hits(docs, benchmark, name=name, **options).filter(F.size(name) == 0).drop(name)
