"""The trie of conversations' prefixes, with totals of every subtree, by a van Emde Boas recursion.

Sequences are cut at half depth: a cut prefix gets a name, the exclusive or of 128-bit hashes of its (place, turn) pairs, equal cut prefixes of a tree become one, and what lies
below stands in the tree of that name. Upper halves and lower forests of all trees are cut again side by side, so a depth of d takes about log2 d rounds, whose rows are
nodes at depths that are multiples of a power of two: each with the node so many turns above it. Totals are grafted upward along the same pairs: first within windows of growing
size below each node, then from the coarsest depths down to all others. No round gathers a group: they are joins of unique keys and sums.

Turns are placed in range partitions, so a conversation of any length is not gathered either. The decimal ids of a node's ending members, however many, are joined up in pieces where
they lie and then run through SHA-256 in order, which no more than one task can do for one hash.

Defined results: turns without a conversation id are left out; a null turn comes first; equal turns of a conversation follow each other in order of a digest of role and text; null role or text
is empty; repeated rows are further turns; a conversation that is left without turns is a member of the root; names are equal where 128 bits are; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.functions.lineage import range_parts
from marlpit.llm.common import heavy_safe_join, map_arrow, materialize, word_count

#: Ids in a piece of the list of a node's ending members.
PIECE = 4096


def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), sym (digest of role and text), words of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sym = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), sym.alias("sym"), word_count(text).alias("words")).filter("conv_id IS NOT NULL")
    order = [F.col("turn").asc_nulls_first(), F.col("sym")]
    ranged = range_parts(rows, [F.col("conv_id"), *order], "part")
    sizes = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # only the first conversation of a partition has begun in an earlier one, so there are no more of these rows than partitions
    shift = sizes.select("conv_id", "part", F.sum("size").over(earlier).alias("shift")).filter("shift > 0")
    own = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order)) - 1
    placed = ranged.withColumn("own", own).join(F.broadcast(shift), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("own") + F.coalesce("shift", F.lit(0))).alias("pos"), "sym", "words")


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns: conv_id, pos, sym, words, length; conversations: conv_id, length) with each conversation's first h = crc32(id) % most turns taken from conversation id - id % every."""
    turns = materialize(placed_turns(conversations), "placed")
    info = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    info = info.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).withColumn("from", F.col("conv_id") - F.col("conv_id") % every)
    info = info.join(info.select(F.col("conv_id").alias("from"), F.col("n").alias("there")), "from", "left")
    head = F.least("h", F.coalesce("there", F.lit(0)))
    info = materialize(info.select("conv_id", "n", "h", "from", head.alias("head"), (head + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    total = info.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    first = turns.filter(F.col("pos") < most - 1).withColumnRenamed("conv_id", "from")
    heads = info.filter("head > 0").join(first, "from").filter("pos < head")  # every conversations share a head
    own = heavy_safe_join(turns, info.select("conv_id", "n", "h", "head", "length"), "conv_id", total, "n").filter("pos >= h")
    both = heads.select("conv_id", "pos", "sym", "words", "length").unionByName(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "sym", "words", "length"))
    return both, info.select("conv_id", "length")


def ending_members(whole: DataFrame) -> DataFrame:
    """y1, y2, depth, m (smallest conv_id), n, ends_sha256 (of their decimal ids in order, joined by commas) for each distinct sequence of whole (conv_id, y1, y2, depth)."""
    key = ["y1", "y2", "depth"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            last, ids = None, []
            for now in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now[:3] != last or len(ids) == PIECE:
                    if ids:
                        rows.append((*last, ids[0], len(ids), ",".join(map(str, ids))))
                    last, ids = now[:3], []
                ids.append(now[3])
            if ids:
                rows.append((*last, ids[0], len(ids), ",".join(map(str, ids))))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=kinds)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, n, sha = None, None, 0, None
        for batch in batches:
            rows = []
            for y1, y2, depth, m, size, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (y1, y2, depth) == last:
                    sha.update(b"," + ids.encode())
                    n += size
                else:
                    if last is not None:
                        rows.append((*last, first, n, sha.hexdigest()))
                    last, first, n, sha = (y1, y2, depth), m, size, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(out, r, strict=True)) for r in rows], schema=made)
        if last is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(out, (*last, first, n, sha.hexdigest()), strict=True))], schema=made)

    names, out = [*key, "m", "n", "ids"], [*key, "m", "n", "ends_sha256"]
    kinds, made = (pa.schema([(c, pa.int64()) for c in x[:-1]] + [(x[-1], pa.string())]) for x in (names, out))
    # a hot sequence's ids lie in many range partitions; each makes few rows of them
    ranged = whole.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    few = map_arrow(ranged, pieces, "y1 long, y2 long, depth long, m long, n long, ids string")
    return map_arrow(few.repartition(*key).sortWithinPartitions(*key, "m"), digests, "y1 long, y2 long, depth long, m long, n long, ends_sha256 string")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def xor(a: str, b: str) -> Column:
    return F.col(a).bitwiseXOR(F.col(b))


def nodes_by_steps(turns: DataFrame, whole: DataFrame, top: int) -> list[DataFrame]:
    """For k from 0 to top: the nodes (y1, y2 at depth, with m the smallest of their n members) whose depth is a multiple of 2^k, with (t1, t2), the node 2^k turns above.

    turns: conv_id, pos, h1, h2, length. whole: distinct sequences (y1, y2, depth) with their m and n; 2^top is the largest power of two that a depth reaches.
    """
    # a piece lies in the tree (t1, t2) of depth o, is the m'th sequence's, has n members and ends at (e1, e2)
    start = whole.filter("depth > 0").select(
        F.lit(0).cast("long").alias("t1"), F.lit(0).cast("long").alias("t2"), F.lit(0).cast("long").alias("o"), "m", "n", F.col("depth").alias("length"), F.col("y1").alias("e1"), F.col("y2").alias("e2")
    )
    waiting, steps = [start], []
    for k in range(top, -1, -1):
        half = 1 << k
        pieces = [p.filter((F.col("length") >= half) & (F.col("length") < 2 * half)) for p in waiting]
        if steps:
            above = F.col("depth") - 2 * half
            pieces.append(steps[-1].select("t1", "t2", above.alias("o"), "m", "n", F.lit(2 * half).cast("long").alias("length"), F.col("y1").alias("e1"), F.col("y2").alias("e2")))
        blocks = turns.filter(F.col("length") >= half).groupBy(F.col("conv_id").alias("m"), F.expr(f"pos DIV {half}").alias("j")).agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
        cut = union(pieces).withColumn("j", F.expr(f"o DIV {half}")).join(blocks, ["m", "j"])
        cut = materialize(cut.withColumn("y1", xor("t1", "h1")).withColumn("y2", xor("t2", "h2")).drop("j", "h1", "h2"), "cut")
        upper = cut.groupBy("t1", "t2", "o", "y1", "y2").agg(F.min("m").alias("m"), F.sum("n").alias("n")).withColumn("depth", F.col("o") + half).drop("o")
        lower = cut.filter(F.col("length") == 2 * half).select(F.col("y1").alias("t1"), F.col("y2").alias("t2"), F.col("e1").alias("y1"), F.col("e2").alias("y2"), "m", "n", (F.col("o") + 2 * half).alias("depth"))
        steps.append(materialize(upper.unionByName(lower), "named"))
        rest = cut.filter((F.col("length") > half) & (F.col("length") < 2 * half))
        waiting.append(rest.select(F.col("y1").alias("t1"), F.col("y2").alias("t2"), (F.col("o") + half).alias("o"), "m", "n", (F.col("length") - half).alias("length"), "e1", "e2"))
    return steps[::-1]


def grafted(nodes: DataFrame, steps: list[DataFrame], sums: list[str]) -> DataFrame:
    """y1, y2, depth and, for each node with children, the sums over all nodes below it."""
    key = ["y1", "y2", "depth"]

    def raised(rows: DataFrame, by: int) -> DataFrame:
        return rows.select(F.col("t1").alias("y1"), F.col("t2").alias("y2"), (F.col("depth") - by).alias("depth"), *sums)

    def added(rows: DataFrame) -> DataFrame:
        return materialize(rows.groupBy(*key).agg(*[F.sum(c).alias(c) for c in sums]), "sums")

    windows = [added(raised(nodes.select("t1", "t2", "depth", *sums), 1))]
    for k, step in enumerate(steps):
        size, now = 1 << k, windows[-1]
        odd = step.filter(F.col("depth") % (2 * size) == size).select("t1", "t2", *key).join(now, key)
        windows.append(added(now.filter(F.col("depth") % (2 * size) == 0).unionByName(raised(odd, size))))
    found = [windows[-1]]  # of the root alone
    for k in range(len(steps) - 1, -1, -1):
        size = 1 << k
        below = steps[k].filter((F.col("depth") % (2 * size) == 0)).select("t1", "t2", *key).join(union(found), key)
        odd = windows[k].filter(F.col("depth") % (2 * size) == size)
        found.append(added(odd.unionByName(raised(below, size).filter("depth > 0"))))
    return union(found)


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, pos, sym, words, length; conversations: every conv_id with its length.
    """
    key = ["y1", "y2", "depth"]
    hashed = turns.select("conv_id", F.col("pos").cast("long").alias("pos"), F.xxhash64("pos", "sym").alias("h1"), F.xxhash64(F.lit("second"), "pos", "sym").alias("h2"), "words", "length")
    hashed = materialize(hashed, "turns")
    whole = hashed.groupBy("conv_id").agg(F.bit_xor("h1").alias("y1"), F.bit_xor("h2").alias("y2"), F.max("length").alias("depth"))
    none = conversations.filter("length = 0").select("conv_id", F.lit(0).cast("long").alias("y1"), F.lit(0).cast("long").alias("y2"), F.lit(0).cast("long").alias("depth"))
    whole = materialize(ending_members(whole.unionByName(none)), "sequences")
    root, members, deepest = whole.agg(F.min("m"), F.sum("n"), F.max("depth")).first()
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    spark = turns.sparkSession
    if root is None:
        return spark.createDataFrame([], schema)
    top = spark.createDataFrame([(None, None, 0, 0, 0, root, members)], "t1 long, t2 long, depth long, y1 long, y2 long, m long, n long")
    steps = nodes_by_steps(hashed, whole, deepest.bit_length() - 1) if deepest else []
    nodes = steps[0] if steps else top.limit(0)
    kids = nodes.groupBy(F.col("t1").alias("y1"), F.col("t2").alias("y2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    words = hashed.select(F.col("conv_id").alias("m"), (F.col("pos") + 1).alias("depth"), "words")
    nodes = nodes.join(words, ["m", "depth"]).unionByName(top.withColumn("words", F.lit(0).cast("long"))).join(kids, key, "left")
    nodes = nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).withColumn("n_leaves", (F.col("n_children") == 0).cast("long"))
    nodes = materialize(nodes.withColumn("saved_tokens", (F.col("n") - 1) * F.col("words")).drop("words"), "nodes")
    below = grafted(nodes.filter("depth > 0"), steps, ["n_leaves", "saved_tokens"]) if steps else nodes.limit(0)
    below = below.select(*key, F.col("n_leaves").alias("leaves_below"), F.col("saved_tokens").alias("saved_below"))
    full = nodes.join(below, key, "left").join(whole.select(*key, "ends_sha256"), key, "left")
    parents = nodes.filter("n_children > 0").select(F.col("y1").alias("t1"), F.col("y2").alias("t2"), (F.col("depth") + 1).alias("depth"), F.col("m").alias("parent_conv_id"), F.col("n_children").alias("_rows"))
    full = materialize(full, "grafted")
    joined = heavy_safe_join(full.filter("depth > 0"), parents, ["t1", "t2", "depth"], full.count(), "_rows")
    joined = joined.unionByName(full.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return joined.select(
        F.col("m").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", (F.col("n_leaves") + F.coalesce("leaves_below", F.lit(0))).alias("n_leaves"),
        (F.col("saved_tokens") + F.coalesce("saved_below", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


#: crc32 goes through the digits of an id: each is mixed in, then eight steps of one bit follow.
TRIE_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, COALESCE(role, '') AS r, COALESCE(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda crc, s: CASE WHEN s >= 0 THEN xor(crc, s) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384::BIGINT) ELSE crc // 2 END), 4294967295::BIGINT) % 4 AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
heads AS (SELECT c.conv_id, pos, r, x FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND pos < h),
headed AS (SELECT conv_id, count(*) AS n FROM heads GROUP BY conv_id),
b AS (SELECT * FROM heads UNION ALL
      SELECT t.conv_id, t.pos - c.h + COALESCE(n, 0), r, x FROM t JOIN c ON t.conv_id = c.conv_id LEFT JOIN headed ON headed.conv_id = t.conv_id WHERE t.pos >= c.h),
p0 AS (SELECT conv_id, pos + 1 AS depth, COALESCE(len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')), 0) AS words, CAST(to_json(list([r, x]) OVER (PARTITION BY conv_id ORDER BY pos)) AS VARCHAR) AS name FROM b
       UNION ALL SELECT conv_id, 0, 0, '[]' FROM c),
p AS (SELECT *, lag(name) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, lead(name) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS is_end FROM p0),
n0 AS (SELECT name, any_value(depth) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
              sha256(COALESCE(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256 FROM p GROUP BY name),
n1 AS (SELECT n0.*, COALESCE(k, 0) AS n_children FROM n0 LEFT JOIN (SELECT parent AS name, count(*) AS k FROM n0 WHERE parent IS NOT NULL GROUP BY parent) USING (name)),
s AS (SELECT a AS name, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
      FROM (SELECT DISTINCT u.name AS a, v.name AS b FROM p u JOIN p v ON u.conv_id = v.conv_id AND v.depth >= u.depth) JOIN n1 ON n1.name = b GROUP BY a)
SELECT n1.conv_id, CAST(n1.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(n1.n_convs AS BIGINT) AS n_convs, CAST(n1.n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n1.ends_sha256
FROM n1 JOIN s USING (name) LEFT JOIN n1 up ON n1.parent = up.name
"""
