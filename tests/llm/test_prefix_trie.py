"""The prefix trie against one that is built turn by turn."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from conftest import SMALL
from marlpit.llm import prefix_trie
from marlpit.llm.common import table
from marlpit.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_hand(rows):
    given = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            given.setdefault(conv, []).append((turn is not None, turn, digest, role, text))
    given = {c: [t[3:] for t in sorted(ts)] for c, ts in given.items()}
    members = {}
    for c in given:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        turns = tuple(given.get(base, [])[:h] + given[c][h:])
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append((c, len(turns) == d))
    kids, totals = {}, {}
    for name in members:
        if name:
            kids.setdefault(name[:-1], []).append(name)
    for name in sorted(members, key=len, reverse=True):
        own = (len(members[name]) - 1) * len(WORD.findall(name[-1][1])) if name else 0
        below = [totals[k] for k in kids.get(name, [])]
        totals[name] = (sum(x for x, _ in below) if below else 1, own + sum(x for _, x in below))
    smallest = {name: min(c for c, _ in found) for name, found in members.items()}
    return sorted(
        (smallest[n], len(n), smallest[n[:-1]] if n else None, len(f), len(kids.get(n, [])), *totals[n], hashlib.sha256(",".join(str(c) for c, e in sorted(f) if e).encode()).hexdigest())
        for n, f in members.items()
    )


def trie(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in prefix_trie.prefix_trie(*prefix_trie.rebuilt(df)).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("length", F.lit(2))


def test_query_is_brute_force(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, SMALL, "conversations").collect()]
    out = QUERIES["op13_prefix_trie"](spark, SMALL)
    assert out.dtypes == [(c, "string" if c == "ends_sha256" else "bigint") for c in COLUMNS]
    assert sorted(tuple(r) for r in out.collect()) == by_hand(rows)


def test_random_tries(spark, monkeypatch):
    """Few symbols and lengths up to 70, so that prefixes are shared at all depths; long hot prefixes and copies; pieces of three ids."""
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rng = random.Random(5)
    rows = []
    hot = [("user" if i % 2 == 0 else "assistant", f"w{i % 5} more") for i in range(70)]
    for c in [*range(-45, 60), 10**12 + 7]:
        keep = rng.choice([0, 1, 2, 3, 7, 8, 9, 31, 32, 33, 63, 64, 70])
        turns = hot[:keep] + [("user", rng.choice(["a", "a b", "c"])) for _ in range(rng.choice([0, 1, 2, 3, 5]))]
        turns = hot if c % 3 == 0 else turns
        rows += [(c, i, *t) for i, t in enumerate(turns or [("user", "only")])]
    rng.shuffle(rows)
    assert trie(frame(spark, rows)) == by_hand(rows)


def test_edges(spark):
    same = [(40, 0, "user", "same words"), (40, 0, "user", "same words"), (40, None, "system", "first"), (40, 0, None, None), (40, 1, "user", "")]
    rows = [(None, 0, "user", "no id"), (None, None, None, None), *same, *[(41 + i, t, r, x) for i in range(6) for _, t, r, x in same], (7, 3, "user", "x " * 9000), (8, None, None, None), (3, 1, "a", "b:c"), (23, 1, "a:b", "c")]
    assert trie(frame(spark, rows)) == by_hand(rows)
    assert trie(frame(spark, [])) == []
    # two ids of which nothing is left: the first turns would come from a conversation that isn't there
    lost = [c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:2]
    found = trie(frame(spark, [(c, 0, "user", "gone") for c in lost]))
    assert found == by_hand([(c, 0, "user", "gone") for c in lost]) and len(found) == 1 and found[0][5] == 1


def test_rounds_grow_with_the_logarithm_of_the_depth(spark):
    """A chain of 300 turns takes nine steps of halving, and every node is found at the depths of its own powers of two."""
    rows = [(20, i, "user", f"t{i}") for i in range(300)]
    turns, convs = prefix_trie.rebuilt(frame(spark, rows))
    hashed = turns.select("conv_id", "pos", F.xxhash64("pos", "sym").alias("h1"), F.xxhash64(F.lit(1), "pos", "sym").alias("h2"), "length")
    whole = hashed.groupBy().agg(F.bit_xor("h1").alias("y1"), F.bit_xor("h2").alias("y2"), F.count("*").alias("depth"), F.min("conv_id").alias("m"), F.lit(1).alias("n"))
    steps = prefix_trie.nodes_by_steps(hashed, whole, (300).bit_length() - 1)
    assert len(steps) == 9
    for k, step in enumerate(steps):
        assert sorted(r.depth for r in step.collect()) == list(range(1 << k, 301, 1 << k))
    assert trie(frame(spark, rows)) == by_hand(rows)
