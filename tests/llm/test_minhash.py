"""Tensored banding and its verified classes against all pairs of exact sets."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SMALL
from marlpit.llm import minhash
from marlpit.llm.common import table
from marlpit.llm.queries import QUERIES
from test_llm_operators import LOWER, near_pairs


def by_hand(rows, k=4):
    sets = []
    for _, t in rows:
        w = (t or "").translate(LOWER).split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return sorted(str((d, len(sets[i]), low.get(root(i)), d == low.get(root(i)))) for i, (d, _) in enumerate(rows))


def classes(df, **options):
    return sorted(str(tuple(r)) for r in minhash.minhash_groups(df, **options).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("key", F.lit("k")).withColumn("sid", F.lit(2))


def test_query_is_brute_force(spark):
    out = QUERIES["op12_minhash_groups"](spark, SMALL)
    assert out.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    assert sorted(str(tuple(r)) for r in out.collect()) == by_hand(rows)


def test_planted_similarities(spark):
    """Pairs around the threshold in all sizes, chains, copies, repeated and null ids, empty texts."""
    rows = [*near_pairs(), (None, "only this one has no id"), (None, None), (9_001, "É ß 漢字 🙂"), (9_002, "É ß 漢字 🙂")]
    assert classes(frame(spark, rows)) == by_hand(rows)
    assert classes(frame(spark, [])) == []
    assert classes(frame(spark, [(1, None), (2, ""), (2, " \n")])) == by_hand([(1, None), (2, ""), (2, " \n")])


def test_large_buckets_and_families_meet_in_tiles(spark):
    """A group of near copies and one of texts that share a passage but aren't alike, in tiles of a few sets."""
    rng, rows = np.random.default_rng(4), []
    base = [f"b{i}" for i in range(120)]
    for i in range(90):
        words = [*base]
        for at in rng.integers(0, 120, int(rng.integers(0, 4))):
            words[at] = f"x{i}"
        rows.append((i, " ".join(words[: int(rng.integers(90, 120))])))
    for i in range(100, 160):
        rows.append((i, " ".join([*(f"y{i}v{j}" for j in range(20)), *base[:40], *(f"z{i}v{j}" for j in range(20))])))
    assert classes(frame(spark, rows), tile=8, tile_shingles=500) == by_hand(rows)


def test_half_keys_collide_as_often_as_they_should():
    """Of pairs of similarity s a half key is equal in s^ROWS of all places, and halves of different places never are."""
    rng = np.random.default_rng(8)
    for similarity in (0.8, 0.5):
        equal, met = 0, 0
        for _ in range(400):
            h = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
            own = round(50 * (1 - similarity))
            one, two = minhash.half_keys(minhash.minima(h[: 100 - own])), minhash.half_keys(minhash.minima(h[own:]))
            real = (100 - 2 * own) / 100
            same = one == two
            equal += same.mean() / 400
            met += (same[: minhash.GROUPS].any() and same[minhash.GROUPS :].any()) / 400
            assert len(np.unique(one)) == len(one) == 2 * minhash.GROUPS
        assert abs(equal - real**minhash.ROWS) < 0.02
        assert abs(met - (1 - (1 - real**minhash.ROWS) ** minhash.GROUPS) ** 2) < 0.05
