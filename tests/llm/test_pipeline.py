"""The whole corpus pipeline against a brute-force chain of its five stages, on documents with planted cases."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlpit.llm import decontam, quality
from test_llm_operators import brute_bits, brute_lines, brute_near_groups, brute_statistics

ITEM = "the question of the silver bridge over the river asks which garden letter the summer market forgot under a yellow window today"


def planted():
    """doc_id, text, lang, source, n_chars, and columns named like results."""
    rng = np.random.default_rng(11)
    bank = [a + b for a in ("ta", "re", "lin", "mo", "sa", "ver", "con", "pi") for b in ("ning", "der", "tion", "ly", "ment", "al", "ous", "er", "est", "ing")]
    fresh = lambda n: [str(w) for w in rng.choice(bank, n)]
    rows, size = [], 120
    for at, similarity in enumerate((0.70, 0.78, 0.80, 0.83, 0.90)):
        words, m = fresh(size + 4), int(size * (1 - similarity) / (1 + similarity) + 1e-9)
        rows += [(10 * at, " ".join(words)), (10 * at + 1, " ".join(words[: len(words) - m] + fresh(m)))]
    line = " ".join(fresh(12))
    rows += [(100 + i, " ".join(fresh(60)) + "\n" + line + "\n" + " ".join(fresh(50))) for i in range(4)]
    rows += [(200, " ".join(fresh(40)) + " " + ITEM.upper() + " " + " ".join(fresh(40))), (201, " ".join(fresh(30)) + "\n" + ITEM + ".\n" + " ".join(fresh(30)))]
    same = " ".join(fresh(70))
    rows += [(300, same), (300, same), (300, " ".join(fresh(80))), (None, " ".join(fresh(90))), (None, " ".join(fresh(50))), (301, same)]
    rows += [(400, None), (401, ""), (402, "too short"), (403, " ".join(["again and again it goes"] * 20)), (404, " ".join(f"{w}%%%&&&" for w in fresh(40))), (405, "zqx jkv " * 3 + " ".join("".join(rng.choice(list("qxzjkvw"), 7)) for _ in range(40)))]
    rows += [(500 + i, " ".join(fresh(100))) for i in range(12)]
    return [(d, t, "en" if i % 3 else "xx", (None, "a", "b")[i % 3], None if t is None else len(t), f"s{i}", i) for i, (d, t) in enumerate(rows)]


def brute_quality(rows):
    bits = brute_bits([(r[2], r[1]) for r in rows])
    stats = [brute_statistics(r[1]) for r in rows]
    good = [not (n < 10 or 100 * rep > 20 * n) for n, _, _, _, rep in stats]
    kept = []
    for i, r in enumerate(rows):
        some = sorted(math.floor(b * quality.BINS) for x, b, g in zip(rows, bits, good, strict=True) if g and x[2] == r[2])
        q1, mid, q3 = ((some[math.ceil(q * len(some)) - 1] + 0.5) / quality.BINS for q in (0.25, 0.5, 0.75))
        reach = max(mid - q1, q3 - mid, 1 / quality.BINS) / 0.6745 * quality.BAND + quality.SHORT / math.sqrt(max(1, stats[i][0]))
        if good[i] and abs(bits[i] - mid) <= reach:
            kept.append(r)
    return kept


def held(text):
    """Whether a window of the item's words is 0.8 similar to it or more."""
    sh = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    words, item = decontam.normal_words(text), decontam.normal_words(ITEM)
    size = min(len(words), len(item))
    return any(decontam.weighted_similarity(sh(words[i : i + size]), sh(item)) >= 0.8 for i in range(len(words) - size + 1))


def test_pipeline_is_brute_force(spark, tmp_path):
    rows = planted()
    schema = "doc_id long, text string, lang string, source string, n_chars long, `_kept` string, size int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = brute_quality(rows)
    assert {400, 401, 402, 403, 404}.isdisjoint(r[0] for r in kept) and len(kept) >= 30
    lines = collections.defaultdict(list)
    for d, _, _, text in brute_lines([(r[0], r[1]) for r in kept]):
        lines[d].append(text)
    now = []
    for r in kept:  # each row's own text without its lost lines
        text = next(t for t in lines[str(r[0])] if set(t.split("\n")) - {""} <= set(r[1].split("\n")))
        now.append((r[0], text, r[2], r[3], len(text), *r[5:]))
    groups = {}
    for d, c in brute_near_groups([(r[0], r[1]) for r in now]):
        groups.setdefault(d, set()).add(c)
    gone = {d for d, cs in groups.items() if d != "None" and cs - {int(d)}}
    assert {"1", "11"}.isdisjoint(gone) and {"21", "31", "41"} <= gone
    now = [r for r in now if str(r[0]) not in gone and not held(r[1])]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "_kept", "size", "_size", "source_size", "target", "taken"]
    out = got.collect()
    assert sorted(str(tuple(r)[:7]) for r in out) == sorted(map(str, now))
    assert {200, 201}.isdisjoint(r.doc_id for r in out) and {300, None} <= {r.doc_id for r in out}
    sizes = collections.Counter()
    for r in out:
        assert r["_size"] == len(r.text.split()) and 0 <= r.taken <= 2 * r["_size"]
        sizes[r.source] += r["_size"]
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), (5, 2, 1), strict=True))
    target, left, open_ = {}, 1.5 * sum(sizes.values()), dict(weights)
    while open_:
        over = {s for s, w in open_.items() if left * w / sum(open_.values()) > 2 * sizes[s]}
        if not over:
            target |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
            break
        for s in over:
            target[s] = 2 * sizes[s]
            del open_[s]
        left = 1.5 * sum(sizes.values()) - sum(target.values())
    for s, n in sizes.items():
        mine = [r for r in out if r.source == s]
        assert {r.source_size for r in mine} == {n} and mine[0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in mine) - target[s]) <= 1
    again = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", F.md5("text").alias("h"), "taken").collect()
    assert sorted(map(str, again)) == sorted(map(str, got.select("doc_id", F.md5("text").alias("h"), "taken").collect()))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
