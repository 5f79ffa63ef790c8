"""Quality rules: text statistics and an n-gram perplexity band per language.

The language model is a modified Kneser-Ney model over hashed character 4-grams, one per language. Spark counts the 4-grams of
every document, derives the lower orders (how many different characters stand before a gram), what the discounts need and the
probabilities, a table for each order. A gram is hashed by packing 16 bits of each character, which is exact for all
of the first Unicode plane. A document's score is its bits a word, the logarithm of its perplexity per word; the language's
middle score and spread, again over all documents, set the lower and upper bound.

No gram and no language is left out, however large the corpus. The most frequent 4-grams, IN_ARRAYS of them over all languages at most, are sent to the tasks in
sorted arrays of hashes; what these don't hold of a text goes with its row as gram and count, and meets the tables in a join. Such grams are rare by their choice, so no key
of that join is large, and where a corpus has no more grams than the arrays take there is nothing to join.

Defined results: null and empty texts have no words and fail the base rules; null languages form one language; repeated
rows count each; an empty table gives an empty result; of other columns none is read. The outputs' names begin with a prefix; columns of the
input with such a name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from marlpit.functions.ranks import placed
from marlpit.llm.common import free_names, map_arrow, materialize
from marlpit.llm.substring import BASES, rolling, word_hashes

ORDER = 4
#: Bits of a character in a gram; unseen characters are equally likely among so many.
BITS = 16
SYMBOLS = "#*$%&|<>"
SLICE = 1 << 20
#: Codes or table entries that a task gathers before it passes their counts on.
HELD = 1 << 21
#: 4-grams that tasks get in arrays, at most; steps of a doubling by which counts are told apart when these are chosen.
IN_ARRAYS, STEPS = 1 << 20, 8
#: Histogram bins for one bit of a score.
BINS = 256
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
#: Bounds are so many spreads from the middle; SHORT widens them for short texts, as bits over the root of the number of words.
BAND, SHORT = 5.0, 10.0


def _folding() -> np.ndarray:
    fold = np.arange(1 << BITS, dtype=np.uint64)
    fold[[9, 10, 11, 12, 13]] = 32
    fold[48:58] = 48
    return fold


FOLD = _folding()


def folded(text: str) -> np.ndarray:
    """A lower-cased text's characters as numbers of 16 bits: blanks are one, digits are one."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    if len(points) and points.max() >> BITS:
        points = (points ^ (points >> BITS)) & ((1 << BITS) - 1)
    return FOLD[points]


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashes of the 4-grams that end at each character, the text preceded by blanks; in slices."""
    text = text.lower()
    for at in range(0, len(text), SLICE):
        c = folded(text[max(0, at - ORDER + 1) : at + SLICE])
        if at == 0:
            c = np.concatenate([np.full(ORDER - 1, 32, dtype=np.uint64), c])
        n = len(c) - ORDER + 1
        yield reduce(lambda code, i: (code << np.uint64(BITS)) | c[i : n + i], range(1, ORDER), c[:n])


def model_name() -> Column:
    """A language's model; that of null is apart from all strings."""
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("model")


def gram_counts(docs: DataFrame) -> DataFrame:
    """model, gram, n over all texts. docs: lang, text. A task merges what it counts in sorted arrays and passes them on when they are large."""

    def rows(tables: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for model, (codes, n) in tables.items():
            yield pa.RecordBatch.from_arrays([pa.array([model] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], ["model", "gram", "n"])

    def merged(table: tuple[np.ndarray, np.ndarray] | None, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        new, n = np.unique(np.concatenate(codes), return_counts=True)
        if table is None:
            return new, n
        every = np.concatenate([table[0], new])
        order = np.argsort(every, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(every[order]) != 0])
        return every[order][starts], np.add.reduceat(np.concatenate([table[1], n])[order], starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for model, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for code in grams(text.as_py() or ""):
                    waiting.setdefault(model, []).append(code)
                    size += len(code)
                    if size > HELD:
                        tables |= {x: merged(tables.get(x), codes) for x, codes in waiting.items()}
                        waiting, size = {}, 0
                        if sum(len(t[0]) for t in tables.values()) > HELD:
                            yield from rows(tables)
                            tables = {}
        yield from rows(tables | {x: merged(tables.get(x), codes) for x, codes in waiting.items()})

    return map_arrow(docs.select(model_name(), "text"), run, "model string, gram long, n long").groupBy("model", "gram").agg(F.sum("n").alias("n"))


def discounts() -> Column:
    """Aggregate of n: what modified Kneser-Ney takes from counts of 1, 2, 3 and more, by how many grams were met once to four times."""
    n1, n2, n3, n4 = (F.greatest(F.count_if(F.col("n") == i), F.lit(1)) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return F.array(*[F.least(F.greatest(d, F.lit(0.05)), F.lit(most)) for d, most in zip(found, (0.95, 1.9, 2.9), strict=True)])


def context() -> Column:
    """All characters of a gram but the last."""
    return F.shiftrightunsigned("gram", BITS)


def shorter(order: int) -> Column:
    """All characters of a gram of that order but the first."""
    return F.col("gram").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))


@dataclass
class LanguageModels:
    """orders: tables from order 1 on, a row for each model and gram that was met: n, log (log2 of the probability of the last character after the others), weight (log2 of
    the lower order's weight after the gram's context). arrays: by model, sorted hashes of the most frequent grams of the highest order, and their logs."""

    orders: list[DataFrame]
    arrays: dict[str, tuple[np.ndarray, np.ndarray]]


def train(docs: DataFrame, in_arrays: int = IN_ARRAYS) -> LanguageModels:
    """Models of all texts, of which at most in_arrays grams reach the driver."""
    counts = [materialize(gram_counts(docs), "grams")]
    for order in range(ORDER, 1, -1):
        counts.append(materialize(counts[-1].groupBy("model", shorter(order).alias("gram")).agg(F.count("*").alias("n")), f"order-{order - 1}"))
    orders: list[DataFrame] = []
    for order, level in enumerate(reversed(counts), 1):
        after = Window.partitionBy("model", context())  # as many rows as there are characters, 2 ** BITS
        taken = F.get("_takes", F.least("n", F.lit(3)).cast("int") - 1)
        known = level.join(level.groupBy("model").agg(discounts().alias("_takes")), "model")
        known = known.withColumns({"_taken": taken, "_total": F.sum("n").over(after)}).withColumn("_freed", F.sum("_taken").over(after) / F.col("_total"))
        lower: Column = F.lit(2.0**-BITS)
        if orders:
            below = orders[-1].select("model", F.col("gram").alias("_shorter"), F.col("log").alias("_lower"))
            known, lower = known.withColumn("_shorter", shorter(order)).join(below, ["model", "_shorter"]), F.pow(F.lit(2.0), F.col("_lower"))
        p = (F.col("n") - F.col("_taken")) / F.col("_total") + F.col("_freed") * lower
        orders.append(materialize(known.select("model", "gram", "n", F.log2(p).alias("log"), F.log2("_freed").alias("weight")), f"model-{order}"))
    return LanguageModels(orders, sorted_arrays(orders[-1], in_arrays))


def sorted_arrays(level: DataFrame, most: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sorted hashes and logs by model, of the most frequent grams: at most so many, and all or none of those whose counts are in one step."""
    step = F.floor(F.log2("n") * STEPS)
    found = level.groupBy(step.alias("step")).count().collect()  # STEPS rows for each doubling of a count
    least, left = None, most
    for r in sorted(found, reverse=True):
        left -= r["count"]
        if left < 0:
            break
        least = r.step
    if least is None:
        return {}
    rows = level.filter(step >= least).select("model", "gram", "log").toArrow()
    names, of = np.unique(rows.column("model").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    codes, logs = rows.column("gram").to_numpy().view(np.uint64), rows.column("log").to_numpy()
    by = np.lexsort((codes, of))
    ends = np.searchsorted(of[by], np.arange(len(names) + 1))
    return {str(name): (codes[by[a:b]], logs[by[a:b]]) for name, a, b in zip(names, ends, ends[1:], strict=False)}


def find(codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(codes):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return at, codes[at] == wanted


def gram_logs(wanted: DataFrame, models: LanguageModels) -> DataFrame:
    """model, gram, log for distinct grams of the highest order; those that were never met back off, down to equally likely characters."""
    top = models.orders[-1].select("model", "gram", "log")
    unseen = wanted.select("model", "gram").join(top, ["model", "gram"], "left_anti")
    backed: list[Column] = []
    logs: list[Column] = []
    for order in range(ORDER, 0, -1):
        level, low = models.orders[order - 1], F.col("gram").bitwiseAND(F.lit(-1 if order == ORDER else (1 << BITS * order) - 1))
        weights = level.groupBy("model", context().alias(f"_c{order}")).agg(F.max("weight").alias(f"_w{order}"))
        unseen = unseen.withColumn(f"_c{order}", F.shiftrightunsigned(low, BITS)).join(weights, ["model", f"_c{order}"], "left")
        if order < ORDER:
            mine = level.select("model", F.col("gram").alias(f"_g{order}"), F.col("log").alias(f"_l{order}"))
            unseen = unseen.withColumn(f"_g{order}", low).join(mine, ["model", f"_g{order}"], "left")
        backed.append(F.coalesce(f"_w{order}", F.lit(0.0)))
        logs.append(F.col(f"_l{order}") if order < ORDER else F.lit(None).cast("double"))
    log: Column = F.lit(-float(BITS))
    for weight, own in zip(reversed(backed), reversed(logs), strict=True):
        log = F.coalesce(own, weight + log)
    return wanted.select("model", "gram").join(top, ["model", "gram"]).unionByName(unseen.select("model", "gram", log.alias("log")))


def text_statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    blanks = sum(map(raw.count, (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")))
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > REPEAT_WINDOW:
        windows = rolling(word_hashes(words)[0], REPEAT_WINDOW, BASES[0])
        order = np.argsort(windows)
        equal = windows[order[1:]] == windows[order[:-1]]
        if equal.any():
            met = np.zeros(n + 1, dtype=np.int64)
            places = order[np.r_[False, equal] | np.r_[equal, False]]
            met[places] += 1
            np.add.at(met, places + REPEAT_WINDOW, -1)
            repeated = int((np.cumsum(met[:-1]) > 0).sum())
    return n, len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated


FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def scored(docs: DataFrame, models: LanguageModels, prefix: str = "_", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs, every column kept but those to drop, plus FEATURES, model and bits: bits a word (log2 of the perplexity of words) under its language's model. It stands in a written table."""
    shared = docs.sparkSession.sparkContext.broadcast(models.arrays)
    model, bits = f"{prefix}model", f"{prefix}bits"
    counted = [f"{prefix}{c}" for c in FEATURES]
    docs = docs.drop(*counted, bits).withColumn(model, model_name())
    row, met, times = free_names(docs, "_row", "_grams", "_times")
    schema = StructType(list(docs.schema.fields))
    for c in [*counted, bits, row, met, times]:
        schema = schema.add(c, {bits: "double", met: ArrayType(LongType()), times: ArrayType(LongType())}.get(c, "long"))
    none = np.empty(0, dtype=np.uint64), np.empty(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = shared.value
        at = TaskContext.get().partitionId() << 40  # numbers of rows, apart in what is written once
        for batch in batches:
            found, totals, rare, counts = [], [], [], []
            names = batch.column(batch.schema.get_field_index(model)).to_pylist()
            for name, cell in zip(names, batch.column(batch.schema.get_field_index("text")), strict=True):
                text = cell.as_py() or ""
                found.append(text_statistics(text))
                codes, logs = arrays.get(name, none)
                total, others = 0.0, []
                for code in grams(text) if text else ():
                    place, there = find(codes, code)
                    if there.all():
                        total += float(logs[place].sum())
                    else:
                        total += float(logs[place[there]].sum())
                        others.append(code[~there])
                met_here, n = np.unique(np.concatenate(others), return_counts=True) if others else (none[0], none[0])
                totals.append(total)
                rare.append(met_here.view(np.int64))
                counts.append(n.astype(np.int64))
            extra = [pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * len(FEATURES))]
            ends = pa.array(np.cumsum([0, *map(len, rare)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, dtype=np.int64), *parts]))) for parts in (rare, counts)]
            numbers = pa.array(np.arange(at, at + len(found)))
            at += len(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra, pa.array(totals, pa.float64()), numbers, *lists], schema.fieldNames())

    first = materialize(map_arrow(docs, run, schema).drop(*drop), "logs")
    total = F.col(bits)
    if first.agg(F.max(F.size(met)).alias("n")).first()["n"]:
        rest = first.select(F.col(model).alias("model"), row, F.col(met).alias("gram"), F.col(times).alias("n"))
        rest = materialize(rest.select("model", row, F.explode(F.arrays_zip("gram", "n")).alias("g")).select("model", row, "g.gram", "g.n"), "rare")
        logs = gram_logs(rest.select("model", "gram").distinct(), models)
        sums = rest.join(logs, ["model", "gram"]).groupBy(row).agg(F.sum(F.col("n") * F.col("log")).alias(met))
        first, total = materialize(first.drop(met).join(sums, row, "left"), "scores"), total + F.coalesce(met, F.lit(0.0))
    return first.withColumn(bits, -total / F.greatest(F.col(f"{prefix}n_words"), F.lit(1))).drop(row, met, times)


def perplexity_bands(scores: DataFrame, band: float = BAND) -> DataFrame:
    """model, low, high: bounds in bits a word, a row for each model. scores: model, bits of all rows that pass the base rules.
    The middle and the quartiles are those of a histogram; a bound is band times the wider half of the middle spread from the middle."""
    bins = scores.groupBy("model", F.floor(F.col("bits") * BINS).alias("bin")).agg(F.count("*").alias("n"))
    at = [F.min(F.when(F.col("share") >= q, (F.col("bin") + 0.5) / BINS)).alias(name) for q, name in ((0.25, "q1"), (0.5, "middle"), (0.75, "q3"))]
    share = (F.col("n_before") + F.col("n")) / F.col("n_all")
    found = placed(bins, ["model"], [F.col("bin")], ["n"]).withColumn("share", share).groupBy("model").agg(*at)
    reach = F.greatest(F.col("middle") - F.col("q1"), F.col("q3") - F.col("middle"), F.lit(1 / BINS)) / 0.6745 * band
    return found.select("model", (F.col("middle") - reach).alias("low"), (F.col("middle") + reach).alias("high"))


def quality_verdicts(docs: DataFrame, band: float = BAND, short: float = SHORT, drop: tuple[str, ...] = (), prefix: str = "_") -> DataFrame:
    """docs (with lang and text), every column kept but those to drop, plus FEATURES, bits, base_failed and kept, their names after the prefix."""
    n_words, repeat, bits, model, failed, kept, low, high = (F.col(f"{prefix}{c}") for c in ("n_words", "n_repeat_words", "bits", "model", "base_failed", "kept", "low", "high"))
    name = {c: f"{prefix}{c}" for c in ("base_failed", "kept", "low", "high", "number", "model")}
    docs = docs.drop(*name.values())
    rules = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
    scores = scored(docs, train(docs), prefix, drop).withColumn(name["base_failed"], rules)
    bands = materialize(perplexity_bands(scores.filter(~failed).select(model.alias("model"), bits.alias("bits")), band), "bands")
    limits = bands.select(F.col("model").alias(name["number"]), F.col("low").alias(name["low"]), F.col("high").alias(name["high"]))
    out = scores.join(limits, model == F.col(name["number"]), "left")  # a row for each language, broadcast if Spark finds the table small
    slack = F.lit(short) / F.sqrt(F.greatest(n_words, F.lit(1)))
    inside = bits.between(low - slack, high + slack)
    return out.withColumn(name["kept"], ~failed & F.coalesce(inside, F.lit(False))).drop(name["number"], name["low"], name["high"], name["model"])
