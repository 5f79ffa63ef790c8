"""Toxicity by a subsequence string kernel SVM with Nyström landmarks.

The kernel between two words is the gap-weighted count of their common subsequences of three letters: a subsequence that
spans s letters weighs DECAY ** s, spans over MAX_SPAN weigh nothing, and the kernel is normalised to 1 for equal words.
Inserted marks are passed over, look-alike digits read as letters and runs of single letters joined, so "id-iot",
"id1ot", "idxiot" and "i d i o t" stay close to the plain word. Landmarks are words of the training texts: those that
set toxic texts apart and the most common others. A text is described, for each landmark, by its greatest kernel value (the worst
word of any sentence decides) and by the damped sum of squared values (a slur used again and again differs from a word used once). The Nyström map
K(Z,Z)^(-1/2) turns these into features of a linear SVM; its margins are calibrated to probabilities.

Labels come from at most ``max_train`` labelled texts of each class, chosen by the hash of their id. Language, source and
id are no inputs. Defined results: null and empty texts get the score of a text without words; rows with a null id are scored and count as not held out; repeated
rows each get a score; with no labelled rows of both classes every score is 0; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.llm.common import map_arrow

DECAY, MAX_SPAN, MAX_LETTERS = 0.7, 6, 24
#: Letters a to z are 1 to 26; other letters fall into five more classes.
ALPHABET = 32
#: Kernel values under this count as zero: an insult of five letters keeps 0.3 or more with two letters inserted, or glued into a token of MAX_LETTERS letters.
FLOOR = 0.25
TOXIC_LANDMARKS, COMMON_LANDMARKS = 96, 16
MAX_TRAIN = 2500
CACHE_WORDS = 150_000
#: Look-alike digits.
LOOKS = str.maketrans("013457", "oieast")
NOT_LETTERS = re.compile(r"[\W\d_]+")
SINGLE = re.compile(r"(?<!\S)\S(?:[^\S\n]\S){2,}(?!\S)")


def pieces(word: str) -> list[str]:
    """The word, or of a longer one overlapping pieces of MAX_LETTERS letters that cover it."""
    if len(word) <= MAX_LETTERS:
        return [word]
    return [word[at : at + MAX_LETTERS] for at in (*range(0, len(word) - MAX_LETTERS, MAX_LETTERS // 2), len(word) - MAX_LETTERS)]


def text_words(text: str) -> Counter:
    """The words of a text, undone of what may hide them, and how often each occurs; three letters or more. What punctuation joins is read both whole and in its parts."""
    text = text.lower()
    found = Counter(text.split())
    found.update(re.sub(r"\s", "", m) for m in SINGLE.findall(text))
    out: Counter = Counter()
    for w, n in found.items():
        parts = []
        if not w.isalpha():
            parts = NOT_LETTERS.split(w.strip(".,;:!?#*$%&|<>\"'()[]").translate(LOOKS))
            w = "".join(parts)
        for x in [w, *parts] if len(parts) > 1 else [w]:
            if len(x) > 2:
                for piece in pieces(x):
                    out[piece] += n
    return out


def letters(words: list[str]) -> np.ndarray:
    """Letter classes of words of one length."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), -1).astype(np.int32)
    return np.where((points >= 97) & (points <= 122), points - 96, 27 + points % 5)


def triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the subsequences of three in n letters, and their weights."""
    found = [(i, j, k) for i in range(n) for k in range(i + 2, min(n, i + MAX_SPAN)) for j in range(i + 1, k)]
    i, j, k = np.array(found).T
    return i, j, k, (DECAY ** (k - i + 1)).astype(np.float32)


TRIPLES = {n: triples(n) for n in range(3, MAX_LETTERS + 1)}


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    c = letters(words)
    i, j, k, weight = TRIPLES[c.shape[1]]
    return (c[:, i] * ALPHABET + c[:, j]) * ALPHABET + c[:, k], weight


def norms(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Roots of the words' kernels with themselves."""
    out = np.empty(len(codes))
    for n, row in enumerate(codes):
        out[n] = np.sqrt((np.bincount(np.unique(row, return_inverse=True)[1], weights=weight) ** 2).sum())
    return out


def landmark_table(landmarks: list[str]) -> np.ndarray:
    """[subsequence, landmark]: weights, normalised for each landmark."""
    out = np.zeros((ALPHABET**3, len(landmarks)), dtype=np.float32)
    for n, z in enumerate(landmarks):
        codes, weight = codes_of([z])
        np.add.at(out[:, n], codes[0], weight)
        out[:, n] /= np.sqrt((out[:, n] ** 2).sum())
    return out


def kernel(words: list[str], table: np.ndarray) -> np.ndarray:
    """Kernel values of words of one length with the landmarks, exact where they reach FLOOR; lower ones are zero."""
    codes, weight = codes_of(words)
    out = np.zeros((len(words), table.shape[1]), dtype=np.float32)
    for t in range(codes.shape[1]):
        out += weight[t] * table[codes[:, t]]
    least = np.sqrt((weight**2).sum())  # a word's norm is no less
    some = np.flatnonzero(out.max(axis=1, initial=0) / least >= FLOOR)
    exact = np.zeros_like(out)
    exact[some] = out[some] / norms(codes[some], weight)[:, None]
    return np.where(exact >= FLOOR, exact, 0)


class Describer:
    """Features of texts; remembers the kernel values of the words that it has met."""

    def __init__(self, table: np.ndarray):
        self.table, self.known = table, {}

    def __call__(self, texts: list[Counter]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        new: dict[int, list[str]] = {}
        for w in set().union(*texts) - self.known.keys():
            new.setdefault(len(w), []).append(w)
        for words in new.values():
            for at in range(0, len(words), 4096):
                part = words[at : at + 4096]
                values = kernel(part, self.table)
                met = values.any(axis=1)
                self.known.update(zip(part, (v if m else None for v, m in zip(values, met.tolist(), strict=True)), strict=True))
        m = self.table.shape[1]
        out = np.zeros((len(texts), 2 * m), dtype=np.float32)
        for n, words in enumerate(texts):
            found = [(v, c) for w, c in words.items() if (v := self.known[w]) is not None]
            if found:
                values, times = np.array([v for v, _ in found]), np.array([c for _, c in found], dtype=np.float32)
                out[n, :m] = values.max(axis=0)
                out[n, m:] = np.log1p(times @ values**2)
        return out


@dataclass
class ToxicityModel:
    landmarks: list[str]
    table: np.ndarray
    weights: np.ndarray  # on the landmark features: the Nyström map and the SVM's weights in one
    slope: float
    offset: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        margin = features @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def disguised(words: Counter, insults: set[str], turn: int, way: int) -> Counter:
    """The words of a text with way 0 or 1 one or two letters inserted in each insult, with way 2 each insult glued to another word of the text."""
    others = sorted(w for w in words if w not in insults)
    out: Counter = Counter()
    for w, n in words.items():
        if w in insults and way == 2:
            other = others[(7 * turn + len(w)) % len(others)] if others else "very"
            w = other + w if turn % 2 else w + other
        elif w in insults:
            for more in range(way + 1):
                at = 1 + (turn + len(w) + 2 * more) % (len(w) - 1)
                w = w[:at] + chr(97 + (7 * turn + at) % 26) + w[at:]
        for piece in pieces(w):
            out[piece] += n
    return out


def choose_landmarks(texts: list[Counter], labels: np.ndarray) -> tuple[list[str], list[str]]:
    """(words that set toxic texts apart, common other words)."""
    toxic, other = Counter(), Counter()
    for words, label in zip(texts, labels, strict=True):
        (toxic if label else other).update(words.keys())
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    ranked = []
    for w, n in toxic.items():
        p, q = n / n1, other[w] / n0
        mean = (n + other[w] + 1) / (n1 + n0 + 2)
        z = (p - q) / np.sqrt(mean * (1 - mean) * (1 / n1 + 1 / n0))
        if n > 1 and z > 2.5 and p > 4 * q:
            ranked.append((-z, w))
    toxic_words = [w for _, w in sorted(ranked)[:TOXIC_LANDMARKS]]
    common = [w for w, _ in sorted(other.items(), key=lambda x: (-x[1], x[0])) if w not in toxic_words and len(w) > 3]
    return toxic_words, common[:COMMON_LANDMARKS]


def fit_svm(x: np.ndarray, y: np.ndarray, sample_weight: np.ndarray, c: float = 1.0, turns: int = 600) -> np.ndarray:
    """Weights and bias of an L2 SVM with squared hinge loss, by accelerated gradient descent."""
    z = np.c_[x, np.ones(len(x))]
    s = sample_weight / sample_weight.sum() * len(x)
    ridge = np.r_[np.full(x.shape[1], 1.0), 1e-3]
    step = 1 / (2 * c * np.linalg.norm(z * np.sqrt(s)[:, None], 2) ** 2 + 1.0)
    w = v = np.zeros(z.shape[1])
    for t in range(turns):
        slack = np.maximum(0, 1 - y * (z @ v))
        nxt = v - step * (ridge * v - 2 * c * z.T @ (s * slack * y))
        w, v = nxt, nxt + t / (t + 3) * (nxt - w)
    return w


def fit(texts: list[Counter], labels: np.ndarray, share: float) -> ToxicityModel | None:
    """A model from texts (as word counts) and 0/1 labels; share: of label 1 among all labelled texts, to which the classes are weighted back."""
    insults, common = choose_landmarks(texts, labels)
    if not insults or len(set(labels.tolist())) < 2:
        return None
    landmarks = insults + common
    table = landmark_table(landmarks)
    # toxic texts are shown three times more with letters inserted in their insults or the insults glued to other words, at half the weight in all
    hidden = [disguised(t, set(insults), i, way) for way in range(3) for i, t in enumerate(texts) if labels[i]]
    x = Describer(table)(texts + hidden).astype(np.float64)
    plain, labels = len(labels), np.r_[labels, np.ones(len(hidden), dtype=labels.dtype)]
    gram = np.concatenate([kernel([z], table) for z in landmarks]).astype(np.float64)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > 1e-3
    nystrom = vectors[:, keep] / np.sqrt(values[keep]) @ vectors[:, keep].T
    weight = np.where(labels == 1, share / max(1, labels[:plain].sum()), (1 - share) / max(1, (1 - labels).sum()))
    weight[plain:] /= 6
    m = len(landmarks)
    w = fit_svm(np.c_[x[:, :m] @ nystrom, x[:, m:] @ nystrom], 2.0 * labels - 1, weight)
    folded = np.r_[nystrom @ w[:m], nystrom @ w[m:-1], w[-1]]
    margin = x @ folded[:-1] + folded[-1]
    slope, offset = 2.0, 0.0
    target = np.where(labels == 1, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    s = weight / weight.sum()
    for _ in range(3000):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
        g = s * (target - p)
        slope, offset = slope + 4 * float((g * margin).sum()), offset + 4 * float(g.sum())
    return ToxicityModel(landmarks, table, folded, slope, offset)


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """label, words, times of rows with label, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(text_words(t.as_py() or "").items()) for t in batch.column(1)]
            words, times = [[w for w, _ in f] for f in found], [[n for _, n in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))], ["label", "words", "times"])

    return map_arrow(texts.select("label", "text"), run, "label int, words array<string>, times array<int>")


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> ToxicityModel | None:
    """docs: doc_id, text; labels: doc_id, toxic. Learns from rows that aren't held out. An id with both labels counts as toxic; of rows that share an id the one with the smallest text is
    taken, so that what reaches the driver is the words of max_train texts of each class at most."""
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("label"))
    usable = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    share = usable.agg(F.avg("label")).first()[0]
    if share is None:
        return None
    by_hash = usable.withColumn("h", F.xxhash64("doc_id"))
    chosen = [by_hash.filter(F.col("label") == v).orderBy("h", "doc_id").limit(max_train) for v in (0, 1)]
    some = chosen[0].unionByName(chosen[1]).drop("h")
    texts = docs.select("doc_id", "text").join(some, "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    rows = word_counts(texts).collect()
    rows.sort(key=lambda r: (r.label, r.words, r.times))
    return fit([Counter(dict(zip(r.words, r.times, strict=True))) for r in rows], np.array([r.label for r in rows]), share)


def toxicity_scores(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        describe = Describer(m.table) if m else None
        for batch in batches:
            scores = []
            for at in range(0, batch.num_rows, 256):
                part = [text_words(t.as_py() or "") for t in batch.column(1).slice(at, 256)]
                scores.append(m.scores(describe(part)) if m else np.zeros(len(part)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores or [np.empty(0)]), pa.float64())], ["doc_id", "score"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, score double")
