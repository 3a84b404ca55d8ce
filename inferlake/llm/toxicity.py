"""Toxicity by a support vector machine on a gapped subsequence string kernel.

Two words are as similar as the letter subsequences of length three that they share, each
weighted by ``DECAY`` to the power of the letters it spans in both words. A word is compared
with a landmark by its best matching part: the share of the landmark's own kernel whose
subsequences the word has, 1 for equal words, so letters inserted around or between them do
not count against it. Where it spans more than the landmark does with one letter in every gap,
the value falls in proportion to the kernel, and for each letter of the word before or after the match
by ``EDGE``, so that a word that merely contains a landmark is little like it. No value is cut off; all are raised to ``POWER``.
A text is its words' best similarity to each of some landmark words; the landmarks are
those whose share of label 1 in the training texts is beyond chance, copies of a text counted once, and the Nyström
map (the landmarks' similarity matrix to the power -1/2) turns similarities into features. Both sides use the same
measure; as it is one-sided, the map takes its symmetric part with small eigenvalues raised, which approximates no
positive definite kernel exactly. A linear machine with squared hinge loss is fitted on the features and
the best similarity of all, which is penalised least, so that one perfect word decides; a logistic curve turns its margins
into scores. A plain word that is a landmark with other letters inside it ("scrum") can't be told from a disguised one.

Words are compared in a bare form: A-Z lower-cased, signs and digits inside words dropped, and
runs of single letters joined, so that "s.c.u.m" and "s c u m" are one word. Words beyond
``WINDOW`` bytes are compared in overlapping windows. Whole texts are read.

Only a bounded sample of the labelled rows is learned from (``LABELLED_ROWS``, by hash of the id).

Defined results: null and empty texts have no similarities and get the score of a text
without any; null labels are not learned from; with one class only, or without labels, every
score is the share of label 1 (0 without labels); equal rows get equal scores; equal ids are
each scored; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import staged
from .words import Texts, Words, keep_only, process_cache, shingles, slices, words, _IN_WORD, _LOWER

LABELLED_ROWS = 20_000
LANDMARKS = 48   # at most; few words pass the evidence
DECAY, POWER = 0.6, 4
MARGIN = 0.5    # of the evidence beyond what the luckiest of all words is expected to have
EDGE = 0.8      # for each letter of a word before or after its match
#: Of the features, and of the best similarity: large and small, so that one perfect word decides.
PENALTY, BEST_PENALTY = 200.0, 0.01
WINDOW = 24
#: Distinct words, and rows of similarities, that a Python process holds.
HELD_WORDS, HELD_ROWS = 400_000, 150_000
#: Subsequences that are looked up at once.
LOOKED_UP = 500_000

_CODE = np.zeros(256, dtype=np.uint8)
_CODE[97:123] = np.arange(1, 27)
_CODE[128:256] = 27 + (np.arange(128, 256) & 31)
_LETTER = _CODE > 0


def bare(texts: Texts) -> Texts:
    """Lower-case letters and white space only; single letters in a row become one word."""
    data = _LOWER[texts.data]
    keep = _LETTER[data] | ~_IN_WORD[data]
    sums = np.concatenate([[0], np.cumsum(keep)])
    data, offsets = data[keep], sums[texts.offsets]
    letter = _LETTER[data]
    single = letter.copy()
    single[1:] &= ~letter[:-1]
    single[:-1] &= ~letter[1:]
    between = np.zeros(len(data), dtype=bool)
    between[1:-1] = single[:-2] & single[2:] & ~letter[1:-1] & (data[1:-1] == 32)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    between[1:] &= ~edge[1:-1]
    sums = np.concatenate([[0], np.cumsum(~between)])
    return Texts(data[~between], sums[offsets], texts.first_row)


def codes(found: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of some words in windows of ``WINDOW`` letters, and the word of each window."""
    starts, sizes = found.starts[at], (found.ends - found.starts)[at]
    step = WINDOW // 2
    windows = np.maximum(1, -(-(sizes - step) // step))
    owner = np.repeat(np.arange(len(at)), windows)
    shift = (np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)) * step
    begin = starts[owner] + shift
    size = np.minimum(sizes[owner] - shift, WINDOW)
    cell = np.arange(WINDOW)[None, :]
    index = np.minimum(begin[:, None] + cell, max(len(found.data) - 1, 0))
    return np.where(cell < size[:, None], _CODE[found.data[index]], 0), owner


def code_word(word: str) -> np.ndarray:
    out = np.zeros(WINDOW, dtype=np.uint8)
    data = np.frombuffer(word.encode()[:WINDOW], np.uint8)
    out[:len(data)] = _CODE[data]
    return out


def subsequence_kernel(a: np.ndarray, b: np.ndarray, length: int = 3) -> np.ndarray:
    """Gap-weighted kernel of each row of ``a`` with the same row of ``b`` (code 0 pads)."""
    n, width_a, width_b = len(a), a.shape[1], b.shape[1]
    square = DECAY * DECAY
    # inner[i][t]: subsequences of i letters of the rows so far, up to letter t of b, gaps paid to the end.
    inner = [np.ones((n, width_b + 1))] + [np.zeros((n, width_b + 1)) for _ in range(length - 1)]
    total = np.zeros(n)
    for s in range(width_a):
        match = (a[:, s:s + 1] == b) & (a[:, s:s + 1] > 0)
        if not (a[:, s] > 0).any():
            break
        total += square * (match * inner[length - 1][:, :-1]).sum(1)
        for i in range(length - 1, 0, -1):
            run = np.zeros(n)
            for t in range(width_b):
                run = DECAY * run + square * match[:, t] * inner[i - 1][:, t]
                inner[i][:, t + 1] = DECAY * inner[i][:, t + 1] + run
    return total


def subsequences(coded: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Letter subsequences of length three of rows of ``size`` letters as numbers, and the letters each spans."""
    i, j, k = np.array(list(combinations(range(size), 3)), dtype=np.int64).reshape(-1, 3).T
    wide = coded.astype(np.int32)
    return (wide[:, i] << 12) | (wide[:, j] << 6) | wide[:, k], k - i + 1


class Similarity:
    """Similarities of words to landmarks, over all subsequences of both."""

    def __init__(self, landmarks: list[str]):
        m = len(landmarks)
        each = []
        for row in (code_word(w) for w in landmarks):
            numbers, spans = subsequences(row[None, :], int((row > 0).sum()))
            each.append((numbers[0], spans))
        self.used = np.unique(np.concatenate([np.zeros(0, np.int32), *(n for n, _ in each)]))
        self.place = np.full(1 << 18, -1, dtype=np.int32)
        self.place[self.used] = np.arange(len(self.used))
        self.weights = np.zeros((len(self.used), m), dtype=np.float32)
        for mark, (numbers, spans) in enumerate(each):
            np.add.at(self.weights[:, mark], self.place[numbers], DECAY ** spans)
        self.own = (self.weights ** 2).sum(0)
        #: Kernel of each landmark with itself with one foreign letter in every gap.
        self.apart = np.array([(DECAY ** (2 * spans - 1) * self.weights[self.place[numbers], mark]).sum()
                               for mark, (numbers, spans) in enumerate(each)], dtype=np.float32)
        self.forget()

    def forget(self) -> None:
        self.number: dict[int, int] = {}  # word hash -> row of the table; row 0 is like no landmark
        self.table = np.zeros((1, len(self.own)), dtype=np.float32)

    def words(self, coded: np.ndarray) -> np.ndarray:
        """Similarities of each row of letter codes."""
        out = np.zeros((len(coded), len(self.own)), dtype=np.float32)
        sizes = (coded > 0).sum(1)
        for size in np.unique(sizes[sizes >= 3]).tolist():
            rows = np.flatnonzero(sizes == size)
            step = max(1, LOOKED_UP // (size * (size - 1) * (size - 2) // 6))
            for start in range(0, len(rows), step):
                part = rows[start:start + step]
                numbers, spans = subsequences(coded[part], size)
                place = self.place[numbers]
                row, at = np.nonzero(place >= 0)
                if not len(row):
                    continue
                pair, back = np.unique(row * len(self.used) + place[row, at], return_inverse=True)
                combos = np.array(list(combinations(range(size), 3)), dtype=np.int8)[at]
                first, last = np.full(len(pair), size, np.int8), np.full(len(pair), -1, np.int8)
                np.minimum.at(first, back, combos[:, 0])
                np.maximum.at(last, back, combos[:, 2])
                value = np.bincount(back, (DECAY ** spans)[at]).astype(np.float32)[:, None]
                row, place = np.divmod(pair, len(self.used))
                begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                weights = self.weights[place]
                # Letters before the first and after the last letter of the match: it is part of a longer word.
                i, k = first, last
                lead = np.minimum.reduceat(np.where(weights > 0, i[:, None], size), begin, axis=0)
                tail = size - 1 - np.maximum.reduceat(np.where(weights > 0, k[:, None], -1), begin, axis=0)
                edges = np.clip(lead + tail, 0, size)
                # What the word has more often than the landmark is no part of the match.
                kernel = np.add.reduceat(np.minimum(value, weights) * weights, begin, axis=0)
                share = np.add.reduceat(weights ** 2, begin, axis=0) / self.own
                like = np.minimum(1, share * np.minimum(1, kernel / self.apart)) * (EDGE ** edges).astype(np.float32)
                out[part[row[begin]]] = like ** POWER
        return out

    def texts(self, texts: Texts) -> np.ndarray:
        """Best similarity of each text's words to each landmark."""
        out = np.zeros((len(texts), len(self.own)))
        found = words(bare(texts))
        if not len(self.own) or not len(found.hashes):
            return out
        used, at, back = np.unique(found.hashes, return_index=True, return_inverse=True)
        if len(self.number) > HELD_WORDS or len(self.table) > HELD_ROWS:
            self.forget()
        row = np.array([self.number.get(h, -1) for h in used.tolist()], dtype=np.int64)
        new = np.flatnonzero(row < 0)
        if len(new):
            coded, owner = codes(found, at[new])
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.maximum.reduceat(self.words(coded), begin, axis=0)
            some = best.any(1)
            row[new] = np.where(some, len(self.table) + np.cumsum(some) - 1, 0)
            self.table = np.concatenate([self.table, best[some]])
            self.number.update(zip(used[new].tolist(), row[new].tolist()))
        of_word = row[back]
        like = np.flatnonzero(of_word)
        if len(like):
            of_word, of_text = of_word[like], found.text[like]
            begin = np.flatnonzero(np.append(True, of_text[1:] != of_text[:-1]))
            for mark in range(0, len(self.own), 16):
                best = np.maximum.reduceat(self.table[of_word, mark:mark + 16], begin, axis=0)
                out[of_text[begin], mark:mark + 16] = best
        return out


class Machine:
    """Nyström features, squared-hinge weights, and a logistic curve on the margin."""

    def __init__(self, landmarks: list[str], features: np.ndarray, labels: np.ndarray, penalty: float = PENALTY):
        self.landmarks = landmarks
        self.constant = float(labels.mean()) if len(labels) else 0.0
        self.trained = 0 < self.constant < 1 and len(landmarks) > 0
        if not self.trained:
            return
        m = len(landmarks)
        gram = Similarity(landmarks).words(np.stack([code_word(w) for w in landmarks])).astype(np.float64)
        gram = (gram + gram.T) / 2      # the measure is one-sided; the map takes its symmetric part
        value, vector = np.linalg.eigh(gram)
        self.map = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
        x = self._inputs(features)
        y = np.where(labels > 0, 1.0, -1.0)
        weight = np.where(labels > 0, 0.5 / self.constant, 0.5 / (1 - self.constant))
        w = np.zeros(m + 2)
        ridge = np.concatenate([np.full(m, penalty), [BEST_PENALTY, 1e-6]])
        for _ in range(30):  # Newton steps on the texts inside the margin
            inside = y * (x @ w) < 1
            xi, ci = x[inside], weight[inside]
            new = np.linalg.solve(np.diag(ridge) + xi.T @ (xi * ci[:, None]), xi.T @ (ci * y[inside]))
            if np.allclose(new, w, atol=1e-9):
                break
            w = new
        self.weights = w
        margin = x @ w
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
            g = np.array([((p - labels) * margin).sum() + 1e-3 * a, (p - labels).sum()])
            v = p * (1 - p) + 1e-9
            h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
            step = np.linalg.solve(h, g)
            a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        self.curve = a, b

    def _inputs(self, features: np.ndarray) -> np.ndarray:
        """Nyström features, the best similarity of all, and a constant: one word can decide."""
        return np.hstack([features @ self.map, features.max(axis=1, keepdims=True), np.ones((len(features), 1))])

    def scores(self, features: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(features), self.constant)
        margin = self._inputs(features) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * margin + self.curve[1], -30, 30)))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, texts with label 1, texts with label 0) for the bare words of each batch."""
    for batch in batches:
        labels = batch.column(1).to_numpy()
        counts: dict[bytes, list[int]] = {}
        for texts in slices(batch.column(0)):
            found = words(bare(texts))
            _, at = np.unique(found.hashes + found.text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)
            at = at[(found.ends - found.starts)[at] >= 3]
            body, owner = found.data.tobytes(), found.text
            for s, e, k in zip(found.starts[at].tolist(), found.ends[at].tolist(), owner[at].tolist()):
                if e - s <= WINDOW:
                    counts.setdefault(body[s:e], [0, 0])[1 - int(labels[texts.first_row + k])] += 1
        if counts:
            yield pa.RecordBatch.from_arrays([
                pa.array([w.decode("utf-8", "ignore") for w in counts]), pa.array([c[0] for c in counts.values()], pa.int64()),
                pa.array([c[1] for c in counts.values()], pa.int64())], names=["word", "toxic", "clean"])


def choose_landmarks(counts: DataFrame, toxic: int, clean: int, number: int = LANDMARKS) -> list[str]:
    """Words whose share of label 1 is beyond chance, the surest first.

    The evidence of a word in n texts is n times the divergence of its share of label 1 from the share among all
    texts; by Chernoff's bound, chance alone reaches e with probability exp(-e). Among w words it must
    pass log(w) + MARGIN, which few words pass by luck; the surest ones go first.
    """
    share = toxic / (toxic + clean)
    words_of = counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    n, own = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))

    def part(p, q):
        return F.when(p > 0, p * F.log(p / q)).otherwise(0.0)

    evidence = n * (part(own, F.lit(share)) + part(1 - own, F.lit(1 - share)))
    found = staged(words_of.filter(own > share).select("word", evidence.alias("evidence")), "toxicity-words")
    least = np.log(max(1, found.count())) + MARGIN
    rows = found.filter(F.col("evidence") >= float(least)).orderBy(F.desc("evidence"), "word").limit(number).collect()
    return [r["word"] for r in rows]


def _least_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, text, least hash of five neighbouring words): near copies mostly share the hash."""
    keep_only()
    for batch in batches:
        for texts in slices(batch.column(1)):
            found = shingles(words(texts))
            begins = np.cumsum(found.counts) - found.counts
            least = np.zeros(len(texts), np.uint64)
            some = found.counts > 0
            least[some] = found.hashes[begins[some]]      # each text's hashes ascend
            part = batch.slice(texts.first_row, len(texts))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(least.view(np.int64))], names=["y", "text", "least"])


def train(docs: DataFrame, labels: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic") -> Machine:
    """Fit on at most ``LABELLED_ROWS`` labelled rows of those that ``usable`` allows."""
    sample = (labels.filter(usable & F.col(label).isNotNull()).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
              .orderBy(F.xxhash64("id", F.lit("toxicity")), "id").limit(LABELLED_ROWS))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id").select("text", "y")
    # Copies are one witness: of texts with the same least shingle and label one stays.
    rows = staged(rows.select("y", "text").mapInArrow(_least_shingles, "y int, text string, least long").groupBy("y", "least")
                  .agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("t.text", "y"), "toxicity-sample")
    sizes = rows.agg(F.sum("y"), F.count("*")).first()
    toxic, total = sizes[0] or 0, sizes[1]
    if not 0 < toxic < total:
        return Machine([], np.zeros((total, 0)), np.full(total, 1.0 if toxic else 0.0))
    counts = rows.mapInArrow(_word_counts, "word string, toxic long, clean long")
    landmarks = choose_landmarks(counts, toxic, total - toxic)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        similar = Similarity(landmarks)
        for batch in batches:
            for texts in slices(batch.column(0)):
                y = batch.column(1).slice(texts.first_row, len(texts))
                x = similar.texts(texts).astype(np.float32)
                yield pa.RecordBatch.from_arrays([y, pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])

    found = rows.mapInArrow(features, "y int, x binary").toArrow()  # at most LABELLED_ROWS small rows
    x = np.frombuffer(b"".join(found["x"].to_pylist()), np.float32).reshape(len(found), len(landmarks))
    return Machine(landmarks, x.astype(np.float64), found["y"].to_numpy())


def score(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("landmarks", "similarity")
        cache = process_cache()
        if cache.get("landmarks") != machine.landmarks:
            cache["landmarks"], cache["similarity"] = machine.landmarks, Similarity(machine.landmarks)
        similar = cache["similarity"]
        for batch in batches:
            for texts in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(texts.first_row, len(texts)),
                    pa.array(machine.scores(similar.texts(texts)))], names=["doc_id", "score"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
