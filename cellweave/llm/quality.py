"""Text quality by naive Bayes features in a support vector machine.

A text is the set of its n-grams: single words and pairs of words as they stand, and
one to three neighbouring word shapes (letters by case, digits, signs as they are,
runs folded, and a mark for a word that repeats the one before it). Every indicator is
scaled by the logarithm of the ratio of its smoothed shares in the two classes, the row
is brought to unit length, and a linear model is fitted to it by dual coordinate
descent on the hinge loss. The margin becomes a probability by a logistic curve fitted
to margins of rows that the model had not seen.

The fit reads a bounded sample of labelled rows (``SAMPLE``) taken by a hash of the id,
equal texts once, equal ids as one row with the higher label. n-grams are 64-bit
hashes, so tasks send numbers, not texts, to the driver. Every text is then scored
whole.

Defined cases: null and empty texts have no n-grams and get the score of the model's
intercept; repeated rows and ids are kept and scored each; null ids have no label; a
null label is none; with labels of one class only, or none, every text gets the share of
label 1 among the labels (0.5 with none); an empty table gives an empty result. Only the
named columns are read, so others cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import id_remainder, texts_of

#: Labelled rows of each class that the fit reads at most.
SAMPLE = 2_500

#: n-grams found in fewer rows of the sample are not used.
LEAST_ROWS = 4

SMOOTHING = 1.0
COST = 1.0
EPOCHS = 30
FOLDS = 3

#: Least score of a text that is called good.
GOOD = 0.5

#: Distinct words a task remembers the hashes of.
STORED_WORDS = 500_000

SHAPES = bytes(
    ord("X") if 65 <= c <= 90 else ord("x") if 97 <= c <= 122 or c >= 128 else ord("9") if 48 <= c <= 57 else c
    for c in range(256)
)
FOLD = re.compile(rb"(.)\1+", re.DOTALL)

# Odd multipliers that keep the orders and kinds of n-grams apart.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
REPEAT = np.uint64(0xA0761D6478BD642F)


class Words(dict):
    """Numbers of words, given when a word is first asked for, and the hashes of word and shape by number."""

    def __init__(self):
        super().__init__()
        self.hashes = np.empty((1024, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        if at == len(self.hashes):
            self.hashes = np.concatenate((self.hashes, np.empty_like(self.hashes)))
        shape = FOLD.sub(rb"\1", word.translate(SHAPES))[:12]
        self.hashes[at] = xxhash.xxh64_intdigest(word, 1), xxhash.xxh64_intdigest(shape, 2)
        return at


class Grams:
    """n-gram hashes of texts; the hashes of words are remembered."""

    def __init__(self):
        self.known = Words()

    def of(self, text: bytes) -> np.ndarray:
        """Hashes of the text's n-grams, repeats included."""
        words = text.split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > STORED_WORDS:
            self.known = Words()
        numbers = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        both = self.known.hashes[numbers]
        word, shape = both[:, 0].copy(), both[:, 1].copy()
        shape[1:][word[1:] == word[:-1]] = REPEAT
        pairs = shape[:-1] * MIX[1] ^ shape[1:] * MIX[2]
        return np.concatenate(
            [
                word,
                word[:-1] * MIX[0] ^ word[1:],
                shape * MIX[3],
                pairs,
                (pairs[:-1] * MIX[0]) ^ (shape[2:] * MIX[3]),
            ]
        )


@dataclass(frozen=True)
class Model:
    """Sorted n-gram hashes with ratio and weight, and the curve from margins to scores."""

    grams: np.ndarray
    ratio: np.ndarray
    weight: np.ndarray
    intercept: float
    scale: float
    shift: float

    def margin(self, grams: np.ndarray) -> float:
        found = known_positions(self.grams, grams)
        if not len(found):
            return self.intercept
        length = np.sqrt((self.ratio[found] ** 2).sum())
        return self.intercept + (self.ratio[found] @ self.weight[found]) / length if length > 0 else self.intercept

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -30, 30))))


def known_positions(sorted_grams: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Places of the distinct known n-grams among the sorted ones."""
    if not len(sorted_grams) or not len(grams):
        return np.empty(0, np.int64)
    at = np.searchsorted(sorted_grams, grams)
    at[at == len(sorted_grams)] = 0
    return np.unique(at[sorted_grams[at] == grams])


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, width: int, seed: int = 0):
    """Weights and intercept of the least hinge loss by dual coordinate descent.

    Every step solves one row's dual variable exactly, keeping it between 0 and the row's cost.
    The intercept is the weight of a constant one.
    """
    weight, intercept = np.zeros(width), 0.0
    alpha = np.zeros(len(y))
    square = np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(len(y)):
            slope = y[i] * (weight[rows[i]] @ values[i] + intercept) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                weight[rows[i]] += step * values[i]
                intercept += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return weight, intercept


def log_count_ratio(rows: list[np.ndarray], good: np.ndarray, width: int) -> np.ndarray:
    counts = [np.full(width, SMOOTHING), np.full(width, SMOOTHING)]
    for found, g in zip(rows, good):
        counts[int(g)][found] += 1
    bad, fine = counts
    return np.log(fine / fine.sum()) - np.log(bad / bad.sum())


def _fit_margins(rows, good, width, keep):
    """Ratio, weight and intercept from the kept rows; each class weighs the same."""
    taught = [rows[i] for i in keep]
    ratio = log_count_ratio(taught, good[keep], width)
    unit = lambda r: ratio[r] / max(np.sqrt((ratio[r] ** 2).sum()), 1e-12)
    y = np.where(good[keep], 1.0, -1.0)
    share = np.where(good[keep], good[keep].mean(), 1 - good[keep].mean())
    weight, intercept = descend(taught, [unit(r) for r in taught], y, COST * 0.5 / share, width)
    margins = lambda rs: np.array([unit(r) @ weight[r] + intercept for r in rs])
    return ratio, weight, intercept, margins


def calibrate(margin: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve, targets drawn in by the class sizes."""
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    x = np.column_stack([margin, np.ones_like(margin)])
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (weight * (target - p)) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def constant(share: float) -> Model:
    none = np.empty(0)
    return Model(none.astype(np.uint64), none, none, 0.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))


def fit(sample: list[np.ndarray], good: np.ndarray, share: float) -> Model:
    """``sample`` holds every row's distinct n-grams; ``share`` is that of label 1 among all labels."""
    if not len(good) or good.all() or not good.any():
        return constant(share)
    grams, counts = np.unique(np.concatenate(sample), return_counts=True)
    grams = grams[counts >= min(LEAST_ROWS, len(good))]
    if not len(grams):
        return constant(share)
    rows = [known_positions(grams, g) for g in sample]
    folds = np.arange(len(good)) % FOLDS
    unseen = np.zeros(len(good))
    for f in range(FOLDS):
        keep = np.flatnonzero(folds != f)
        if good[keep].all() or not good[keep].any():
            keep = np.arange(len(good))
        left = np.flatnonzero(folds == f)
        unseen[left] = _fit_margins(rows, good, len(grams), keep)[3]([rows[i] for i in left])
    # the sample has its own class shares; the curve is fitted to those of all labels
    weight = np.where(good, share / good.sum(), (1 - share) / (~good).sum()) * len(good)
    scale, shift = calibrate(unseen, good, weight)
    ratio, w, intercept, _ = _fit_margins(rows, good, len(grams), np.arange(len(good)))
    return Model(grams, ratio, w, float(intercept), scale, shift)


def _sampled_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for batch in batches:
        found = [np.unique(grams.of(t)).view(np.int64) for t in texts_of(batch.column(2))]
        offsets = np.cumsum([0] + [len(x) for x in found]).astype(np.int32)
        values = pa.array(np.concatenate(found) if found else np.empty(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(offsets), values)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["mark", "label", "grams"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    marked = (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter("doc_id IS NOT NULL AND label IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    share = marked.agg(F.avg("label")).first()[0]
    if share is None:
        return constant(0.5)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = marked.filter("label = 0").orderBy(*order).limit(SAMPLE).union(marked.filter("label = 1").orderBy(*order).limit(SAMPLE))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(some), "doc_id")
    # copies teach once, whatever their number: rows are keyed by a digest of the text
    held = (
        texts.groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("mark"))
        .agg(F.max("label").alias("label"), F.any_value("text").alias("text"))
        .mapInArrow(_sampled_grams, "mark string, label int, grams array<long>")
        .orderBy("mark")
        .toArrow()
    )
    lists = held.column("grams").combine_chunks()
    flat, ends = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy()
    rows = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
    return fit(rows, held.column("label").to_numpy().astype(bool), float(share))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held = Grams(), shared.value
        for batch in batches:
            found = [held.score(held.margin(grams.of(t))) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(run, f"doc_id {id_type}, score double")


def held_out(doc_id: str = "doc_id"):
    return id_remainder(doc_id, 3) == 1


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per document: ``held_out``, ``score`` and ``predicted``; learns from rows that are not held out."""
    model = train(docs, labels.filter(~held_out(doc_id)), doc_id, text, label)
    return score(docs, model, doc_id, text).select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted")
    )
