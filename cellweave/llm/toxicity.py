"""Toxicity by a subsequence string kernel with Nyström landmarks and a linear SVM.

Two strings are compared by the subsequences of three bytes they share, each step
skipping at most one byte, and every skipped byte costing a factor ``DECAY``. A word
with a letter put in, left out or set apart keeps most of its subsequences.

Landmarks are the strings that mark toxic texts among the labelled ones, no two alike. A sentence
has, for each landmark, the best kernel value of its words; the Nyström map turns these
values into coordinates in which a support vector machine is fitted, on the most
suspicious sentence of each labelled text. A text's score is that of its most toxic
sentence, as a probability.

The fit reads a bounded sample of labelled rows (``SAMPLE``), taken by a hash of the
id; every text is then scored whole.

Defined cases: null and empty texts get the score of a sentence without suspicious
words; repeated rows and ids are kept, labels of an id that occurs more than once are
one label, toxic if any is; null labels are no labels; without toxic or clean labels,
or with no string that tells them apart, every text gets the share of toxic labels (0
with none) as its score; an empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import id_remainder

#: Labelled texts of each class that the fit reads at most.
SAMPLE = {1: 1500, 0: 1500}

DECAY = 0.7
LENGTHS = range(4, 8)
LANDMARKS = 60

#: A word counts as unlike a landmark below this kernel value, or below that of the
#: landmark with one more byte at its worst place, if that is less.
FLOOR = 0.5

#: Least score of a text that is called toxic.
TOXIC = 0.7

#: Words a task keeps the kernel values of.
STORED_WORDS = 300_000

_SENTENCE = re.compile(r"[.!?\n]+(?:\s+|$)")
_SPACED = re.compile(r"(?<!\w)\w(?:[^\w\n]{1,3}\w(?!\w)){3,}")
_APART = re.compile(r"[^\w]+")
_STEPS = tuple((a, b, DECAY ** (a + b - 2)) for a in (1, 2) for b in (1, 2))


def tokens(text: str) -> list[str]:
    """Lower-cased words; letters that stand alone in a row are one word."""
    lower = text.lower()
    found = lower.split()
    found += [_APART.sub("", m) for m in _SPACED.findall(lower)]
    return found


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s.strip()]


def subsequences(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each way to step: the word and the code of every subsequence of three bytes, and its weight."""
    joined = np.frombuffer(b"\0\0".join(words) + b"\0\0\0\0", np.uint8).astype(np.int32)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    n = len(owner) - 2 if len(owner) > 2 else 0
    for a, b, weight in _STEPS:
        x, y, z = joined[:n], joined[a : a + n], joined[a + b : a + b + n]
        held = (x > 0) & (y > 0) & (z > 0)
        yield owner[:n][held], ((x << 16) | (y << 8) | z)[held], weight


class Kernel:
    """Kernel values of words against landmarks, as shares of each landmark's own value."""

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = landmarks
        raw = [w.encode() for w in landmarks]
        self.feature = np.full(1 << 24, -1, np.int32)
        parts = list(subsequences(raw))
        codes = np.unique(np.concatenate([c for _, c, _ in parts])) if parts else np.zeros(0, np.int64)
        self.feature[codes] = np.arange(len(codes))
        self.weights = np.zeros((len(codes), len(raw)))
        for owner, code, weight in parts:
            np.add.at(self.weights, (self.feature[code], owner), weight)
        self.own = np.maximum((self.weights**2).sum(axis=0), 1e-9)
        self.floor = np.array([min(FLOOR, self._with_one_more(i)) for i in range(len(raw))])
        # share of a floor, of any landmark; the last for no feature
        self.most = np.append((self.weights / self.own / self.floor).max(axis=1, initial=0.0), 0.0)

    def _with_one_more(self, i: int) -> float:
        """Least kernel value of a landmark against itself with a foreign byte between two of its own."""
        word = self.landmarks[i].encode()
        varied = [word[:k] + b"\1" + word[k:] for k in range(1, len(word))]
        return float(self.values(varied)[:, i].min()) - 1e-6

    def values(self, words: list[bytes]) -> np.ndarray:
        """Of long lists in pieces, so that memory is bounded."""
        pieces = [self._values(words[i : i + 20_000]) for i in range(0, len(words), 20_000)]
        return np.concatenate(pieces) if pieces else np.zeros((0, len(self.landmarks)), np.float32)

    def can_reach(self, words: list[bytes]) -> np.ndarray:
        """Which words may reach the floor of a landmark: a bound over all landmarks at once."""
        bound = np.zeros(len(words))
        for owner, code, weight in subsequences(words):
            bound += weight * np.bincount(owner, self.most[self.feature[code]], minlength=len(words))
        return bound >= 1 - 1e-6

    def _values(self, words: list[bytes]) -> np.ndarray:
        result = np.zeros((len(words), len(self.landmarks)), np.float32)
        for owner, code, weight in subsequences(words):
            feature = self.feature[code]
            hit = feature >= 0
            owner, feature = owner[hit], feature[hit]
            for lo in range(0, len(owner), 200_000):
                o, f = owner[lo : lo + 200_000], feature[lo : lo + 200_000]
                first = np.flatnonzero(np.diff(o, prepend=-1))
                result[o[first]] += weight * np.add.reduceat(self.weights[f], first, axis=0)
        return np.minimum(result / self.own, 1.0).astype(np.float32)


class Model:
    """Landmarks, Nyström map, separating plane and the scale of its probabilities."""

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = landmarks
        self.plane = np.zeros(len(landmarks) + 1)
        self.scale, self.shift = 1.0, 0.0
        if landmarks:
            kernel = Kernel(landmarks)
            root = np.sqrt(kernel.own)
            gram = (kernel.weights.T @ kernel.weights) / np.outer(root, root)
            values, vectors = np.linalg.eigh(gram)
            kept = values > 1e-6
            self.map = vectors[:, kept] / np.sqrt(values[kept])
        else:
            self.map = np.zeros((0, 0))

    def coordinates(self, values: np.ndarray) -> np.ndarray:
        z = values @ self.map
        return np.hstack([z, np.ones((len(z), 1))])

    def margins(self, values: np.ndarray) -> np.ndarray:
        if not self.landmarks:
            return np.zeros(len(values))
        return self.coordinates(values) @ self.plane

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * margins + self.shift, -30, 30)))


class Scorer:
    """Scores texts; keeps the kernel values of suspicious words within a task."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.kernel = Kernel(model.landmarks) if model.landmarks else None
        self.known: set[str] = set()
        self.suspects: dict[str, np.ndarray] = {}
        self.nothing = np.zeros((1, len(model.landmarks)), np.float32)

    def learn(self, words: set[str]) -> None:
        if len(self.known) > STORED_WORDS:  # starts anew
            self.known.clear()
            self.suspects.clear()
        new = list(words - self.known)
        self.known.update(new)
        if self.kernel is None or not new:
            return
        # a word with other characters than letters and digits also stands for what is left without them
        forms = [(w, w.encode()) for w in new] + [(w, _APART.sub("", w).encode()) for w in new if not w.isalnum()]
        for lo in range(0, len(forms), 50_000):
            some = forms[lo : lo + 50_000]
            some = [some[i] for i in np.flatnonzero(self.kernel.can_reach([x for _, x in some]))]
            for (w, _), values in zip(some, self.kernel.values([x for _, x in some])):
                if (values >= self.kernel.floor).any():
                    self.suspects[w] = np.maximum(values, self.suspects[w]) if w in self.suspects else values

    def sentence_values(self, text: str) -> np.ndarray:
        """A row for each sentence with suspicious words, and one of zeros."""
        rows, lower = [self.nothing[0]], text.lower()
        for words in [*map(str.split, sentences(lower)), *([_APART.sub("", m)] for m in _SPACED.findall(lower))]:
            held = [self.suspects[w] for w in words if w in self.suspects]
            if held:
                rows.append(held[0] if len(held) == 1 else np.max(held, axis=0))
        return np.array(rows)

    def score(self, texts: list[str]) -> np.ndarray:
        split = [set(tokens(t)) for t in texts]
        self.learn(set().union(*split))
        base = self.model.margins(self.nothing)[0]
        margins = np.full(len(texts), base)
        for i, words in enumerate(split):
            if not words.isdisjoint(self.suspects):
                margins[i] = self.model.margins(self.sentence_values(texts[i])).max()
        return self.model.scores(margins)


def without_copies(texts: list[str]) -> list[str]:
    """The texts without copies and near copies: those that share four of eight minimum hashes with an earlier one."""
    seen: dict[tuple[int, int], list[int]] = {}
    kept = []
    for i, text in enumerate(texts):
        words = [w.encode() for w in set(tokens(text))] or [b""]
        hashes = np.array([zlib.crc32(w) for w in words], np.uint64)
        marks = [(k, int(((hashes * (2 * k + 1) * 0x9E3779B1) & 0xFFFFFFFF).min())) for k in range(8)]
        shared = Counter(j for m in marks for j in seen.get(m, ()))
        if max(shared.values(), default=0) < 4:
            kept.append(text)
        for m in marks:
            seen.setdefault(m, []).append(i)
    return kept


def choose_landmarks(toxic: list[str], clean: list[str]) -> list[str]:
    """The strings found in most toxic texts and hardly any clean one, no two with three characters in common."""
    one: dict[str, str] = {}  # equal words of all texts are one string
    in_toxic = [{one.setdefault(w, w) for w in tokens(t)} for t in toxic]
    in_clean = [{one.setdefault(w, w) for w in tokens(t)} for t in clean]
    toxic_count = Counter(w for ws in in_toxic for w in ws)
    clean_count = Counter(w for ws in in_clean for w in ws)
    ratio = len(toxic) / len(clean)
    telling = {w for w, n in toxic_count.items() if n > 3 * ratio * clean_count[w]}
    cut: dict[str, set[str]] = {}

    def parts(word: str) -> set[str]:
        if word not in cut:
            cut[word] = {word[i : i + n] for n in LENGTHS for i in range(len(word) - n + 1)}
        return cut[word]

    counts = Counter(s for ws in in_toxic for s in set().union(*map(parts, ws & telling)))
    least = max(6, len(toxic) // 80)
    frequent = {s for s, n in counts.items() if n >= least}
    held = {w: p for w in clean_count if (p := frequent.intersection(w[i : i + n] for n in LENGTHS for i in range(len(w) - n + 1)))}
    in_clean_too = Counter(s for ws in in_clean for s in set().union(*(held[w] for w in ws if w in held)))
    half = Counter(s for ws in in_toxic[::2] for s in set().union(*map(parts, ws & telling)) & frequent)
    # what both halves of the toxic texts hold, less what clean texts hold
    gain = {s: 2 * min(half[s], counts[s] - half[s]) - 10 * ratio * in_clean_too[s] for s in frequent}
    words_of: dict[str, list[str]] = {}
    texts_of: dict[str, set[int]] = {}
    for i, ws in enumerate(in_toxic):
        for w in ws & telling:
            texts_of.setdefault(w, set()).add(i)
    for w in texts_of:
        for s in parts(w) & frequent:
            words_of.setdefault(s, []).append(w)
    landmarks: list[str] = []
    used: set[str] = set()
    for s in sorted(frequent, key=lambda s: (-gain[s], -len(s), s)):
        threes = {s[i : i + 3] for i in range(len(s) - 2)}
        if gain[s] < least or len(landmarks) == LANDMARKS:
            break
        # words that an earlier landmark explains do not speak for this one
        rest = [texts_of[w] for w in words_of[s] if not any(x in w for x in landmarks)]
        if used.isdisjoint(threes) and len(set().union(*rest)) >= least:
            landmarks.append(s)
            used |= threes
    return landmarks


def _separate(z: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 100.0) -> np.ndarray:
    """The plane of least squared hinge loss, by Newton steps on the rows within the margin."""
    plane = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(50):
        inside = y * (z @ plane) < 1
        a = z[inside] * (cost * weight[inside])[:, None]
        new = np.linalg.solve(ridge + a.T @ z[inside], a.T @ y[inside])
        if np.allclose(new, plane, atol=1e-9):
            break
        plane = new if _ < 20 else (plane + new) / 2
    return plane


def _calibrate(margin: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic scale and shift of the margins, with targets drawn in by the class sizes."""
    target = np.where(positive, (positive.sum() + 1) / (positive.sum() + 2), 1 / ((~positive).sum() + 2))
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


def fit(toxic: list[str], clean: list[str], share: float) -> Model:
    """``share`` is that of toxic texts among the labelled ones; the sample may have another."""
    toxic, clean = without_copies(toxic), without_copies(clean)
    landmarks = choose_landmarks(toxic, clean) if toxic and clean else []
    if not landmarks:
        model = Model([])
        model.shift = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        return model
    model = Model(landmarks)
    scorer = Scorer(model)

    def hardest(text: str) -> np.ndarray:
        rows = scorer.sentence_values(text)
        return rows[rows.sum(axis=1).argmax()]

    scorer.learn({w for text in toxic + clean for w in tokens(text)})
    rows = [hardest(t) for t in toxic] + [hardest(t) for t in clean]
    y = np.array([1.0] * len(toxic) + [-1.0] * len(clean))
    # sentences in which a marking string has one more character
    marking = [s for s in model.landmarks if sum(s in t.lower() for t in toxic) > sum(s in t.lower() for t in clean)]
    varied = [(s[:k] + x + s[k:]).encode() for s in marking for k in range(1, len(s)) for x in ("*", chr(97 + 7 * k % 26))]
    if varied:
        rows += list(scorer.kernel.values(varied))
        y = np.append(y, np.ones(len(varied)))
    values = np.array(rows)
    # a toxic text without any suspicious word has no sentence to learn from
    taught = (y < 0) | (values.max(axis=1) > 0)
    balance = np.where(y > 0, 1 / max(1, (taught & (y > 0)).sum()), 1 / (y < 0).sum()) * len(y) / 2
    model.plane = _separate(model.coordinates(values)[taught], y[taught], balance[taught])
    weight = np.where(y > 0, share / len(toxic), (1 - share) / len(clean)) * len(y)
    real = slice(0, len(toxic) + len(clean))
    model.scale, model.shift = _calibrate(model.margins(values)[real], y[real] > 0, weight[real])
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """``(doc_id, text, label)``: whole texts of at most ``SAMPLE`` labelled documents of each class, by a hash of the id."""
    marked = (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    classes = []
    for value, most in SAMPLE.items():
        some = marked.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        rows = texts.join(F.broadcast(some), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        classes.append(rows.select("doc_id", "text", F.lit(value).alias("label")))
    return classes[0].unionByName(classes[1])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fitted by one task on the bounded sample; the driver holds the model, never the texts."""
    share = labels.agg(F.avg(F.when(F.col(label) == 1, 1.0).when(F.col(label) == 0, 0.0))).first()[0] or 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {value: [] for value in SAMPLE}
        for batch in batches:
            for i, t, value in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "label"))):
                held[value].append((i, t or ""))
        toxic, clean = ([t for _, t in sorted(held[value], key=lambda r: r[0])] for value in (1, 0))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(toxic, clean, share))], pa.binary())], ["model"])

    found = labelled_sample(docs, labels, doc_id, text, label).coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else fit([], [], share)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """The documents with a score between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                rows = batch.slice(lo, 1000)
                found = scorer.score([t or "" for t in rows.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.float64())], names=[*columns, into])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{into}` double")


def held_out(doc_id: str = "doc_id"):
    return id_remainder(doc_id, 3) == 1


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per document: ``held_out``, ``score`` and ``predicted``; learns from rows that are not held out."""
    model = train(docs, labels.filter(~held_out(doc_id)), doc_id, text, label)
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return score(read, model).select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted")
    )
