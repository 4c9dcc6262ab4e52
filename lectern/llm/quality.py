"""Quality by ordinal cumulative-link regression on graded ratings over hashed text.

Grades are ordered integers. One weight vector over hashed features is shared by all grades, and
ordered thresholds part them: P(grade > g) = logistic(w . x - threshold g). The expected grade
and the tail probability P(grade > cut) follow; documents with a tail probability of at least the
limit are kept.

Features of a text: hashed words, hashed word shapes (letters, capitals, digits and other signs,
run by run, of whole words), hashed shapes of neighbours, each a count over the square root of the words; and
numbers of the whole text: length, shares of capitals, digits and other signs, distinct words
over words, distinct lines over lines. The model is linear, so a text's score is the sum over
its words of what a worker remembers of each.

Training takes a bounded sample of at most SAMPLE rated rows that are not held out. Their features are
read in the tasks; the driver gets at most BUCKETS sums a text, and no texts, and fits them. Null ratings, ids and texts are left out of it; null texts score as empty. With one grade or none
in the ratings, every text has that grade. Repeated rows score alike.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import labelled_sample

SAMPLE = 4_000
BUCKETS = 1 << 14
NUMBERS = 7
CACHE_SIZE = 250_000
_SIGNS = re.compile(r"[A-Z]+|[0-9]+|[^\W\d_]+|[^\w]+|_+")


def shape(word: str) -> str:
    """Runs of capitals (A), digits (0), other letters (a) and signs (by themselves, two at most)."""
    return "".join("A" if r[0].isascii() and r[0].isupper() else "0" if r[0].isdigit() else "a" if r[0].isalpha() else r[0] * min(2, len(r)) for r in _SIGNS.findall(word))


def _crc(kind: str, s: str) -> int:
    return zlib.crc32(f"{kind}{s}".encode("utf-8", "surrogatepass")) % BUCKETS


class Reader:
    """Texts to features; remembers each word's buckets and shape."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int, str]] = {}

    def word(self, w: str) -> tuple[int, int, str]:
        found = self.known.get(w)
        if found is None:
            if len(self.known) >= CACHE_SIZE:
                self.known.clear()
            s = shape(w)
            found = self.known[w] = _crc("w", w.lower().strip(".,;:!?")), _crc("s", s), s
        return found

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets, their values, and the numbers of the whole text."""
        text = text or ""
        words = text.split()
        counts: Counter = Counter()
        for w, n in Counter(words).items():
            a, b, _ = self.word(w)
            counts[a] += n
            counts[b] += n
        shapes = [self.word(w)[2] for w in words]
        for (a, b), n in Counter(zip(shapes, shapes[1:])).items():
            counts[_crc("n", f"{a} {b}")] += n
        at = np.fromiter(counts.keys(), np.int64, len(counts))
        value = np.fromiter(counts.values(), np.float64, len(counts)) / max(1, len(words)) ** 0.5 / 4
        return at, value, numbers(text, words)


def numbers(text: str, words: list[str]) -> np.ndarray:
    n, lines = max(1, len(text)), text.split("\n")
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=4) / n
    return np.array([1.0, np.log1p(len(words)) / 5, kinds[1] * 3, kinds[2] * 3, kinds[3] * 3, len(set(words)) / max(1, len(words)), len(set(lines)) / len(lines)])


_KIND = np.array([1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if 33 <= b <= 126 and not 97 <= b <= 122 else 0 for b in range(256)], np.int64)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Model:
    """grades: in order; weights: of buckets, then of numbers; thresholds: rising, one fewer than grades."""

    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def tails(self, linear: np.ndarray) -> np.ndarray:
        """P(grade > g) for each grade but the highest."""
        return _logistic(linear[:, None] - self.thresholds)

    def judge(self, linear: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and P(grade > cut)."""
        tails = self.tails(linear)
        steps = np.diff(np.array(self.grades, np.float64))
        expected = self.grades[0] + tails @ steps if len(steps) else np.full(len(linear), float(self.grades[0]))
        above = [i for i, g in enumerate(self.grades) if g > cut]
        if not above or above[0] == 0:
            return expected, np.full(len(linear), float(bool(above)))
        return expected, tails[:, above[0] - 1]


def likelihood(linear: np.ndarray, level: np.ndarray, thresholds: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the levels (0 to len(thresholds)), and its gradients by the linear scores and by the thresholds."""
    n, k = len(linear), len(thresholds)
    edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
    below, above = _logistic(edges[level + 1] - linear), _logistic(edges[level] - linear)  # the grade lies between
    chance = np.maximum(below - above, 1e-9)
    d_high, d_low = -below * (1 - below) / chance / n, above * (1 - above) / chance / n
    d_thresholds = np.bincount(np.minimum(level, k - 1), np.where(level < k, d_high, 0), k) + np.bincount(np.maximum(level - 1, 0), np.where(level > 0, d_low, 0), k)
    return float(-np.log(chance).mean()), -(d_high + d_low), d_thresholds


def fit(texts: list[str | None], ratings: list[int], rounds: int = 200, decay: float = 2e-4) -> Model:
    """A model of texts and their ratings; train does the same over a table."""
    reader = Reader()
    return fit_features([reader.features(t) for t in texts], ratings, rounds, decay)


def fit_features(features: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ratings: list[int], rounds: int = 200, decay: float = 2e-4) -> Model:
    """Full-batch Adam on the cumulative-link likelihood; thresholds stay in order as sums of positive gaps."""
    grades = sorted(set(ratings)) or [0]
    if len(grades) == 1:
        return Model(grades, np.zeros(BUCKETS + NUMBERS), np.zeros(0))
    owner = np.repeat(np.arange(len(features)), [len(a) for a, _, _ in features])
    at, value, rest = np.concatenate([a for a, _, _ in features]), np.concatenate([v for _, v, _ in features]), np.array([x for *_, x in features])
    level = np.searchsorted(grades, ratings)
    n, k = len(features), len(grades) - 1
    weights, first, gaps = np.zeros(BUCKETS + NUMBERS), np.zeros(1), np.zeros(k - 1)
    params = [weights, first, gaps]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, rounds + 1):
        linear = np.bincount(owner, value * weights[at], n) + rest @ weights[BUCKETS:]
        thresholds = first[0] + np.concatenate([[0.0], np.cumsum(np.log1p(np.exp(gaps)))])
        _, d_linear, d_thresholds = likelihood(linear, level, thresholds)
        g_weights = np.concatenate([np.bincount(at, value * d_linear[owner], BUCKETS), rest.T @ d_linear]) + decay * weights
        g_gaps = np.array([d_thresholds[j + 1 :].sum() for j in range(k - 1)]) * _logistic(gaps)
        for p, g, (m, v) in zip(params, (g_weights, d_thresholds.sum(keepdims=True), g_gaps), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(grades, weights, first[0] + np.concatenate([[0.0], np.cumsum(np.log1p(np.exp(gaps)))]))


class Scorer:
    """The linear scores of texts; remembers what each word and each pair of shapes adds."""

    def __init__(self, model: Model):
        self.weights = model.weights.tolist()
        self.numbers = model.weights[BUCKETS:]
        self.words: dict[str, tuple[float, int]] = {}
        self.shapes: dict[str, int] = {}
        self.pairs: dict[tuple[int, int], float] = {}

    def _word(self, w: str) -> tuple[float, int]:
        if len(self.words) >= CACHE_SIZE:
            self.words.clear()
        s = shape(w)
        number = self.shapes.setdefault(s, len(self.shapes))
        found = self.words[w] = self.weights[_crc("w", w.lower().strip(".,;:!?"))] + self.weights[_crc("s", s)], number
        return found

    def _pair(self, pair: tuple[int, int], names: list[str]) -> float:
        found = self.pairs[pair] = self.weights[_crc("n", f"{names[pair[0]]} {names[pair[1]]}")]
        return found

    def linear(self, text: str | None) -> float:
        text = text or ""
        words = text.split()
        if len(self.shapes) > CACHE_SIZE or len(self.pairs) > CACHE_SIZE:
            self.words, self.shapes, self.pairs = {}, {}, {}
        get, new = self.words.get, self._word
        known = [get(w) or new(w) for w in words]
        total = sum(x for x, _ in known)
        shapes = [s for _, s in known]
        counts = Counter(zip(shapes, shapes[1:]))
        names = list(self.shapes) if any(p not in self.pairs for p in counts) else []
        for pair, n in counts.items():
            weight = self.pairs.get(pair)
            total += n * (self._pair(pair, names) if weight is None else weight)
        return total / max(1, len(words)) ** 0.5 / 4 + float(numbers(text, words) @ self.numbers)


def ratings(labels: DataFrame) -> DataFrame:
    """(doc_id, rating) of labels with quality and toxic: 0 for poor texts, 1 for good ones that are toxic, 2 for good ones that aren't."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) > 0
    return labels.select("doc_id", F.when(F.col("quality") <= 0, 0).when((F.col("quality") > 0) & toxic, 1).when(F.col("quality") > 0, 2).alias("rating"))


def train(docs: DataFrame, labels: DataFrame, rating: str = "rating", limit: int = SAMPLE) -> Model:
    """docs: doc_id and text; labels: doc_id and the rating, an integer grade. At most limit rated rows are learnt from."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for rows in batches:
            at, value, rest = zip(*(reader.features(t) for t in rows["text"]), strict=True) if len(rows) else ([], [], [])
            yield pd.DataFrame({"doc_id": rows["doc_id"], "label": rows["label"], "at": list(at), "value": list(value), "rest": list(rest)})

    sample = labelled_sample(docs, labels, rating, limit).select("doc_id", F.col("label").cast("int").alias("label"), "text")
    found = sample.mapInPandas(read, "doc_id long, label int, at array<int>, value array<float>, rest array<double>").toPandas().sort_values("doc_id")
    features = [(np.array(a, np.int64), np.array(v, np.float64), np.array(x)) for a, v, x in zip(found["at"], found["value"], found["rest"])]
    return fit_features(features, [int(x) for x in found["label"]])


def grade(text: Column, model: Model, cut: int) -> Column:
    """struct<expected_grade, tail_probability>: of the text's grade, and of it lying above the cut."""

    @F.pandas_udf("expected_grade double, tail_probability double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for texts in batches:
            linear = np.array([scorer.linear(t) for t in texts], np.float64)
            expected, tail = model.judge(linear, cut)
            yield pd.DataFrame({"expected_grade": expected, "tail_probability": tail})

    return of(text)


def select(docs: DataFrame, model: Model, cut: int = 0, limit: float = 0.5, text: str = "text") -> DataFrame:
    """docs with expected_grade, tail_probability and kept."""
    graded = docs.withColumn("_grade", grade(F.col(text), model, cut))
    graded = graded.withColumns({"expected_grade": F.col("_grade.expected_grade"), "tail_probability": F.col("_grade.tail_probability")}).drop("_grade")
    return graded.withColumn("kept", F.col("tail_probability") >= limit)
