"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each step of the network reads one word: a hashed word embedding beside the largest, by
dimension, of the embeddings of its character 3- and 5-grams. A gated recurrent unit runs over
a window of WINDOW words in either direction, attention weighs the steps, and a linear layer
gives the window's logit. A document is as toxic as its worst window; windows overlap by half
and cover the whole text. A text without words gets the score of an empty window.

Training takes a bounded sample: at most SAMPLE labelled rows that are not held out. One dimension of
both embeddings starts as the smoothed log-odds of the label, counted in the tasks over the whole
texts. Before the rounds of MINED the tasks score all windows of the sampled texts by the network so
far, and every text gives its worst window and a random one to learn from; only those, two windows a
text, reach the driver, where the network is fitted. Labels are the only truth that is read; language,
source and id are no inputs.

Null labels and ids are left out of training; null texts score as empty. With one class of labels
or none, every score is that class's rate. Repeated rows score alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import labelled_sample
from lectern.session import cut

WINDOW, STRIDE = 32, 16
SAMPLE = 2_400
#: Rounds before which windows are chosen anew; the others learn from those of the round before.
MINED = (0, 1, 3, 5)
#: A longer word is read in parts of so many characters, each of them a step.
LONGEST = 32
WORDS, GRAMS, DIM, HIDDEN, ATTEND = 1 << 15, 1 << 16, 6, 8, 8
#: Windows that are scored at once.
BLOCK = 1024
#: Texts of a batch that are Python objects at a time.
SLICE = 256
#: How much more a toxic window weighs in the loss, at most.
POSITIVE_WEIGHT = 2.0
#: Distinct words whose inputs a worker remembers; it starts anew beyond.
CACHE_SIZE = 100_000
_SPACES = bytes(b if b >= 128 or chr(b).isalpha() else 48 if chr(b).isdigit() else 39 if b == 39 else 32 for b in range(256))


#: White space, punctuation and signs beyond ASCII, in UTF-8.
_BREAKS = re.compile(rb"\xc2[\x80-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf]|\xc3[\x97\xb7]|\xe2[\x80-\xaf][\x80-\xbf]|\xe3\x80[\x80-\xbf]|\xef\xbc[\x81-\x8f\x9a-\xa0\xbb-\xbf]|\xef\xbd[\x80\x9b-\xa5]")


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; digits are alike, other signs and white space part words. Long words come in parts."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass")
    if not raw.isascii():
        raw = _BREAKS.sub(b" ", raw)
    words = raw.translate(_SPACES).split()
    if words and max(map(len, words)) > LONGEST:
        words = [part for w in words for part in (_parts(w) if len(w) > LONGEST else (w,))]
    return words


def _parts(word: bytes) -> list[bytes]:
    chars = word.decode("utf-8", "replace")
    return [chars[i : i + LONGEST].encode() for i in range(0, len(chars), LONGEST)]


def starts(n: int) -> range:
    """Where the windows of n words begin; the last one reaches the end."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket of each word; buckets of all grams, of each word those of three characters first; where each word's grams begin."""
    of_word = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % WORDS
    flat = b"^" + b"$^".join(words) + b"$"
    try:
        flat.decode()
    except UnicodeDecodeError:
        words = [w.decode("utf-8", "replace").encode() for w in words]
        flat = b"^" + b"$^".join(words) + b"$"
    flat = np.frombuffer(flat, np.uint8)
    # characters, then grams, of all words together; a character begins at a byte that continues none
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)
    chars = np.append(np.flatnonzero((flat & 0xC0) != 0x80), len(flat))
    last = np.searchsorted(chars, ends)
    sizes = np.diff(last, prepend=0)
    threes = np.maximum(sizes - 2, 1)
    counts = threes + np.maximum(sizes - 4, 0)
    begins = np.cumsum(counts) - counts
    place, three = np.arange(counts.sum()) - np.repeat(begins, counts), np.repeat(threes, counts)
    long = place >= three
    low = np.repeat(last - sizes, counts) + place - three * long
    at, end = chars[low], chars[np.minimum(low + 3 + 2 * long, np.repeat(last, counts))]
    crc, open_ = np.full(len(at), 0xFFFFFFFF, np.uint32), np.arange(len(at))
    while len(open_):
        c = crc[open_]
        crc[open_] = _CRC[(c ^ flat[at[open_]]) & 255] ^ (c >> 8)
        at[open_] += 1
        open_ = open_[at[open_] < end[open_]]
    return of_word, (~crc % GRAMS).astype(np.int32), begins


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.clip(x, -30, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _summed(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The sum of the rows that go to each place."""
    return np.stack([np.bincount(at, column, size) for column in rows.T], axis=1).astype(np.float32)


def _some(found: tuple[np.ndarray, np.ndarray, np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of some of the words."""
    of_word, grams, begins = found
    sizes = np.diff(np.append(begins, len(grams)))[chosen]
    ahead = np.cumsum(sizes) - sizes
    return of_word[chosen], grams[np.repeat(begins[chosen] - ahead, sizes) + np.arange(sizes.sum())], ahead


class Network:
    """Parameters by name, and the forward and backward passes."""

    def __init__(self, seed: int = 7):
        rnd, d, h = np.random.default_rng(seed), 2 * DIM, HIDDEN
        normal = lambda *shape: (rnd.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "words": normal(WORDS, DIM) * 10, "grams": normal(GRAMS, DIM) * 10,
            "in": normal(d, 6 * h), "bias": np.zeros(6 * h, np.float32), "fore": normal(h, 3 * h), "back": normal(h, 3 * h),
            "look": normal(2 * h, ATTEND), "look_bias": np.zeros(ATTEND, np.float32), "key": normal(ATTEND), "out": normal(2 * h), "out_bias": np.zeros(1, np.float32),
        }

    def inputs(self, of_word: np.ndarray, grams: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the network reads of each word, by its features; and the embeddings of the grams."""
        rows = self.p["grams"][grams]
        return np.concatenate([self.p["words"][of_word], np.maximum.reduceat(rows, begins, axis=0)], axis=1), rows

    def gates(self, x: np.ndarray) -> np.ndarray:
        """The input's part of update, reset and new state, of the forward then the backward unit."""
        return x @ self.p["in"] + self.p["bias"]

    def run(self, gates: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows: at (windows, steps) are rows of gates; mask is 0 beyond a window's end."""
        p, h, (n, steps) = self.p, HIDDEN, at.shape
        states = np.zeros((steps, n, 2 * h), np.float32)
        partial = not mask.all()
        for side, name in enumerate(("fore", "back")):
            state, weights = np.zeros((n, h), np.float32), p[name]
            own = gates[:, 3 * h * side : 3 * h * (side + 1)]
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                x, u = own[at[:, t]], state @ weights
                zr = _sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
                z, r, un = zr[:, :h], zr[:, h:], u[:, 2 * h :]
                new = np.tanh(x[:, 2 * h :] + r * un)
                after = new + z * (state - new)
                if partial:
                    after = np.where(mask[:, t, None], after, state)
                if keep is not None:
                    keep.append((side, t, state, z, r, un, new))
                state = states[t, :, h * side : h * (side + 1)] = after
        look = np.tanh(states @ p["look"] + p["look_bias"])
        weight = np.where(mask.T, look @ p["key"], -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        weight = weight * mask.T
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if keep is not None:
            keep.append((states, look, weight, pooled))
        return pooled @ p["out"] + p["out_bias"][0]

    def step(self, found: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray, mask: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> dict:
        """Gradients of the weighted logistic loss, of the embeddings as touched rows and theirs; found: the features of the words that at points to."""
        p, h, n, keep = self.p, HIDDEN, len(at), []
        of_word, grams, begins = found
        x, rows = self.inputs(*found)
        gates = self.gates(x)
        logits = self.run(gates, at, mask, keep)
        g = {}
        d = (weight * (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - truth) / n).astype(np.float32)
        states, look, alpha, pooled = keep.pop()
        g["out"], g["out_bias"] = pooled.T @ d, d.sum(keepdims=True)
        d_pooled = d[:, None] * p["out"]
        d_states = alpha[:, :, None] * d_pooled
        d_alpha = np.einsum("nh,tnh->tn", d_pooled, states)
        d_score = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        g["key"] = np.einsum("tna,tn->a", look, d_score)
        d_look = d_score[:, :, None] * p["key"] * (1 - look * look)
        g["look"], g["look_bias"] = np.einsum("tnh,tna->ha", states, d_look), d_look.sum(axis=(0, 1))
        d_states += d_look @ p["look"].T
        d_steps = np.zeros((at.shape[1], n, 6 * h), np.float32)
        g["fore"], g["back"] = np.zeros_like(p["fore"]), np.zeros_like(p["back"])
        carry = {0: np.zeros((n, h), np.float32), 1: np.zeros((n, h), np.float32)}
        for side, t, state, z, r, un, new in reversed(keep):
            name, m = ("fore", "back")[side], mask[:, t, None]
            d_after = carry[side] + d_states[t, :, h * side : h * (side + 1)]
            d_in = d_after * m
            d_new = d_in * (1 - z) * (1 - new * new)
            d_z, d_r = d_in * (state - new) * z * (1 - z), d_new * un * r * (1 - r)
            d_u = np.concatenate([d_z, d_r, d_new * r], axis=1)
            g[name] += state.T @ d_u
            carry[side] = d_after * (1 - m) + d_in * z + d_u @ p[name].T
            d_steps[t, :, 3 * h * side : 3 * h * (side + 1)] = np.concatenate([d_z, d_r, d_new], axis=1)
        d_gates = _summed(at.T.ravel(), d_steps.reshape(-1, 6 * h), len(gates))
        g["in"], g["bias"] = x.T @ d_gates, d_gates.sum(axis=0)
        d_x = d_gates @ p["in"].T
        owner = np.repeat(np.arange(len(of_word)), np.diff(np.append(begins, len(grams))))
        largest = np.where(rows == x[owner, DIM:], d_x[owner, DIM:], 0)
        for name, at, d_rows in (("words", of_word, d_x[:, :DIM]), ("grams", grams, largest)):
            touched, place = np.unique(at, return_inverse=True)
            g[name] = touched, _summed(place, d_rows, len(touched))
        return g


def _windows(bag: list[list[bytes]], index: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    at, mask = np.zeros((len(bag), WINDOW), np.int64), np.zeros((len(bag), WINDOW), bool)
    for i, words in enumerate(bag):
        at[i, : len(words)] = [index[w] for w in words]
        mask[i, : len(words)] = True
    return at, mask


def buckets_of(words: set[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word and gram buckets of a text's words."""
    of_word, grams, _ = features(list(words))
    return np.unique(of_word), np.unique(grams)


class Training:
    """Fits a network round by round; what it learns from is chosen elsewhere, by the network so far.

    n: how many texts there are; toxic: how many are labelled so; counts: by name of the embedding,
    (2, buckets) numbers of texts of either label that have the bucket.
    """

    def __init__(self, n: int, toxic: int, counts: dict[str, np.ndarray], rounds: int = 7, seed: int = 7):
        self.net, self.random, self.rounds, self.round, self.steps = Network(seed), np.random.default_rng(seed), rounds, 0, 0
        self.rate = toxic / n if n else 0.0
        self.over = not 0 < self.rate < 1
        if self.over:
            self.net.p["out"][:] = 0
            self.net.p["out_bias"][:] = np.log((self.rate + 1e-3) / (1 - self.rate + 1e-3))
            return
        for name, seen in counts.items():
            odds = np.log((seen[1] + 0.3) / (toxic + 1)) - np.log((seen[0] + 0.3) / (n - toxic + 1))
            self.net.p[name][:, 0] = np.where(seen.sum(axis=0) >= 3, np.clip(odds, -3, 3), 0)
        self.net.p["out_bias"][:] = -1.0
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.net.p.items()}

    def learn(self, worst: list[list[bytes]], chance: list[list[bytes]], truth: list[int]) -> None:
        """One round: the worst window of each text, and a random one of each clean text."""
        y = np.array(truth, np.float32)
        clean = np.flatnonzero(y == 0)
        windows, target = [*worst, *(chance[i] for i in clean)], np.concatenate([y, y[clean]])
        every = sorted({w for window in windows for w in window})
        index = {w: i for i, w in enumerate(every)}
        found, (at, mask) = features(every), _windows(windows, index)
        order = self.random.permutation(len(windows))
        batch = min(128, max(16, len(order) // 40))
        speed = 0.02 * (1 - self.round / self.rounds) + 0.001
        for some in (order[i : i + batch] for i in range(0, len(order), batch)):
            used, inverse = np.unique(at[some], return_inverse=True)
            weight = np.where(target[some] == 1, min(POSITIVE_WEIGHT, (1 - self.rate) / self.rate), 1.0)
            gradients = self.net.step(_some(found, used), inverse.reshape(len(some), WINDOW), mask[some], target[some], weight)
            self.steps += 1
            for k, grad in gradients.items():
                first, second = self.moments[k]
                rows, grad = grad if isinstance(grad, tuple) else (slice(None), grad)
                first[rows] += 0.1 * (grad - first[rows])
                second[rows] += 0.01 * (grad * grad - second[rows])
                self.net.p[k][rows] -= speed * (first[rows] / (1 - 0.9**self.steps)) / (np.sqrt(second[rows] / (1 - 0.99**self.steps)) + 1e-6)
        self.round += 1
        self.over = self.round >= self.rounds


def chosen_windows(net: Network, round_: int, words: list[bytes], seed: int, scorer: Scorer) -> tuple[list[bytes], list[bytes]]:
    """The worst of all windows of a text, in round 0 by the evidence of the log-odds; and one by chance."""
    begins = starts(len(words))
    if round_ == 0:
        of = {w: i for i, w in enumerate(set(words))}
        if of:
            x = net.inputs(*features(list(of)))[0]
            evidence = np.clip(x[:, 0], 0, 3) ** 2 + np.clip(x[:, DIM], 0, 3) ** 2
            sums = np.concatenate([[0.0], np.cumsum(evidence[[of[w] for w in words]])])
            values = [sums[min(len(words), s + WINDOW)] - sums[s] for s in begins]
        else:
            values = [0.0]
    else:
        values = scorer.windows(words)
    worst = begins[int(np.argmax(values))]
    chance = begins[int(np.random.default_rng([seed, round_]).integers(len(begins)))]
    return words[worst : worst + WINDOW], words[chance : chance + WINDOW]


def fit(texts: list[list[bytes]], truth: list[int], rounds: int = 7, seed: int = 7) -> Network:
    """A network from the words of texts, with a label for each; train does the same over a table."""
    counts = {name: np.zeros((2, size)) for name, size in (("words", WORDS), ("grams", GRAMS))}
    for words, label in zip(texts, truth, strict=True):
        if words:
            for seen, buckets in zip(counts.values(), buckets_of(set(words)), strict=True):
                seen[int(label), buckets] += 1
    training = Training(len(texts), sum(truth), counts, rounds, seed)
    while not training.over:
        if training.round in MINED:
            scorer = Scorer(training.net)
            worst, chance = zip(*(chosen_windows(training.net, training.round, words, i, scorer) for i, words in enumerate(texts)), strict=True)
        training.learn(list(worst), list(chance), truth)
    return training.net


class Scorer:
    """Scores texts; remembers the gate inputs of the words that it has met."""

    def __init__(self, net: Network):
        self.net = net
        self.index: dict[bytes, int] = {}
        self.gates = np.zeros((CACHE_SIZE, 6 * HIDDEN), np.float32)  # memory is taken as rows are written

    def _learn(self, words: set[bytes]) -> None:
        new = list(words.difference(self.index))
        if len(self.index) + len(new) > len(self.gates):
            self.index.clear()
            new = list(words)
        if len(new) > len(self.gates):
            self.gates = np.zeros((len(new), 6 * HIDDEN), np.float32)
        n = len(self.index)
        for i in range(0, len(new), 8192):
            some = new[i : i + 8192]
            self.gates[n + i : n + i + len(some)] = self.net.gates(self.net.inputs(*features(some))[0])
        self.index.update((w, n + i) for i, w in enumerate(new))

    def score(self, texts: list[str | None], most_words: int = 100_000) -> np.ndarray:
        """The probability of each text; most_words are held at once, but for a longer text."""
        out, held, n = [], [], 0
        for text in texts:
            words = words_of(text)
            held.append(words)
            n += len(words)
            if n >= most_words:
                out += self._score(held)
                held, n = [], 0
        return np.array(out + self._score(held))

    def windows(self, words: list[bytes]) -> list[float]:
        """The logit of every window of a text."""
        out: list[float] = []
        self._score([words], out)
        return out

    def _score(self, documents: list[list[bytes]], every: list[float] | None = None) -> list[float]:
        if not documents:
            return []
        best = [-np.inf] * len(documents)
        jobs = [(i, words, s) for i, words in enumerate(documents) for s in starts(len(words))]
        for j in range(0, len(jobs), BLOCK):
            some = jobs[j : j + BLOCK]
            low = {}
            for i, _, s in some:
                low.setdefault(i, [s, s])[1] = s
            parts = {i: documents[i][a : b + WINDOW] for i, (a, b) in low.items()}
            self._learn(set().union(*parts.values()))
            place, flat = {}, 0
            for i, words in parts.items():
                place[i] = flat - low[i][0]
                flat += len(words)
            rows = np.fromiter(map(self.index.__getitem__, chain.from_iterable(parts.values())), np.int64, flat)
            begin = np.array([place[i] + s for i, _, s in some])
            size = np.array([min(WINDOW, len(words) - s) for _, words, s in some])
            steps = np.arange(WINDOW)
            mask = steps < size[:, None]
            near = self.gates[np.append(rows, 0)]  # one gather: windows then read rows that lie together
            at = np.where(mask, begin[:, None] + steps, flat)
            for (i, _, _), logit in zip(some, self.net.run(near, at, mask).tolist(), strict=True):
                if every is not None:
                    every.append(logit)
                if logit > best[i]:
                    best[i] = logit
        return [float(x) for x in 1 / (1 + np.exp(-np.clip(best, -30, 30)))]


def bucket_counts(sample: DataFrame) -> dict[str, np.ndarray]:
    """For Training: in how many texts of either label each bucket is; at most 2 (WORDS + GRAMS) sums reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, WORDS + GRAMS), np.int64)
        for rows in batches:
            for text, label in zip(rows["text"], rows["label"]):
                words = set(words_of(text))
                if words:
                    a, b = buckets_of(words)
                    seen[int(label > 0), a] += 1
                    seen[int(label > 0), WORDS + b] += 1
        label, bucket = np.nonzero(seen)
        yield pd.DataFrame({"label": label, "bucket": bucket, "n": seen[label, bucket]})

    sums = sample.select("text", "label").mapInPandas(count, "label long, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros((2, WORDS + GRAMS))
    seen[sums["label"], sums["bucket"]] = sums["n"]
    return {"words": seen[:, :WORDS], "grams": seen[:, WORDS:]}


def windows_to_learn(sample: DataFrame, net: Network, round_: int) -> pd.DataFrame:
    """(doc_id, label, worst, chance): windows as words joined by spaces, chosen in the tasks among all windows of the sampled texts."""
    shared = sample.sparkSession.sparkContext.broadcast(net)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for rows in batches:
            pairs = [chosen_windows(shared.value, round_, words_of(t), zlib.crc32(str(i).encode()), scorer) for i, t in zip(rows["doc_id"], rows["text"])]
            worst, chance = ([b" ".join(p[k]).decode("utf-8", "replace") for p in pairs] for k in (0, 1))
            yield pd.DataFrame({"doc_id": rows["doc_id"], "label": rows["label"], "worst": worst, "chance": chance})

    found = sample.mapInPandas(choose, "doc_id long, label int, worst string, chance string").toPandas()
    shared.destroy()
    return found.sort_values(["doc_id", "worst"])


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Network:
    """docs: doc_id and text; labels: doc_id and toxic. At most limit labelled rows are learnt from."""
    sample = cut(labelled_sample(docs, labels, "toxic", limit).select("doc_id", "label", "text"))
    n = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("label") > 0).cast("long")), F.lit(0)).alias("toxic")).first()
    training = Training(n["n"], n["toxic"], bucket_counts(sample) if 0 < n["toxic"] < n["n"] else {})
    while not training.over:
        if training.round in MINED:
            found = windows_to_learn(sample, training.net, training.round)
        training.learn(*([x.encode().split() for x in found[c]] for c in ("worst", "chance")), [int(x > 0) for x in found["label"]])
    return training.net


def score(docs: DataFrame, net: Network, text: str = "text", into: str = "score") -> DataFrame:
    """docs with a column of scores from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf(T.DoubleType())
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pa.array(np.concatenate([scorer.score(texts.slice(at, SLICE).to_pylist()) for at in range(0, max(1, len(texts)), SLICE)]))

    return docs.withColumn(into, of(F.col(text)))
