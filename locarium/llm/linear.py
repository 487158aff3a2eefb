"""Hashed sparse features and follow-the-regularised-leader logistic regression."""

from __future__ import annotations

from array import array
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import give_back, text_udf

#: What is taken off the edges of words.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’„…¡¿–—·•"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _hash(part: str) -> int:
    return xxhash.xxh64_intdigest(part.encode("utf-8", "surrogatepass"))


class _Words(dict):
    """Word -> its place in ``hashes``; its user starts anew when it is ``full``.

    For each word as it stands between white space there are hashes of the word
    without marks at its edges, of its edge marks, and of its first ``prefix`` letters.
    Words of more than 64 characters aren't remembered, so its size is bounded in bytes too.
    """

    def __init__(self, prefix: int, most: int = 100_000):
        self.prefix, self.most, self.wide = prefix, most, 2 + (prefix > 0)
        self.hashes, self.bare = array("Q"), _hash("\0m")

    @property
    def full(self) -> bool:
        return len(self.hashes) > self.wide * self.most

    def __missing__(self, word: str) -> int:
        bare = word.strip(_MARKS)
        add, at = self.hashes.append, len(self.hashes) // self.wide
        add(_hash(bare or word))
        if len(bare) == len(word):
            add(self.bare)
        else:
            start = word.find(bare)
            add(_hash("\0m" + word[:start] + "\1" + word[start + len(bare) :][:16]))
        if self.prefix:
            add(_hash("\0p" + bare[: self.prefix]))
        if len(word) <= 64:
            self[word] = at
        return at


class Features:
    """Distinct hashed features of a text: words, word pairs, marks at the edges of words,
    the share of pairs of equal words, and word beginnings of ``prefix`` letters."""

    def __init__(self, bits: int = 22, prefix: int = 0):
        self.bits, self.prefix = bits, prefix
        self.words = _Words(prefix)

    def __reduce__(self):
        return Features, (self.bits, self.prefix)

    def __call__(self, text: str) -> np.ndarray:
        tokens = text.lower().split()
        if not tokens:
            return np.empty(0, np.int32)
        if self.words.full:
            self.words = _Words(self.prefix)
        at = np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens))
        rows = np.frombuffer(self.words.hashes, np.uint64).reshape(-1, self.words.wide)[at]
        one = rows[:, 0]
        equal = int(12 * np.count_nonzero((rows[1:, :2] == rows[:-1, :2]).all(1)) / len(tokens))
        pairs = (one[:-1] * np.uint64(31) + one[1:]) * _ODD
        shape = np.full(1, (equal + 1) * 0x51ED27F1, np.uint64)
        every = (np.concatenate([rows.ravel(), pairs, shape]) * _ODD >> np.uint64(64 - self.bits)).astype(np.int32)
        every.sort()
        return every[np.append(True, every[1:] != every[:-1])]


@dataclass
class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss; the last coordinate is the bias."""

    bits: int = 22
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    z: np.ndarray = field(init=False, repr=False)
    n: np.ndarray = field(init=False, repr=False)

    def __post_init__(self):
        self.z = np.zeros((1 << self.bits) + 1)
        self.n = np.zeros((1 << self.bits) + 1)

    def at(self, ids: np.ndarray) -> np.ndarray:
        z, bias = self.z[ids], ids == 1 << self.bits
        l1 = np.where(bias, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[ids])) / self.alpha + np.where(bias, 0.0, self.l2))
        return np.where(np.abs(z) <= l1, 0.0, w)

    def push(self, ids: np.ndarray, w: np.ndarray, g) -> None:
        n = self.n[ids]
        grown = n + g * g
        self.z[ids] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[ids] = grown

    def learn(self, ids: np.ndarray, label: int) -> None:
        ids = np.append(ids, 1 << self.bits)
        w = self.at(ids)
        self.push(ids, w, 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label)

    def agree(self, ids: np.ndarray, other: np.ndarray, strength: float) -> None:
        """One step against strength * (difference of the two linear scores) ** 2 / 2."""
        a, b = np.setdiff1d(ids, other, True), np.setdiff1d(other, ids, True)
        wa, wb = self.at(a), self.at(b)
        g = np.clip(strength * (wa.sum() - wb.sum()), -1, 1)
        if g:
            self.push(a, wa, g)
            self.push(b, wb, -g)

    def weights(self) -> np.ndarray:
        out = np.zeros((1 << self.bits) + 1, np.float32)
        active = np.append(np.flatnonzero(np.abs(self.z[:-1]) > self.l1), 1 << self.bits)
        out[active] = self.at(active)
        return out


@dataclass
class Model:
    features: Features
    weights: np.ndarray

    def score(self, text: str) -> float:
        logit = float(self.weights[self.features(text)].sum(dtype=np.float64)) + float(self.weights[-1])
        return float(1 / (1 + np.exp(-np.clip(logit, -35, 35))))

    def column(self):
        """A column function: text -> struct with the double ``score``."""
        features, kept = self.features, np.flatnonzero(self.weights).astype(np.int32)
        values, size = self.weights[kept], len(self.weights)

        def make():
            weights = np.zeros(size, np.float32)
            weights[kept] = values
            model = Model(features, weights)
            return lambda text: (model.score(text),)

        return text_udf(make, "score double")


def held_out(doc_id: str, folds: int, fold: int):
    """True where crc32 of the id's text leaves ``fold``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, label) of at most ``most`` labelled documents outside the fold, half of each
    label where both have enough, chosen by a hash of the id; and how many each label has.

    Rows with a null id or label don't count; of repeated labels the larger holds, of
    repeated documents the smallest text.
    """
    seen = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    seen = seen.where(~held_out("id", folds, fold)).groupBy("id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in seen.groupBy("label").count().collect()}
    by_hash = [F.xxhash64("id", F.lit(7)), F.col("id")]
    picked = [seen.where(F.col("label") == y).orderBy(*by_hash).limit(most // 2) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    # the sample has at most `most` ids, so it can be sent to every executor
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    return texts.select("id", "label", "text"), counts


def fitted(sample: DataFrame, counts: dict[int, int], features: Features, learner: Ftrl, epochs: int, seed: int, variants=None, strength: float = 0.0, prior: bool = True) -> Model:
    """Train on the driver from hashed features that the executors make.

    ``variants(text)`` (optional) gives counterfactual versions of a text; each is
    pulled towards the original's score with ``strength``. With no labelled rows,
    every score is 0.5; with one label only, the model leans to that label.
    """

    def make():
        def one(text: str) -> tuple:
            return features(text).tolist(), [features(v).tolist() for v in variants(text)] if variants else []

        return one

    column = text_udf(make, "ids array<int>, others array<array<int>>")
    rows = sample.select("id", "label", column("text").alias("f")).select("id", "label", "f.*").toArrow().sort_by("id")
    data = [(np.asarray(ids.values, np.int32), y, [np.asarray(o.values, np.int32) for o in others or ()]) for ids, y, others in zip(rows["ids"], rows["label"].to_pylist(), rows["others"], strict=True)]
    del rows
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            ids, y, others = data[k]
            learner.learn(ids, y)
            for o in others:
                learner.agree(ids, o, strength)
    weights = learner.weights()
    used = [sum(y == v for _, y, _ in data) for v in (0, 1)]
    del data
    give_back()
    if prior and min(used):  # back from the sample's shares of the labels to the table's
        weights[-1] += np.log(counts[1] / counts[0]) - np.log(used[1] / used[0])
    return Model(features, weights)
