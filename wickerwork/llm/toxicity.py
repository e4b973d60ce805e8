"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents and unlabelled ones, bounded samples of both, give the words to look at; linear classifiers over word
presence are trained in numpy on the non-negative risk estimator, which takes the positives' share out of the unlabelled
risk by the class prior and never lets what is left fall below zero. Scoring reads every whole text once, without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickerwork.llm.common import fold, folded_words, map_texts

#: Bounds of the samples that a model is fitted on, in documents.
MOST_POSITIVE = 4000
MOST_UNLABELLED = 12000
#: Words a model may weigh: those on at least MIN_DOCUMENTS sampled documents whose share differs between the samples.
MOST_FEATURES = 5000
MIN_DOCUMENTS = 3
MIN_Z = 4.0
MODELS = 3
EPOCHS = 200
THRESHOLD = 0.3
#: Used where there are no labelled rows to take the class prior from.
DEFAULT_PRIOR = 0.1


class Rows:
    """A 0/1 matrix by rows, enough of one for gradient descent."""

    def __init__(self, documents: Sequence[np.ndarray]) -> None:
        self.n = len(documents)
        self.size = np.fromiter(map(len, documents), np.int64, self.n)
        self.at = np.concatenate([np.zeros(0, np.int64), *documents])
        self.row = np.repeat(np.arange(self.n), self.size)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at], minlength=self.n)

    def transposed_times(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.at, weights=g[self.row], minlength=width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train_nnpu(positive: Rows, unlabelled: Rows, width: int, prior: float, seed: int, epochs: int = EPOCHS,
               rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise prior * R_p+ + max(0, R_u- - prior * R_p-), with the logistic loss.

    Where the bracket is below zero, the step goes up its slope instead, which undoes overfitting of the positives.
    Each model draws its own bootstrap weights of the rows."""
    rng = np.random.default_rng(seed)
    wp = rng.exponential(size=positive.n)
    wu = rng.exponential(size=unlabelled.n)
    wp, wu = wp / wp.sum(), wu / wu.sum()
    w, bias = np.zeros(width), np.log(prior / (1 - prior))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, epochs + 1):
        fp, fu = positive.times(w) + bias, unlabelled.times(w) + bias
        negative = wu @ np.logaddexp(0, fu) - prior * (wp @ np.logaddexp(0, fp))
        gp_neg, gu_neg = wp * _sigmoid(fp), wu * _sigmoid(fu)  # slopes of the loss of calling rows negative
        if negative >= 0:
            gp, gu = -prior * wp * _sigmoid(-fp) - prior * gp_neg, gu_neg
        else:
            gp, gu = prior * gp_neg, -gu_neg
        slope = np.append(positive.transposed_times(gp, width) + unlabelled.transposed_times(gu, width) + decay * w, gp.sum() + gu.sum())
        m = 0.9 * m + 0.1 * slope
        v = 0.999 * v + 0.001 * slope**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, bias


def calibrated(scores: np.ndarray, bias: float, prior: float) -> float:
    """The bias at which the mean probability of the unlabelled sample is the class prior. Where the bracket of the risk is held
    at zero, training leaves the level of the scores open; the prior settles it."""
    low, high = -40.0, 40.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if _sigmoid(scores + middle).mean() < prior else (low, middle)
    return min(bias, low)


class ToxicityModel:
    """The mean of several classifiers' probabilities; at most MOST_FEATURES words, sent to the tasks once."""

    def __init__(self, words: list[bytes], weights: np.ndarray, biases: np.ndarray) -> None:
        self.place = {word: i for i, word in enumerate(words)}
        self.weights, self.biases = weights, biases

    def score(self, text: bytes | None) -> float:
        seen = {self.place[w] for w in set(folded_words(text)) & self.place.keys()}
        total = self.biases + self.weights[:, sorted(seen)].sum(axis=1) if seen else self.biases
        return float(_sigmoid(total).mean())


def _documents(docs: DataFrame, ids: DataFrame, vocabulary: dict[bytes, int]) -> list[np.ndarray]:
    """The distinct words, numbered by ``vocabulary``, of the whole texts with the given ids; as many as were sampled."""
    fields = T.StructType([T.StructField("words", T.ArrayType(T.BinaryType()))])

    def make():
        return lambda texts: [[sorted(set(folded_words(t))) for t in texts]]

    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")  # the ids are bounded by the sample's size
    rows = []
    for r in map_texts(picked, "text", ["doc_id"], fields, make).toLocalIterator():
        rows.append((r.doc_id, np.array([vocabulary.setdefault(bytes(w), len(vocabulary)) for w in r.words], dtype=np.int64)))
    return [numbers for _, numbers in sorted(rows, key=lambda x: x[0])]


def fit_toxicity(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> ToxicityModel:
    """Fit on rows outside the held-out quarter (crc32 of doc_id mod 4 is 2).

    Positives are sampled from labels.toxic = 1; unlabelled texts from all documents outside the held-out quarter, whatever
    their labels. The class prior is the share of toxic rows among all labelled training rows. Null labels are left out; of
    repeated labels the largest counts. Without positives the model has no words and scores the prior everywhere."""
    known = (labels.select("doc_id", "toxic").filter(F.col("toxic").isNotNull() & (fold("doc_id", 4) != 2))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    prior = min(max((counts.toxic or 0) / counts.n, 0.001), 0.5) if counts.n else DEFAULT_PRIOR
    drawn = F.xxhash64("doc_id")
    some_positive = known.filter("toxic = 1").select("doc_id").orderBy(drawn, "doc_id").limit(most_positive)
    some_unlabelled = docs.select("doc_id").filter(fold("doc_id", 4) != 2).orderBy(drawn, "doc_id").limit(most_unlabelled)
    vocabulary: dict[bytes, int] = {}
    positive, unlabelled = _documents(docs, some_positive, vocabulary), _documents(docs, some_unlabelled, vocabulary)
    if not positive or not unlabelled or not vocabulary:
        return ToxicityModel([], np.zeros((MODELS, 0)), np.full(MODELS, np.log(prior / (1 - prior))))
    a, b = (np.bincount(np.concatenate(side), minlength=len(vocabulary)) for side in (positive, unlabelled))
    pooled = (a + b) / (len(positive) + len(unlabelled))
    spread = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / len(positive) + 1 / len(unlabelled)))
    z = np.abs(a / len(positive) - b / len(unlabelled)) / spread
    listed = list(vocabulary)
    chosen = sorted((-z[i], listed[i], i) for i in np.flatnonzero((a + b >= MIN_DOCUMENTS) & (a > 0) & (z >= MIN_Z)))[:MOST_FEATURES]
    place = np.full(len(vocabulary), -1)
    place[[i for _, _, i in chosen]] = np.arange(len(chosen))
    words = [word for _, word, _ in chosen]
    rows = [Rows([p[p >= 0] for p in (place[x] for x in side)]) for side in (positive, unlabelled)]
    models = [train_nnpu(*rows, len(words), prior, seed) for seed in range(MODELS)]
    biases = [calibrated(rows[1].times(w), bias, prior) for w, bias in models]
    return ToxicityModel(words, np.array([w for w, _ in models]).reshape(MODELS, -1), np.array(biases))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Null and empty texts get the score of a text without any
    weighed word; repeated rows are each scored; a null id is in no fold."""
    sent = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels))  # at most MOST_FEATURES words

    def make():
        model = sent.value
        return lambda texts: [[model.score(t) for t in texts]]

    scored = map_texts(docs.select("doc_id", "text"), "text", ["doc_id"], T.StructType([T.StructField("score", T.DoubleType())]), make)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
