"""Quality scores by kernel ridge regression on document statistics.

Each whole text becomes a short vector of statistics. Random Fourier features stand for a Gaussian kernel over them; every
partition sums its own normal equations, the sums are added in two steps, and the ridge weights are solved for once. Isotonic
regression over binned scores of a held-back part of the training rows turns scores into probabilities."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickerwork.llm.common import fold, map_texts, unused
from wickerwork.session import cut_lineage

FEATURES = 256
GAMMA = 0.08
RIDGE = 1e-3
BINS = 1000
SEED = 20240607
#: A score from here on means kept.
THRESHOLD = 0.5
#: Every labelled row in this part of a second fold calibrates, the others fit.
CALIBRATION = (5, 0)

_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_SYMBOLS = np.frombuffer(b"#*$%&|<>{}[]\\^~_=+@/", np.uint8)
_ENDS = np.frombuffer(b".!?", np.uint8)
N_STATS = 20


def document_stats(text: bytes | None) -> np.ndarray:
    """Statistics of a whole text, none of them growing with it but by logarithm. An empty text has zeros."""
    out = np.zeros(N_STATS)
    if not text:
        return out
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text)
    words = text.split()
    lines = text.split(b"\n")
    n = len(words)
    out[0] = np.log1p(size)
    out[1] = np.log1p(n)
    letters = count[_UPPER].sum() + count[_LOWER].sum() + count[128:].sum()
    out[2] = letters / size
    out[3] = count[_UPPER].sum() / max(letters, 1)
    out[4] = count[_DIGIT].sum() / size
    out[5] = count[_SYMBOLS].sum() / size
    out[6] = count[_ENDS].sum() / max(n, 1)
    out[7] = count[44] / max(n, 1)
    out[8] = count[33] / max(n, 1)
    out[9] = count[128:].sum() / size
    share = count[count > 0] / size
    out[10] = -(share * np.log2(share)).sum()
    out[11] = np.log1p(len(lines))
    if n:
        distinct = set(words)
        out[12] = len(distinct) / n
        out[13] = size / n
        out[14] = sum(map(bytes.__eq__, words, words[1:])) / n
        lengths = np.fromiter(map(len, words), np.int64, n)
        out[15] = (lengths <= 1).mean()
        out[16] = np.log1p(lengths.max())
        out[17] = lengths.std()
    filled = [x for x in lines if x]
    if filled:
        out[18] = 1 - len(set(filled)) / len(filled)
        out[19] = sum(x[-1:] in b".!?" for x in filled) / len(filled)
    return out


def text_stats(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` with ``stats``, an array of doubles, of each whole text; null is as empty."""
    fields = T.StructType([T.StructField("stats", T.ArrayType(T.DoubleType()))])
    return map_texts(docs, "text", keep, fields, lambda: lambda texts: [[document_stats(t) for t in texts]])


class Projection:
    """Standardised statistics as cosines of random directions: the inner product nears exp(-gamma |x - y|^2)."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, gamma: float = GAMMA, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, 1 / np.where(deviation > 1e-9, deviation, 1)
        self.directions = rng.normal(0, np.sqrt(2 * gamma), (len(mean), features))
        self.phase = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) * self.scale, -8, 8)
        z = np.cos(x @ self.directions + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([z, np.ones((len(x), 1))])


def _matrix(column) -> np.ndarray:
    return np.array(list(column), dtype=np.float64).reshape(-1, N_STATS)


def _normal_equations(train: DataFrame, project: Projection, groups: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over all training rows: a sum in each partition, then in each of a few groups, then of those groups."""
    width = len(project.phase) + 1

    def one(batches):
        total = np.zeros((width, width + 1))
        for batch in batches:
            z = project(_matrix(batch["stats"]))
            total += np.hstack([z.T @ z, z.T @ batch["label"].to_numpy(np.float64)[:, None]])
        # a partition's place among the groups follows from its own sum, so a task that is run again lands in the same one
        yield pd.DataFrame({"group": [int(abs(total[0, 0]) * 1e6) % groups], "sums": [total.tobytes()]})

    def added(key, rows):
        total = np.sum([np.frombuffer(x) for x in rows["sums"]], axis=0)
        return pd.DataFrame({"group": [key[0]], "sums": [total.tobytes()]})

    schema = "group int, sums binary"
    parts = train.select("stats", "label").mapInPandas(one, schema).groupBy("group").applyInPandas(added, schema).collect()
    total = np.sum([np.frombuffer(r.sums) for r in sorted(parts)], axis=0).reshape(width, width + 1)
    return total[:, :-1], total[:, -1]


def isotonic(weight: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Non-decreasing least-squares fit to bin means, by pooling neighbours that are out of order."""
    blocks: list[list[float]] = []
    for w, m in zip(weight, mean):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, n2 = blocks.pop()
            w1, m1, n1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2])
    return np.concatenate([np.full(int(n), m) for _, m, n in blocks]) if blocks else np.zeros(0)


class QualityModel:
    """Weights and the calibration curve; a few kilobytes, so it travels in the closure."""

    def __init__(self, project: Projection | None, weights: np.ndarray | None, curve: tuple[np.ndarray, np.ndarray], prior: float) -> None:
        self.project, self.weights, self.curve, self.prior = project, weights, curve, prior

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.project(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.project is None:
            return np.full(len(stats), self.prior)
        raw = self.raw(stats)
        fitted = np.interp(raw, *self.curve) if len(self.curve[0]) else np.clip(raw, 0, 1)
        # a trace of the raw score keeps the order within the flat stretches of the curve
        return np.clip(0.998 * fitted + 0.002 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def fit_quality(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on all labelled rows outside the held-out third (crc32 of doc_id mod 3 is 1). ``stats`` has doc_id and stats.

    Labels that are null are left out; of repeated labels the largest counts. Without training rows, the score is 0.5 everywhere;
    with one class only, it is that class."""
    known = (labels.select("doc_id", F.col("quality").alias("label")).filter(F.col("label").isNotNull() & (fold("doc_id", 3) != 1))
             .groupBy("doc_id").agg(F.max("label").cast("double").alias("label")))
    rows = cut_lineage(stats.select("doc_id", "stats").join(known, "doc_id"), "quality-train")
    part, at = CALIBRATION
    inner = F.pmod(F.xxhash64("doc_id"), F.lit(part)) == at
    moments = rows.filter(~inner).agg(
        F.count(F.lit(1)).alias("n"), F.avg("label").alias("prior"),
        *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(N_STATS)],
        *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(N_STATS)]).first()
    if not moments.n:
        return QualityModel(None, None, (np.zeros(0), np.zeros(0)), 0.5)
    project = Projection(np.array([moments[f"m{i}"] for i in range(N_STATS)]), np.array([moments[f"s{i}"] for i in range(N_STATS)]))
    gram, moment = _normal_equations(rows.filter(~inner), project)
    weights = np.linalg.solve(gram + RIDGE * moments.n * np.eye(len(gram)) / len(gram), moment)
    model = QualityModel(project, weights, (np.zeros(0), np.zeros(0)), moments.prior)

    def binned(batches):
        for batch in batches:
            raw = model.raw(_matrix(batch["stats"]))
            yield pd.DataFrame({"bin": np.floor(np.clip(raw, -0.5, 1.5) * BINS).astype(np.int64), "raw": raw, "label": batch["label"]})

    bins = (rows.filter(inner).select("stats", "label").mapInPandas(binned, "bin long, raw double, label double")
            .groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("raw").alias("raw"), F.avg("label").alias("label"))
            .orderBy("bin").collect())  # at most 2 * BINS + 1 rows
    if bins:
        model.curve = (np.array([b.raw for b in bins]), isotonic(np.array([float(b.n) for b in bins]), np.array([b.label for b in bins])))
    return model


def score_quality(stats: DataFrame, model: QualityModel, keep: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` of each row with its score and whether it is ``threshold`` or more."""
    narrow = stats.select(*keep, "stats")
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for batch in batches:
            score = model.score(batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS))
            made = [pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=schema.names)

    return narrow.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Texts are read once; their statistics are staged."""
    stats = cut_lineage(text_stats(docs.select("doc_id", "text"), ["doc_id"]), "quality-stats")
    scored = score_quality(stats, fit_quality(stats, labels), ["doc_id"])
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is ``threshold`` or more, with their columns as they were.

    Fitting reads labelled texts only; the scores of all are made in the pass that filters them, so no text is shuffled."""
    ids = labels.select("doc_id").distinct()
    stats = text_stats(docs.select("doc_id", "text"), ["doc_id"]).join(ids, "doc_id", "left_semi")
    model = fit_quality(stats, labels)
    score = unused("_ww_score", docs.columns)
    fields = T.StructType([T.StructField(score, T.DoubleType())])

    def make():
        def work(texts):
            return [model.score(np.array([document_stats(t) for t in texts]).reshape(-1, N_STATS))]
        return work

    return map_texts(docs, "text", docs.columns, fields, make).filter(F.col(score) >= threshold).select(*docs.columns)
