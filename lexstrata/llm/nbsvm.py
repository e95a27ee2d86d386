"""Quality classifier: Naive Bayes support vectors.

A text's n-gram indicators are scaled by the log-count ratios of the classes,
set to unit length, and a linear hinge-loss model is fitted to them by dual
coordinate descent.  A logistic curve, fitted on a part of the sample that the
model then hasn't seen, turns margins into scores.

The model is fitted on the driver from at most ``sample_rows`` labelled texts
(features only, hashed on the executors); scoring runs over Arrow batches.

Cases: null and empty texts have no n-grams and get the score of the bare
bias; rows that repeat an id are each scored; without labels of both classes
the score is 0.5 everywhere; extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.labelled import BITS, SAMPLE_ROWS, binary_rows, distinct, in_fold, labelled_sample, platt, sigmoid, word_and_shape_grams
from lexstrata.llm.memory import tidy
from lexstrata.llm.wordspans import PLAIN_WORDS, text_blocks

SMOOTHING = 1.0
COST = 1.0
EPOCHS = 30


@dataclass
class Model:
    ratio: np.ndarray  # log-count ratio of each bucket
    weight: np.ndarray  # over scaled features; the last one is the bias
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, text: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        r = self.ratio[bucket]
        norm = np.sqrt(np.bincount(text, r * r, n))
        return np.bincount(text, r * self.weight[bucket], n) / np.maximum(norm, 1e-12) + self.weight[-1]

    def scores(self, text: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        return sigmoid(self.slope * self.margins(text, bucket, n) + self.shift)


def log_count_ratios(rows: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """log(p / |p|) - log(q / |q|) with smoothed counts of texts that have a bucket."""
    count = [np.bincount(np.concatenate([np.zeros(0, np.int64), *(r for r, y in zip(rows, label, strict=True) if y == k)]), minlength=1 << BITS) + SMOOTHING for k in (0, 1)]
    return np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, cost: np.ndarray, size: int, epochs: int = EPOCHS, seed: int = 1) -> np.ndarray:
    """The weights of min |w|^2 / 2 + sum cost * max(0, 1 - sign * w.x), bias as a last feature of 1."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    diagonal = np.array([float(v @ v) + 1 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)).tolist():
            r, v, y = rows[i], values[i], sign[i]
            g = y * (float(w[r] @ v) + w[-1]) - 1
            new = min(max(alpha[i] - g / diagonal[i], 0.0), cost[i])
            step = (new - alpha[i]) * y
            if step:
                w[r] += step * v
                w[-1] += step
                most = max(most, abs(step))
                alpha[i] = new
        if most < 1e-4:
            break
    return w


def fit(rows: list[np.ndarray], label: np.ndarray) -> Model:
    """Fit on all rows; the logistic curve comes from margins of four held-out parts."""
    if len(set(label.tolist())) < 2:
        return Model(np.zeros(1 << BITS), np.zeros((1 << BITS) + 1))

    def fitted(keep: np.ndarray) -> Model:
        some, y = [rows[i] for i in keep], label[keep]
        ratio = log_count_ratios(some, y)
        values = [(v := ratio[r]) / max(float(np.sqrt(v @ v)), 1e-12) for r in some]
        cost = np.where(y == 1, COST * len(y) / (2 * max(1, y.sum())), COST * len(y) / (2 * max(1, (1 - y).sum())))
        return Model(ratio, dual_coordinate_descent(some, values, np.where(y == 1, 1.0, -1.0), cost, 1 << BITS))

    part, margin = np.arange(len(rows)) % 4, np.zeros(len(rows))
    for k in range(4):
        out = np.flatnonzero(part == k)
        if len(set(label[part != k].tolist())) < 2:
            continue
        model = fitted(np.flatnonzero(part != k))
        margin[out] = model.margins(np.repeat(np.arange(len(out)), [len(rows[i]) for i in out]), np.concatenate([np.zeros(0, np.int64), *(rows[i] for i in out)]).astype(np.int64), len(out))
    model = fitted(np.arange(len(rows)))
    model.slope, model.shift = platt(margin, label)
    return model


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, held_out: bool = True) -> Model:
    found = binary_rows(labelled_sample(documents, labels, "quality", sample_rows, held_out)).collect()
    found.sort(key=lambda r: (bytes(r["features"]), r["label"]))  # the same model whatever the order of tasks
    order = np.random.default_rng(7).permutation(len(found))
    rows = [np.frombuffer(found[i]["features"], "<i4") for i in order]
    return fit(rows, np.array([int(found[i]["label"] > 0) for i in order]))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""
    small = Model(model.ratio.astype(np.float32), model.weight.astype(np.float32), model.slope, model.shift)

    def scored(batches):
        for b in batches:
            parts = [small.scores(*distinct(word_and_shape_grams, block), len(block)) for block in text_blocks(b.column("text"), PLAIN_WORDS)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())], names=["doc_id", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(scored), "doc_id long, score double")


def classify(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    scores = score(documents, train(documents, labels, sample_rows))
    return scores.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
