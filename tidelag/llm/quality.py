"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by class log-count ratios.

Counts behind the ratios come from at most ``LABELLED_ROWS`` labelled documents; the linear
model is fitted by dual coordinate descent on at most ``FIT_ROWS`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.llm.common import blocks, read_table, release_memory, spent, staged, texts
from tidelag.llm.features import BLOCK_CHARS, class_counts, first_of, labelled, ngram_indicators, remainder5

BITS = 18
LABELLED_ROWS = 20_000
FIT_ROWS = 4000
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # ratio times fitted weight, by feature
    bias: float
    slope: float
    offset: float

    def scores(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        counts = np.maximum(1, np.bincount(doc, minlength=n))
        margin = np.bincount(doc, self.weights[feature], n) / np.sqrt(counts) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -50, 50)))


def log_count_ratios(negative: np.ndarray, positive: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p, q = positive + alpha, negative + alpha
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(
    rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray, epochs: int = 12, seed: int = 7
) -> np.ndarray:
    """Weights (the last one is the bias) of the L2-regularised hinge loss; y is +1 or -1."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, value = rows[i]
            gradient = y[i] * (w[at] @ value + w[-1]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if step := new - alpha[i]:
                alpha[i] = new
                w[at] += step * y[i] * value
                w[-1] += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def fit_sigmoid(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of P(label 1) by Newton steps, with Platt's smoothed targets."""
    n1, n0 = float((y > 0).sum()), float((y <= 0).sum())
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, np.log((n1 + 1) / (n0 + 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -5, 5)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, fit_rows: int = FIT_ROWS) -> QualityModel:
    """Learn from ``labels.quality``; without labels of both kinds every score is the share of ones."""
    # the labelled texts, of a bounded number, are read once
    rows = staged(labelled(docs, labels, "quality", max(LABELLED_ROWS, fit_rows)).select("doc_id", "text", "label"), "quality-rows")
    negative, positive = class_counts(rows, bits)
    ratio = log_count_ratios(negative, positive)

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in blocks(all_texts := batch.text.tolist(), BLOCK_CHARS):
                chunk = all_texts[part]
                doc, feature = ngram_indicators(chunk, bits)
                ends = np.searchsorted(doc, np.arange(len(chunk) + 1))
                found = [feature[i:j].astype("<i4").tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
                yield pd.DataFrame({"doc_id": batch.doc_id.iloc[part], "label": batch.label.iloc[part], "features": found})

    fitted = first_of(rows, fit_rows).mapInPandas(featurise, "doc_id long, label int, features binary").collect()
    spent(rows)
    fitted.sort(key=lambda r: r.doc_id)
    order = np.random.default_rng(11).permutation(len(fitted))
    y = np.array([1.0 if fitted[i].label > 0 else -1.0 for i in order])
    if len(set(y)) < 2:
        share = (float((y > 0).sum()) + 1) / (len(y) + 1) if len(y) else 0.5
        return QualityModel(np.zeros(1 << bits), 0.0, 1.0, float(np.log(share / max(1e-9, 1 - share)) if share < 1 else 20.0))
    sparse = []
    for i in order:
        at = np.frombuffer(fitted[i].features, "<i4").astype(np.int64)
        sparse.append((at, ratio[at] / np.sqrt(max(1, len(at)))))
    cut = max(2, len(sparse) * 3 // 4)
    cost = np.where(y > 0, 1.0, (y > 0).sum() / max(1, (y <= 0).sum()))
    w = dual_coordinate_descent(sparse[:cut], y[:cut], 1 << bits, cost)
    held = slice(cut, None) if len(set(y[cut:])) == 2 else slice(0, None)
    margin = np.array([w[at] @ v + w[-1] for at, v in sparse[held]])
    slope, offset = fit_sigmoid(margin, y[held])
    return QualityModel(ratio * w[:-1], float(w[-1]), slope, offset)


def score(docs: DataFrame, model: QualityModel, bits: int = BITS) -> DataFrame:
    """doc_id, score: the probability that a document is of label 1.

    Null and empty texts score by the bias alone; equal texts score the same; columns other
    than doc_id and text are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in blocks(all_texts := batch.text.tolist(), BLOCK_CHARS):
                chunk = all_texts[part]
                doc, feature = ngram_indicators(chunk, bits)
                yield pd.DataFrame({"doc_id": batch.doc_id.iloc[part], "score": model.scores(doc, feature, len(chunk))})
            release_memory()

    return docs.mapInPandas(run, "doc_id long, score double")


def op2_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(read_table(spark, sf_dir, "documents"))
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", (remainder5() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
