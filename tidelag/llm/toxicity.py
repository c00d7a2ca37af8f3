"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

Labels are 0 or 1; the severity of a toxic document is graded 1 to ``GRADES`` by how many of
its words lean to the toxic class. One weight vector serves all ordered thresholds, and the
expected severity is the sum of the probabilities of reaching each grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.llm.common import blocks, read_table, release_memory, spent, staged, tasks_for, texts
from tidelag.llm.features import BLOCK_CHARS, first_of, labelled, word_counts, word_hashes

GRADES = 3
#: Labelled documents that words are chosen from, and those of them that weights are fitted on.
LABELLED_ROWS = 40_000
FIT_ROWS = 20_000
#: Words that the model may weigh, those that tell the classes apart best.
WORDS = 4096
#: Toxic documents a word must occur in to be weighed.
SUPPORT = 3
THRESHOLD = 0.5


@dataclass(frozen=True)
class SeverityModel:
    words: np.ndarray  # sorted 64-bit hashes
    weights: np.ndarray
    cuts: np.ndarray  # ascending

    def reach(self, doc: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        """n x grades: the probability of each grade or a higher one."""
        x = self.linear(*indicators(self.words, doc, word), n)
        return 1 / (1 + np.exp(-np.clip(x[:, None] - self.cuts[None, :], -50, 50)))

    def linear(self, doc: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(doc, self.weights[at], n) if len(at) else np.zeros(n)


def indicators(words: np.ndarray, doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, place in ``words``) of the known words, each pair once."""
    if not len(words) or not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(words, word)
    at[at == len(words)] = 0
    known = words[at] == word
    both = np.unique(doc[known].astype(np.int64) * len(words) + at[known])
    return both // len(words), both % len(words)


def fit_cumulative_link(
    doc: np.ndarray, at: np.ndarray, grade: np.ndarray, size: int, grades: int = GRADES, rounds: int = 400, ridge: float = 0.02
) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ascending thresholds by full-batch gradient steps with adapted lengths.

    Each threshold k has the logistic loss of "grade k or higher"; the weights are shared.
    """
    n, reach = len(grade), grade[:, None] >= np.arange(1, grades + 1)
    w, b = np.zeros(size), np.log((n + 1.0) / (reach.sum(0) + 1.0))
    m = [np.zeros(size), np.zeros(grades)]
    v = [np.zeros(size), np.zeros(grades)]
    for t in range(1, rounds + 1):
        x = np.bincount(doc, w[at], n) if len(at) else np.zeros(n)
        error = 1 / (1 + np.exp(-np.clip(x[:, None] - b[None, :], -50, 50))) - reach
        slope = [np.bincount(at, error.sum(1)[doc], size) + ridge * w if len(at) else ridge * w, -error.sum(0)]
        for k, (value, g) in enumerate(zip((w, b), slope, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            value -= 0.05 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        b[:] = np.maximum.accumulate(b)
    return w, b


def select_words(counts: DataFrame, n_positive: int, n_negative: int, most: int) -> pd.DataFrame:
    """The ``most`` words that lean to the toxic class with the largest chi-square."""
    total = n_positive + n_negative
    a, b = F.col("positive").cast("double"), F.col("negative").cast("double")
    c, d = F.lit(float(n_positive)) - a, F.lit(float(n_negative)) - b
    lean = F.log((a + 0.5) / (n_positive + 1.0)) - F.log((b + 0.5) / (n_negative + 1.0))
    chi = total * F.pow(a * d - b * c, 2) / ((a + b) * (c + d) * n_positive * n_negative + 1.0)
    rows = counts.where(F.col("positive") >= SUPPORT).select("word", lean.alias("lean"), chi.alias("chi"))
    return rows.where("lean > 1 and chi > 10").orderBy(F.desc("chi"), "word").limit(most).toPandas()


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, most_words: int = WORDS) -> SeverityModel:
    """Learn from ``labels.toxic``; without toxic labels nothing is toxic."""
    # the labelled texts, of a bounded number, are read once
    rows = staged(labelled(docs, labels, "toxic", max(LABELLED_ROWS, fit_rows)).select("doc_id", "text", "label"), "toxicity-rows")
    sizes = {r.label > 0: r["count"] for r in rows.groupBy((F.col("label") > 0).cast("int").alias("label")).count().collect()}
    positive, negative = sizes.get(True, 0), sizes.get(False, 0)
    if not positive or not negative:
        return SeverityModel(np.zeros(0, np.uint64), np.zeros(0), np.arange(5.0, 5.0 + GRADES))
    chosen = select_words(word_counts(rows, tasks_for(docs.sparkSession)), positive, negative, most_words)
    words = np.sort(chosen.word.to_numpy(np.int64).view(np.uint64))

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in blocks(all_texts := batch.text.tolist(), BLOCK_CHARS):
                chunk = all_texts[part]
                doc, at = indicators(words, *word_hashes(chunk))
                ends = np.searchsorted(doc, np.arange(len(chunk) + 1))
                yield pd.DataFrame({"doc_id": batch.doc_id.iloc[part], "label": batch.label.iloc[part], "found": [at[i:j].astype("<i4").tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]})

    fitted = first_of(rows, fit_rows).mapInPandas(featurise, "doc_id long, label int, found binary").collect()
    spent(rows)
    fitted.sort(key=lambda r: r.doc_id)
    found = [np.frombuffer(r.found, "<i4").astype(np.int64) for r in fitted]
    grade = np.array([min(GRADES, max(1, len(f))) if r.label > 0 else 0 for r, f in zip(fitted, found, strict=True)])
    doc = np.repeat(np.arange(len(found)), [len(f) for f in found])
    weights, cuts = fit_cumulative_link(doc, np.concatenate(found) if found else np.zeros(0, np.int64), grade, len(words))
    return SeverityModel(words, weights, cuts)


def score(docs: DataFrame, model: SeverityModel) -> DataFrame:
    """doc_id, expected_severity, p_toxic, grade, toxic for every document.

    Null and empty texts have no word that counts; equal texts score the same; repeated rows are
    scored each; an empty table gives no rows; columns other than doc_id and text are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in blocks(all_texts := batch.text.tolist(), BLOCK_CHARS):
                chunk = all_texts[part]
                reach = model.reach(*word_hashes(chunk), len(chunk))
                yield pd.DataFrame({
                    "doc_id": batch.doc_id.iloc[part], "expected_severity": reach.sum(1), "p_toxic": reach[:, 0],
                    "grade": (reach >= 0.5).sum(1), "toxic": (reach[:, 0] >= THRESHOLD).astype(int),
                })
            release_memory()

    return docs.mapInPandas(run, "doc_id long, expected_severity double, p_toxic double, grade int, toxic int")


def without_toxic(docs: DataFrame, model: SeverityModel) -> DataFrame:
    """``docs`` without the rows whose text the model finds toxic, judged row by row where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_texts = [t or "" for t in batch.column("text").to_pylist()]
            toxic = np.zeros(len(all_texts), bool)
            for part in blocks(all_texts, BLOCK_CHARS):
                chunk = all_texts[part]
                toxic[part] = model.reach(*word_hashes(chunk), len(chunk))[:, 0] >= THRESHOLD
            yield batch.filter(pa.array(~toxic))
            release_memory()

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(read_table(spark, sf_dir, "documents"))
    return score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
