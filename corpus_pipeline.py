"""A corpus pipeline of training-data operators; each stage's rows are the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.llm import bpe, decontaminate, jaccard, pii, toxicity
from tidelag.llm.common import read_table, staged, texts

#: Texts that travel to a Python worker at once, in its memory and in that of the JVM.
TEXTS = 1000

#: No stage can be written in SQL as a whole (a trained model, components, a codec).
ORACLE_SQL: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go.

    Rows are judged one by one: of rows with one doc_id only those with a rejected text go. Null
    and empty texts and rows without doc_id stay; an empty table gives no rows.
    """
    model = toxicity.fit(texts(docs), read_table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at 0.75 or more, the one with the smallest doc_id stays.

    Of rows with one doc_id all stay or go together. Null and empty texts are linked with nothing
    and stay, as do rows without doc_id; an empty table gives no rows.
    """
    classes = jaccard.components(docs)
    gone = staged(classes.where("component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    return docs.join(gone, docs.doc_id == gone.doc_id, "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts and rows without doc_id stay; an empty benchmark or table removes nothing.
    """
    found = staged(decontaminate.leaks(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks", batch_rows=TEXTS)
    return docs.join(found, docs.doc_id == found.doc_id, "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data gives way to its kind; no row goes, null texts stay null."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the number of tokens and a digest of the decoded text; no row goes."""
    coded = bpe.encode_column(docs, digest=True)
    return staged(coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.col("decoded").alias("text_sha256")), "stage-encoding", batch_rows=TEXTS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("personal_data", redact_personal_data),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if "staged_at" not in vars(docs):
            docs = staged(docs, f"stage-{name}")
    return docs
