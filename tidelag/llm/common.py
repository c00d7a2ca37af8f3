"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidelag.sources.shared import new_path

#: Word characters of every word-based operator: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Whether Spark deletes the shuffle files of a statement when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that travel to a Python worker at once, in its memory and in that of the JVM.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
_UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """The two columns that the operators read; a null text counts as empty.

    Rows without a doc_id name no document and are left out.
    """
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where(F.col("doc_id").isNotNull())


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's own settings hold again after."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def staged(df: DataFrame, name: str, partition_by: str | None = None, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, which cuts its lineage; its shuffles are
    deleted. At most ``batch_rows`` go to a Python worker at once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    given = int(spark.conf.get(BATCH))
    rows = batch_rows and min(batch_rows, given if given > 0 else batch_rows)
    with settings(spark, {CLEANUP: "true"} | ({BATCH: str(rows)} if rows else {})):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def staged_and_seen(df: DataFrame, name: str, batch_rows: int | None = None, **figures: F.Column) -> tuple[DataFrame, dict]:
    """``staged``, with aggregates of the rows that are observed as they are written, so that no job counts them after."""
    seen = Observation()
    table = staged(df.observe(seen, *(c.alias(k) for k, c in figures.items())), name, batch_rows=batch_rows)
    return table, seen.get


def spent(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: what was made of them is written."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(text: str) -> str:
    """Lower-case A-Z only."""
    return text.lower() if text.isascii() else text.translate(_UPPER_TO_LOWER)


def words_of(text: str) -> list[str]:
    """Lower-cased words, split at ASCII white space only."""
    text = lower_ascii(text)
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    return lower_split(text)


def lower_split(text: str) -> list[str]:
    for c in "\t\n\x0b\x0c\r":
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


class Numbers(dict):
    """Numbers new keys as they are asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = i = len(self)
        return i


def blocks(all_texts: list[str], chars: int) -> Iterator[slice]:
    """Runs of whole texts of about ``chars`` characters; a longer text is a run by itself."""
    start, held = 0, 0
    for i, text in enumerate(all_texts):
        if held and held + len(text) > chars:
            yield slice(start, i)
            start, held = i, 0
        held += len(text)
    if start < len(all_texts):
        yield slice(start, len(all_texts))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


@cache
def drawn(seed: bytes) -> tuple[np.ndarray, np.uint64]:
    """Random values of the bytes (A-Z count as a-z) and a random odd factor, from a seed that each run draws."""
    rng = np.random.default_rng(np.frombuffer(seed, np.uint64))
    values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    return values, np.uint64(int(rng.integers(0, 1 << 61)) * 8 + 5)


def place_values(n: int, factor: np.uint64) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(0, n - 1), factor)])


def hashed_words(all_texts: list[str], seed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the lower-cased words of all texts in order, number of words of each text).

    Words are what stands between ASCII white space. All bytes are hashed at once: a word is a
    number whose figures are random values of its bytes, mixed with its length. Values and place
    value come from the seed, so that no text can be made beforehand whose words look like others.
    """
    values, factor = drawn(seed)
    raw = [t.encode("utf-8", "surrogatepass") for t in all_texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    blank = _BLANK[data]
    first = ~blank & np.r_[True, blank[:-1]]
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    size = np.flatnonzero(blank & np.r_[False, ~blank[:-1]]) - start
    inside = np.flatnonzero(~blank)
    ends = np.cumsum(size)
    offset = np.arange(len(inside)) - np.repeat(ends - size, size)
    figures = values[data[inside]] * place_values(int(size.max()), factor)[offset]
    hashes = mix64(np.add.reduceat(figures, ends - size) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    borders = np.cumsum([len(r) + 1 for r in raw])
    return hashes, np.diff(np.searchsorted(start, borders), prepend=0)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length-1 of every run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def small(counts: np.ndarray) -> bytes:
    """One byte for each count under 255; larger ones follow in full."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def large(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data[:n], np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data[n:], "<i8")
    return counts


def planes(numbers: np.ndarray, dtype: str = "<i8") -> bytes:
    """All first bytes, then all second ones and so on, which compresses well where numbers are alike."""
    whole = np.ascontiguousarray(numbers, dtype)
    return whole.view(np.uint8).reshape(len(whole), whole.itemsize).T.tobytes()


def from_planes(data: bytes, dtype: str = "<i8") -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def release_memory() -> None:
    """Give freed memory back to the system: workers are used again by later tasks, and an
    executor's Python processes share one limit with its heap."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tasks_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b): the smallest reachable node.

    Labels spread along the edges and are then replaced by their own labels (pointer
    jumping), so the number of rounds grows with the logarithm of the longest chain. Each
    round is written to the shared folder. No edges: no rows.
    """
    both = staged(
        edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
        .union(edges.select(F.col("b").cast("long"), F.col("a").cast("long")))
        .where("a <> b").distinct(), "edges",
    )
    total = F.sum(F.col("component").cast("decimal(28,0)"))
    labels, held = staged_and_seen(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels", total=total
    )
    while True:
        heard = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .select(F.col("a").alias("node"), "component")
            .union(labels)
            .groupBy("node").agg(F.min("component").alias("component"))
        )
        jump = heard.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new, now = staged_and_seen(
            heard.join(jump, "component", "left")
            .select("node", F.coalesce("further", "component").alias("component")), "labels", total=total
        )
        spent(labels)
        if now == held:  # labels never grow, so an equal sum means equal labels
            spent(both)
            return new
        labels, held = new, now
