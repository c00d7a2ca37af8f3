"""Hard negatives by secondary sort: pair scores in order by (anchor, descending score, id).

Anchors meet all rows in blocks. A block of rows keeps, for each anchor, its own first positives;
these are merged, and in a second pass over the blocks each one keeps the first negatives of every
window that a positive opens, since no later one of the block can be among the first overall.
What is left is packed into keys whose bytes sort as (anchor, descending score, kind, id), dealt and
sorted by ``repartitionAndSortWithinPartitions``; an iterator over the sorted keys opens a window
at each positive and emits the negatives that fall into open windows. It holds the windows of one
anchor, never the rows of an anchor.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelag.llm.common import read_table, release_memory, staged

#: Rows of a block, and anchors that are compared with it at once.
BLOCK_ROWS = 8192
BLOCK_ANCHORS = 512
POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these hundredths of its positive's.
LOW, HIGH = 30, 90
_TOP = 1 << 63
POSITIVE, NEGATIVE = 0, 1


def taking_part(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of rows with a label and only finite components; every seventh label is moved on by one."""
    component = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    label = F.col("label").cast("long")
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~component)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), "embedding")


def anchors_of(rows: DataFrame, every: int) -> DataFrame:
    """One row for each vec_id that ``every`` divides: of several the one with the least label, then vector."""
    return rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding")


def whole(vectors: pd.Series) -> np.ndarray:
    """floor(256 x) of each component."""
    return np.floor(np.stack(vectors.to_list()).astype(np.float64) * 256.0)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; an error where they do not fit 64 bits."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    as_ints = lambda x: np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
    return (as_ints(a) @ as_ints(b).T).astype(np.int64)


def first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by descending score, then id."""
    if len(score) > 4 * k:  # all that reach the k-th largest score
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], -score[near]))[:k]]


def met(rows: DataFrame, anchors: DataFrame, cells: int) -> DataFrame:
    """Rows dealt to cells, with all anchors, in blocks, behind the rows of each cell."""
    own = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(cells)).cast("int")
    dealt = rows.select(own.alias("cell"), F.lit(0).alias("kind"), "vec_id", "label", "embedding", F.lit(None).cast("array<long>").alias("windows"))
    sent = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.lit(1).alias("kind"), "vec_id", "label", "embedding", "windows")
    return dealt.union(sent).repartition(cells, "cell").sortWithinPartitions("cell", "kind", "vec_id")


def by_cell(compare, columns: list[str]):
    """Hold a cell's rows, then pass its anchors to ``compare`` in blocks of one dimension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, parts, held = None, [], {}
        for batch in batches:
            for (at, kind), rows in batch.groupby(["cell", "kind"], sort=False):
                if at != cell:
                    cell, parts, held = at, [], {}
                if kind == 0:
                    parts.append(rows)
                    continue
                if parts:
                    together = pd.concat(parts, ignore_index=True)
                    held = {n: (x.vec_id.to_numpy(), x.label.to_numpy(), whole(x.embedding)) for n, x in together.groupby(together.embedding.map(len))}
                    parts = []
                for n, same in rows.groupby(rows.embedding.map(len)):
                    if n not in held:
                        continue
                    for i in range(0, len(same), BLOCK_ANCHORS):
                        block = same.iloc[i : i + BLOCK_ANCHORS]
                        ids, labels, vectors = held[n]
                        found = [x for a, s in zip(block.itertuples(index=False), scores(whole(block.embedding), vectors), strict=True) for x in compare(a, s, ids, labels)]
                        if found:
                            yield pd.DataFrame(found, columns=columns)
        release_memory()

    return run


def first_positives(a, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Iterator[tuple]:
    own = np.flatnonzero((labels == a.label) & (ids != a.vec_id))
    for i in own[first(score[own], ids[own], POSITIVES)].tolist():
        yield a.vec_id, -int(score[i]), int(ids[i])


def first_negatives(a, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Iterator[tuple]:
    own = np.flatnonzero((labels != a.label) & (ids != a.vec_id))
    s, wanted = score[own], set()
    for p in {int(w) for w in a.windows}:
        inside = np.flatnonzero((s >= -(-LOW * p // 100)) & (s <= HIGH * p // 100))
        wanted.update(own[inside[first(s[inside], ids[own[inside]], NEGATIVES)]].tolist())
    for i in wanted:
        yield a.vec_id, -int(score[i]), int(ids[i])


def key(anchor: int, falling: int, kind: int, vec_id: int) -> bytes:
    """Bytes that sort as the four numbers do."""
    return struct.pack(">QQBQ", anchor + _TOP, falling + _TOP, kind, vec_id + _TOP)


def unpacked(packed: bytes) -> tuple[int, int, int, int]:
    anchor, falling, kind, vec_id = struct.unpack(">QQBQ", packed)
    return anchor - _TOP, _TOP - falling, kind, vec_id - _TOP


def emitted(keys: Iterator[tuple[bytes, None]]) -> Iterator[tuple]:
    """(anchor, positive, rank, negative, scores of both) from keys in order."""
    anchor, windows = None, []
    for packed, _ in keys:
        a, score, kind, vec_id = unpacked(packed)
        if a != anchor:
            anchor, windows = a, []
        if kind == POSITIVE:
            windows.append([vec_id, score, 0])
            continue
        for w in windows:
            if w[2] < NEGATIVES and LOW * w[1] <= 100 * score <= HIGH * w[1]:
                w[2] += 1
                yield a, w[0], w[2], vec_id, w[1], score


def mine(vectors: DataFrame, every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows without vec_id, label or vector, or with a component that is null or not finite, take no
    part. Ties go by vec_id. A repeated row counts as often as it occurs; of rows that share an
    anchor's vec_id one is the anchor, and none is its partner. Vectors of other lengths than the
    anchor's have no score with it; empty ones score 0. A score beyond 64 bits is an error. An
    empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = staged(taking_part(vectors), "negatives-rows")
    cells = max(spark.sparkContext.defaultParallelism, -(-rows.count() // BLOCK_ROWS))
    anchors = staged(anchors_of(rows, every), "negatives-anchors")
    found = met(rows, anchors.withColumn("windows", F.lit(None).cast("array<long>")), cells).mapInPandas(by_cell(first_positives, ["anchor", "falling", "vec_id"]), "anchor long, falling long, vec_id long")
    place = F.row_number().over(Window.partitionBy("anchor").orderBy("falling", "vec_id"))
    best = staged(found.withColumn("place", place).where(F.col("place") <= POSITIVES).drop("place"), "negatives-positives")
    asked = anchors.join(best.groupBy(F.col("anchor").alias("vec_id")).agg(F.collect_list(-F.col("falling")).alias("windows")), "vec_id")
    inside = met(rows, asked, cells).mapInPandas(by_cell(first_negatives, ["anchor", "falling", "vec_id"]), "anchor long, falling long, vec_id long")
    pairs = best.select("anchor", "falling", F.lit(POSITIVE).alias("kind"), "vec_id").union(inside.select("anchor", "falling", F.lit(NEGATIVE), "vec_id"))
    keys = pairs.rdd.map(lambda r: (key(*r), None))
    ordered = keys.repartitionAndSortWithinPartitions(cells, lambda k: crc32(k[:8]))
    return spark.createDataFrame(ordered.mapPartitions(emitted), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(read_table(spark, sf_dir, "embeddings"))
