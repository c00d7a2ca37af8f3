"""Mixing sources to target weights by Pareto order sampling.

A document is taken a certain number of times whole, the whole part of its expected copies; the
fractional part is its inclusion probability in one more draw. In that draw documents are ranked by
their random odds divided by their inclusion odds, and the first of each source are taken until the
words that the source still lacks are reached, so that a sample's size in words is fixed.

Ranks are counted, not sorted: each source's ranks fall into numbered shares of about
``SHARE_ROWS`` documents, whose words are summed; shares before the last word are taken whole, and
only documents of the share in which it falls are put in order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelag.llm.common import WORD, read_table, staged

WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of the documents, and the most times that a source is used.
SHARE, MOST = 1.5, 2
#: Documents of a source that are put in order together, about.
SHARE_ROWS = 2000


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, odds): number of words, and random odds that depend on the row alone."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    u = (F.expr(f"shiftrightunsigned(xxhash64({int(seed)}L, doc_id, source, text), 11)").cast("double") + 0.5) / float(1 << 53)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text"))
    return rows.select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), (u / (1 - u)).alias("odds"))


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n, w): sources by code point, the one without a name last, weighted in turn."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ordered = sums.orderBy(F.asc_nulls_last("source")).rdd.zipWithIndex()
    rows = ordered.map(lambda x: (x[0].source, x[0].source_size, x[0].n, WEIGHTS[x[1] % len(WEIGHTS)]))
    return sizes.sparkSession.createDataFrame(rows, "source string, source_size long, n long, w int")


def with_targets(sources: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``target``: the share of all words by weight, at most ``most`` times the source's own.

    The level, words for each unit of weight, rises until what capped sources leave is given to
    the others; only its sums leave the executors.
    """
    cap = F.col("source_size") * most
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        full = cap <= level * F.col("w")
        found = sources.agg(F.count_if(full).alias("n"), F.sum(F.when(full, cap).otherwise(0)).alias("words"), F.sum(F.when(~full, F.col("w")).otherwise(0)).alias("w")).first()
        if not found.w or found.n == capped:
            break
        level, capped = (total - found.words) / found.w, found.n
    return sources.withColumn("target", F.least(cap.cast("double"), level * F.col("w")))


def expected(sources: DataFrame) -> DataFrame:
    """``copies`` taken of every document, and ``left``, the words that the draw adds."""
    size = F.col("source_size")
    copies = F.when(size > 0, F.floor(F.try_divide("target", size))).otherwise(0)
    return sources.withColumn("copies", copies.cast("long")).withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * size))


def ranked(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with a source's figures, the rank q (random odds over inclusion odds), and its share of the ranks."""
    p = F.try_divide("left", "source_size")
    named = sources.withColumnRenamed("source", "_source")
    rows = sizes.join(named, sizes.source.eqNullSafe(F.col("_source")), "left").drop("_source")
    # a document with no chance comes last, whatever its odds
    rows = rows.withColumn("q", F.when(p > 0, F.try_divide(F.col("odds") * (1 - p), p)).otherwise(F.lit(float("inf"))))
    shares = F.ceil(F.col("n") / SHARE_ROWS)
    return rows.withColumn("share", F.when(p > 0, F.least(shares - 1, F.floor(shares * F.col("q") / (1 + F.col("q"))))).otherwise(shares).cast("long"))


def fill(group: pd.DataFrame) -> pd.DataFrame:
    """Of one source's last share: in order of rank, what still fits is taken; at the end the
    smallest of the others, if that comes nearer."""
    group = group.sort_values(["q", "doc_id", "size"], kind="stable")
    left, taken = float(group.gap.iloc[0]), []
    for size in group["size"].tolist():
        taken.append(0 < size <= left)
        left -= size if taken[-1] else 0
    others = [(size, i) for i, (size, t) in enumerate(zip(group["size"].tolist(), taken, strict=True)) if size and not t]
    if others and abs(min(others)[0] - left) < left:
        taken[min(others)[1]] = True
    return pd.DataFrame({"doc_id": group.doc_id, "size": group["size"], "source_size": group.source_size, "target": group.target, "copies": group.copies + pd.Series(taken, index=group.index)})


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row.

    Null and empty texts have no words and are never drawn; rows without a source are one source,
    the last; ranks depend on seed, doc_id, source and text, so reruns agree and repeated rows
    have equal ranks; rows with null doc_id are sampled like others; an empty table gives no rows;
    columns other than doc_id, source and text are not read.
    """
    sizes = staged(sized(docs, seed), "mix-sizes")
    sources = staged(expected(with_targets(staged(numbered_sources(sizes), "mix-sources"))), "mix-targets")
    rows = ranked(sizes, sources)
    words = rows.groupBy("source", "share").agg(F.sum("size").alias("words"), F.max("left").alias("left"))
    earlier = Window.partitionBy("source").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    sums = words.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    cut = sums.where("before <= left and before + words > left").select(F.col("source").alias("_source"), F.col("share").alias("cut"), (F.col("left") - F.col("before")).alias("gap"))
    cut = staged(cut, "mix-cuts")
    marked = rows.join(cut, rows.source.eqNullSafe(F.col("_source")), "left")
    out = ["doc_id", "size", "source_size", "target"]
    settled = marked.where("cut is null or share <> cut").select(*out, (F.col("copies") + F.when((F.col("share") < F.col("cut")) & (F.col("size") > 0), 1).otherwise(0)).alias("copies"))
    last = marked.where("share = cut").select("source", "doc_id", "size", "source_size", "target", "copies", "q", "gap")
    filled = last.groupBy("source").applyInPandas(fill, "doc_id long, size long, source_size long, target double, copies long")
    return settled.unionByName(filled).select(*out, (F.col("size") * F.col("copies")).alias("taken"))


def op13_pareto_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))
