"""Merkle manifest of a dataset: a leaf for each row, a tree for each language, a root over all.

1. Bitmaps say where a leaf stands. The doc_ids of each tree become 64-bit words, of which only
   those with a bit set are kept; tasks or their bits together, and a directory of popcounts in
   four storeys of at most 32,768 entries each gives the number of leaves before a word. A row
   asks its word for its rank, so no tree is sorted and no task sees a whole tree.
2. Leaves go to slots: blocks of ``2**SLOT_BITS`` neighbours, keyed by tree and number. A block
   reduces as many levels at once, its result is one slot of the next round, until one is left.
3. On the way down each block hands its slots the siblings above them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelag.llm.common import read_table, staged

#: A block of slots holds two to this power, and reduces so many levels.
SLOT_BITS = 9
#: Bits of a word's number that each storey of the directory resolves, from the words up.
STOREYS = (14, 15, 15)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: F.Column) -> F.Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**instead: F.Column) -> F.Column:
    """Digest of a row, with some of its fields replaced."""
    return F.sha2(F.concat(*(field(instead.get(c, F.col(c))) for c in FIELDS)).cast("binary"), 256)


def tampered() -> F.Column:
    """n_chars, one larger where 7 divides the crc32 of doc_id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    chars = F.col("n_chars").cast("decimal(20,0)")
    return F.when(hit, chars + 1).otherwise(chars)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, seen): ``seen`` is the leaf of the row as it looks after tampering.

    ``tree`` is the language behind an equals sign; rows without one have a hyphen, which sorts
    before it.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("leaf"), leaf(n_chars=tampered()).alias("seen"))


def directory(rows: DataFrame) -> DataFrame:
    """(tree, word, bits, again, before): the words of each tree's bitmap, and how many rows stand before each.

    ``again`` lists the bits of doc_ids that several rows of the tree share, with their number.
    """
    ids = rows.where("doc_id is not null").groupBy("tree", F.shiftright("doc_id", 6).alias("word"), F.col("doc_id").bitwiseAND(63).cast("int").alias("bit")).agg(F.count("*").alias("times"))
    repeats = F.collect_list(F.when(F.col("times") > 1, F.struct("bit", "times")))
    words = ids.groupBy("tree", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.sum("times").alias("rows"), repeats.alias("again"))
    words = staged(words, "manifest-words")
    found, storey, at = words, words.select("tree", F.col("word").alias("at"), "rows"), 0
    before = []
    for k, bits in enumerate((*STOREYS, 0)):
        up = F.shiftright("at", bits) if bits else F.lit(0).cast("long")
        earlier = Window.partitionBy("tree", "up").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        counted = storey.withColumn("up", up).select("tree", "at", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias(f"before{k}"))
        found = found.withColumn("at", F.shiftright("word", at)).join(counted, ["tree", "at"])
        before.append(F.col(f"before{k}"))
        storey = storey.groupBy("tree", up.alias("at")).agg(F.sum("rows").alias("rows"))
        at += bits
    return found.select("tree", "word", "bits", "again", sum(before).alias("before"))


def ties(rows: DataFrame) -> DataFrame:
    """``pos`` moved on by the rows of the same doc_id with a smaller leaf.

    Rows without a doc_id can be many, so those before are counted by the first four figures of
    the leaf, and only rows that agree in them are ordered together.
    """
    rows = rows.withColumn("head", F.substring("leaf", 1, 4))
    key = ["tree", "doc_id"]
    heads = rows.groupBy(*key, "head").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*key).orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*(F.col(c).alias(f"_{c}") for c in (*key, "head")), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"))
    joined = rows.join(heads, (F.col("tree") == F.col("_tree")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("head") == F.col("_head")))
    inside = F.row_number().over(Window.partitionBy(*key, "head").orderBy("leaf", "seen")) - 1
    return joined.withColumn("pos", F.col("pos") + F.col("n") + inside).select("tree", "doc_id", "leaf", "seen", "pos")


def coordinates(rows: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, seen, pos, total): the place of each leaf in its tree, from 0.

    Rows without a doc_id come first; among rows of one doc_id the smaller leaf comes first.
    """
    sizes = rows.groupBy("tree").agg(F.count("*").alias("total"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    below = F.bit_count(F.expr("bits & ~shiftleft(-1L, bit)")) + F.expr("aggregate(filter(again, x -> x.bit < bit), 0L, (s, x) -> s + x.times - 1)")
    asked = rows.withColumns({"word": F.shiftright("doc_id", 6), "bit": F.col("doc_id").bitwiseAND(63).cast("int")})
    placed = asked.join(directory(rows), ["tree", "word"], "left").join(sizes, "tree").select(
        "tree", "doc_id", "leaf", "seen", "total",
        F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("nulls") + F.col("before") + below).alias("pos"),
        F.coalesce(F.expr("doc_id is null or exists(again, x -> x.bit = bit)"), F.lit(True)).alias("tied"),
    )
    placed = staged(placed, "manifest-places")
    tied = ties(placed.where("tied")).join(placed.where("tied").select("tree", "total").distinct(), "tree")
    columns = ["tree", "doc_id", "leaf", "seen", "pos", "total"]
    if not placed.where("tied").limit(1).count():
        return placed.select(*columns)
    return placed.where("not tied").select(*columns).unionByName(tied.select(*columns))


def h(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def height(total: int, slot_bits: int) -> int:
    """Levels that a block of a tree with ``total`` nodes reduces: all that are left, if there is no other block."""
    return min(slot_bits, (total - 1).bit_length())


def levels(digests: list[str], total: int, slot_bits: int) -> list[list[str]]:
    """The block's nodes, level by level, down to its result."""
    out = [list(digests)]
    for _ in range(height(total, slot_bits)):
        last = out[-1]
        out.append([h(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return out


def siblings(tree: list[list[str]], slot: int) -> list[tuple[str, str]]:
    """(side, digest) of what stands beside a slot on each level; no digest where nothing does."""
    out = []
    for nodes in tree[:-1]:
        beside = slot ^ 1
        out.append(("<" if slot & 1 else ">", nodes[beside]) if beside < len(nodes) else (".", ""))
        slot >>= 1
    return out


def written(path: list[tuple[str, str]]) -> str:
    return " ".join(side + digest for side, digest in path)


def read(path: str) -> list[tuple[str, str]]:
    return [(step[0], step[1:]) for step in path.split()]


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf leads to with these siblings."""
    for side, beside in path:
        digest = h(beside, digest) if side == "<" else h(digest, beside)
    return digest


def packed(nodes: DataFrame, slot_bits: int, *more: str) -> DataFrame:
    """(tree, block, total, digests, *more, result): arrays by slot of the columns, and the block's result."""

    @F.pandas_udf("string")
    def result(digests: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series([levels(d, int(t), slot_bits)[-1][0] for d, t in zip(digests, total, strict=True)], dtype="object")

    slot = F.sort_array(F.collect_list(F.struct("pos", "digest", *more)))
    blocks = nodes.groupBy("tree", F.shiftright("pos", slot_bits).alias("block")).agg(F.max("total").alias("total"), slot.alias("slot"))
    arrays = blocks.select("tree", "block", "total", F.col("slot.digest").alias("digests"), *(F.col(f"slot.{c}").alias(c) for c in more))
    return staged(arrays.withColumn("result", result("digests", "total")), "manifest-slots")


def climb(nodes: DataFrame, slot_bits: int, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each round from the leaves up, and (tree, digest) of the last nodes."""
    rounds = [packed(nodes, slot_bits, *more)]
    while (rounds[-1].agg(F.max("total")).first()[0] or 0) > 1 << slot_bits:
        above = rounds[-1].select("tree", F.col("block").alias("pos"), F.ceil(F.col("total") / (1 << slot_bits)).cast("long").alias("total"), F.col("result").alias("digest"))
        rounds.append(packed(above, slot_bits))
    return rounds, rounds[-1].select("tree", F.col("result").alias("digest"))


def descend(rounds: list[DataFrame], paths: DataFrame, slot_bits: int) -> DataFrame:
    """(tree, block, path) for the blocks of the first round, from those of the last."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                tree = levels(r.digests, r.total, slot_bits)
                rows = [(r.tree, (r.block << slot_bits) + i, " ".join(filter(None, (written(siblings(tree, i)), r.path)))) for i in range(len(r.digests))]
                yield pd.DataFrame(rows, columns=["tree", "block", "path"])

    for blocks in reversed(rounds[1:]):
        paths = staged(blocks.select("tree", "block", "total", "digests").join(paths, ["tree", "block"]).mapInPandas(spread, "tree string, block long, path string"), "manifest-paths")
    return paths


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``pos`` in the order of ``tree``, without gathering them."""
    schema = "tree string, digest string, pos long"
    ordered = rows.select("tree", "digest").orderBy("tree").rdd.zipWithIndex().map(lambda x: (x[0].tree, x[0].digest, x[1]))
    return rows.sparkSession.createDataFrame(ordered, schema)


def manifest(docs: DataFrame, slot_bits: int = SLOT_BITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row.

    Null fields are written as a hyphen; empty and long texts are hashed whole; rows without a
    doc_id come first in their tree and are never tampered with; rows of one doc_id are leaves
    each, the smaller leaf first; an empty table gives no rows; columns other than the five are
    not read.
    """
    rows = staged(leaves(docs), "manifest-leaves")
    rounds, ends = climb(coordinates(rows).withColumnRenamed("leaf", "digest"), slot_bits, "doc_id", "seen")
    subroots = numbered(ends)
    count = subroots.count()
    tops, root = climb(subroots.select(F.lit("").alias("tree"), "pos", F.lit(count).alias("total"), "digest", F.col("tree").alias("name")), slot_bits, "name")
    last = root.first()
    top_paths = descend(tops, docs.sparkSession.createDataFrame([("", 0, "")], "tree string, block long, path string"), slot_bits)

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                tree = levels(r.digests, r.total, slot_bits)
                steps = [" ".join(filter(None, (written(siblings(tree, i)), r.path))) for i in range(len(r.digests))]
                yield pd.DataFrame({"tree": r.name, "block": 0, "path": steps, "subroot": r.digests})

    of_trees = staged(tops[0].join(top_paths, ["tree", "block"]).mapInPandas(named, "tree string, block long, path string, subroot string"), "manifest-trees")
    paths = descend(rounds, of_trees.select("tree", "block", "path"), slot_bits)

    def proven(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                tree, above = levels(r.digests, r.total, slot_bits), read(r.path)
                rows = []
                for i, (doc_id, digest, seen) in enumerate(zip(r.doc_id, r.digests, r.seen, strict=True)):
                    path = siblings(tree, i) + above
                    rows.append((doc_id, digest, r.subroot, h(*(d for _, d in path)), fold(seen, path)))
                yield pd.DataFrame({c: pd.Series(v, dtype="Int64" if c == "doc_id" else "object") for c, v in zip(("doc_id", "leaf", "subroot", "proof_sha256", "folded_root"), zip(*rows, strict=True), strict=True)})

    found = rounds[0].join(paths, ["tree", "block"]).join(of_trees.select("tree", "subroot"), "tree").mapInPandas(proven, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    named_root = F.lit(last.digest if last else None).cast("string")
    return found.select("doc_id", "leaf", "subroot", named_root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == named_root).alias("verified"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read_table(spark, sf_dir, "documents"))
