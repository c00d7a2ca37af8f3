"""Resolution of raw names to firms: equal names, names without suffixes, shared words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.functions.text import normalise, strip_suffixes, tokens
from tidelag.operators.dedupe import first_value, keep_first

THRESHOLD = 0.6
#: Keys of one set that travel as one row.
PACK = 500


def dictionary(firms: DataFrame) -> DataFrame:
    """(ord, tic, conm, norm_name, stripped, tokens) of firms, unique by normalised name."""
    named = firms.select("ord", "tic", "conm", normalise(F.col("conm")).alias("norm_name"), strip_suffixes(F.col("conm")).alias("stripped"), tokens(F.col("conm")).alias("tokens"))
    return keep_first(named.where("tic <> '' and norm_name <> ''"), ["norm_name"], "ord")


def exact(names: DataFrame, firms: DataFrame) -> DataFrame:
    """``names`` (name, norm) with the ticker of the firm of equal normalised name, or NULL.

    No broadcast is forced: the optimiser knows the size of the dictionary.
    """
    return names.join(first_value(firms, ["norm_name"], "tic", "ord").withColumnRenamed("norm_name", "norm"), "norm", "left")


def stripped(names: DataFrame, firms: DataFrame) -> DataFrame:
    """``names`` (name) with the ticker of the first firm whose stripped name is equal, or NULL."""
    keys = first_value(firms.where("stripped <> ''"), ["stripped"], "tic", "ord")
    return names.withColumn("stripped", strip_suffixes(F.col("name"))).join(keys, "stripped", "left")


def with_sets(rows: DataFrame, key: str, k: str) -> DataFrame:
    """(k, t): keys with their words as a set in order, so that equal sets are equal; rows without words go."""
    sets = rows.select(F.col(key).alias(k), F.array_sort(F.array_distinct("tokens")).alias("t"))
    return sets.where(F.size("t") > 0).distinct()


def set_pairs(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(t1, t2, score) of the distinct sets ``t`` whose Jaccard similarity is ``threshold`` or more.

    Sets of that similarity share one of the rarest words of each, so many that the rest is too
    small; only sets that share such a word meet, so common words bring nobody together. Sizes
    that rule a match out are dropped in the join.
    """
    one, two = left.select("t").distinct(), right.select("t").distinct()
    each = lambda sets: sets.select("t", F.explode("t").alias("word"))
    df = each(one).select("word").unionAll(each(two).select("word")).groupBy("word").agg(F.count("*").alias("df"))
    rare = lambda sets: (
        each(sets).join(df, "word").groupBy("t").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("w"))
        .select("t", F.explode(F.slice(F.transform("w", lambda x: x["word"]), 1, (F.size("t") - F.ceil(threshold * F.size("t") - 1e-9) + 1).cast("int"))).alias("word"))
    )
    n1, n2 = F.size("t1"), F.size("t2")
    near = F.least(n1, n2) >= threshold * F.greatest(n1, n2) - 1e-9
    met = rare(one).withColumnRenamed("t", "t1").join(rare(two).withColumnRenamed("t", "t2"), "word").where(near)
    both = F.size(F.array_intersect("t1", "t2"))
    return met.select("t1", "t2", (both / (n1 + n2 - both)).alias("score")).where(F.col("score") >= threshold).distinct()


def in_packs(rows: DataFrame, k: str, t: str) -> DataFrame:
    """(t, keys): the keys of each set in packs of some ``PACK``, so that no set of many keys is one row."""
    sizes = rows.groupBy("t").agg(F.ceil(F.count("*") / PACK).alias("packs"))
    packed = rows.join(sizes, "t").groupBy("t", F.pmod(F.xxhash64(k), F.col("packs")).alias("pack")).agg(F.collect_list(k).alias(f"{k}s"))
    return packed.select(F.col("t").alias(t), f"{k}s")


def token_pairs(left: DataFrame, right: DataFrame, key_left: str, key_right: str, threshold: float = THRESHOLD, ordered: bool = False) -> DataFrame:
    """(k1, k2, score) of rows whose token sets have a Jaccard similarity of ``threshold`` or more; a key has one set.

    Each distinct set is compared once; its keys come in packs when all is decided, and pairs of
    keys are only made where they leave. With ``ordered`` pairs that are not k1 < k2 are left out.
    """
    one, two = with_sets(left, key_left, "k1"), with_sets(right, key_right, "k2")
    packs = set_pairs(one, two, threshold).join(in_packs(one, "k1", "t1"), "t1").join(in_packs(two, "k2", "t2"), "t2").select("k1s", "k2s", "score")
    if ordered:
        packs = packs.where(F.array_min("k1s") < F.array_max("k2s"))
    found = packs.repartition("k1s", "k2s").select(F.explode("k1s").alias("k1"), "k2s", "score").select("k1", F.explode("k2s").alias("k2"), "score")
    return found.where("k1 < k2") if ordered else found


def best_jaccard(names: DataFrame, firms: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(name, tic, score): the firm with the most similar words; of ties the first firm.

    Of the firms with one set of words only the first can be chosen, and equal sets of names choose
    alike, so distinct sets are all that meets.
    """
    asked = with_sets(names.select("name", tokens(F.col("name")).alias("tokens")), "name", "name")
    firsts = with_sets(firms.select(F.struct("ord", "tic").alias("firm"), "tokens"), "firm", "firm").groupBy(F.col("t").alias("t2")).agg(F.min("firm").alias("firm"))
    pairs = set_pairs(asked, firsts.withColumnRenamed("t2", "t"), threshold).join(firsts, "t2")
    best = pairs.groupBy(F.col("t1").alias("t")).agg(F.min(F.struct((-F.col("score")).alias("less"), "firm")).alias("best"))
    return asked.join(best, "t").select("name", F.col("best.firm.tic").alias("tic"), (-F.col("best.less")).alias("score"))


def resolve(names: DataFrame, firms: DataFrame, mode: str = "compat", threshold: float = THRESHOLD) -> DataFrame:
    """(name, norm, tic, tier) of the distinct ``names``; NULL where no tier finds a firm.

    ``compat`` knows equal names only; ``tokens`` goes on to stripped names and shared words,
    each tier with the names that the one before left. Names that normalise to nothing stay
    unresolved.
    """
    if mode not in ("compat", "tokens"):
        raise ValueError("mode must be compat or tokens")
    asked = names.select("name").distinct().withColumn("norm", normalise(F.col("name")))
    found = exact(asked, firms).select("name", "norm", "tic", F.when(F.col("tic").isNotNull(), 1).alias("tier"))
    if mode == "compat":
        return found
    open_ = found.where("tic is null and norm <> ''").select("name")
    second = stripped(open_, firms).where("tic is not null").select("name", F.col("tic").alias("tic2"))
    third = best_jaccard(open_.join(second, "name", "left_anti"), firms, threshold).select("name", F.col("tic").alias("tic3"))
    return (
        found.join(second, "name", "left").join(third, "name", "left")
        .select("name", "norm", F.coalesce("tic", "tic2", "tic3").alias("tic"), F.when(F.col("tic").isNotNull(), 1).when(F.col("tic2").isNotNull(), 2).when(F.col("tic3").isNotNull(), 3).alias("tier"))
    )


def stats(resolved: DataFrame) -> DataFrame:
    """(tier, names): distinct normalised names by tier; tier 0 holds those without a firm."""
    return resolved.where("norm <> ''").groupBy(F.coalesce("tier", F.lit(0)).alias("tier")).agg(F.count_distinct("norm").alias("names"))
