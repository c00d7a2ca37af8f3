"""Lead-lag scores of edges, the score matrix C, its skew part S, and leadingness.

Matrices are rows (i, j, value) of the cells that are there; absent cells are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelag.operators.asof import BLOCK_BITS, calendar
from tidelag.operators.stats import ols_by, winsorize_by
from tidelag.sources.shared import staged

SCORES = {"tstat_diff": ("t_fwd", "t_rev"), "beta_diff": ("beta_fwd", "beta_rev")}


def indexed(returns: DataFrame) -> DataFrame:
    """Returns with the place of their date in the calendar of all returns."""
    return returns.join(F.broadcast(calendar(returns)), "date").select("gvkey", "t_idx", "r")


def in_blocks(series: DataFrame, firm: str, name: str, back: int = 0) -> DataFrame:
    """(firm, block, name): returns of ``1 << BLOCK_BITS`` calendar places as an array, NULL where there is none; one for each firm and place."""
    t = F.col("t_idx") - back
    slot = t.bitwiseAND((1 << BLOCK_BITS) - 1)
    values = F.array(*(F.max(F.when(slot == k, F.col("r"))) for k in range(1 << BLOCK_BITS)))
    return series.groupBy(F.col("gvkey").alias(firm), F.shiftright(t, BLOCK_BITS).alias("block")).agg(values.alias(name))


def directed_ols(series: DataFrame, pairs: DataFrame, horizon: int = 1) -> DataFrame:
    """(a, b, n, beta, t): the return of b ``horizon`` calendar places on, regressed on that of a.

    Pairs meet the returns of both firms in blocks, so that a pair and block is one row of the
    shuffles, and days are only taken apart where they are summed.
    """
    met = pairs.join(in_blocks(series, "a", "x"), "a").join(in_blocks(series, "b", "y", horizon), ["b", "block"])
    return ols_by(met.select("a", "b", F.inline(F.arrays_zip("x", "y"))), ["a", "b"], "y", "x")


def among(series: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges whose both firms have returns; others are in no regression, so they go before anything is shuffled for one."""
    known = series.select("gvkey").distinct()
    return edges.join(known.withColumnRenamed("gvkey", "customer_gvkey"), "customer_gvkey", "left_semi").join(known.withColumnRenamed("gvkey", "supplier_gvkey"), "supplier_gvkey", "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b): the distinct pairs of edges in both directions."""
    ends = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    return edges.select(F.inline(F.array(ends("customer_gvkey", "supplier_gvkey"), ends("supplier_gvkey", "customer_gvkey")))).distinct()


def edge_scores(returns: DataFrame, edges: DataFrame, horizon: int = 1, min_obs: int = 80, winsor_q: float = 0.001, score: str = "tstat_diff") -> DataFrame:
    """Each edge row with both regressions of its pair and its score; short pairs go.

    Every distinct pair is regressed once in each direction, both in one aggregate.
    """
    if score not in SCORES:
        raise ValueError("score must be tstat_diff or beta_diff")
    series = staged(winsorize_by(indexed(returns), "gvkey", "r", winsor_q), "series")
    edges = staged(among(series, edges).select("customer_gvkey", "supplier_gvkey", "weight_wji"), "scored-edges")
    fitted = staged(directed_ols(series, both_ways(edges), horizon), "fitted-pairs")
    side = lambda one, other, tag: fitted.select(F.col("a").alias(one), F.col("b").alias(other), *(F.col(c).alias(f"{c}_{tag}") for c in ("n", "beta", "t")))
    both = edges.join(side("customer_gvkey", "supplier_gvkey", "fwd"), ["customer_gvkey", "supplier_gvkey"]).join(side("supplier_gvkey", "customer_gvkey", "rev"), ["customer_gvkey", "supplier_gvkey"])
    ahead, back = SCORES[score]
    return both.where(F.least("n_fwd", "n_rev") >= min_obs).select(
        "customer_gvkey", "supplier_gvkey", F.col("weight_wji").alias("w"), "beta_fwd", "t_fwd", "beta_rev", "t_rev",
        F.least("n_fwd", "n_rev").alias("n"), (F.col("weight_wji") * (F.col(ahead) - F.col(back))).alias("score"),
    )


def score_matrix(scores: DataFrame) -> DataFrame:
    """C: the mean score of each (customer, supplier); cells without a score are absent."""
    return scores.where("score is not null").groupBy(F.col("customer_gvkey").alias("i"), F.col("supplier_gvkey").alias("j")).agg(F.avg("score").alias("value"))


def with_mirrored(matrix: DataFrame, value: Column) -> DataFrame:
    """Each cell and, mirrored, one of this value; the matrix is computed once."""
    cell = lambda i, j, v: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), v.alias("value"))
    return matrix.select(F.inline(F.array(cell("i", "j", F.col("value")), cell("j", "i", value))))


def skew(matrix: DataFrame) -> DataFrame:
    """S = C - C transposed, by adding each cell and its mirrored negative."""
    return with_mirrored(matrix, -F.col("value")).groupBy("i", "j").agg(F.sum("value").alias("value"))


def nodes(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("i").alias("node")).union(matrix.select("j")).distinct()


def leadingness(skewed: DataFrame) -> DataFrame:
    """(node, leadingness): row sums of S; its rows hold every node, as S is skew."""
    return skewed.groupBy(F.col("i").alias("node")).agg(F.sum("value").alias("leadingness"))


def top(rows: DataFrame, column: str, key: str, k: int = 20, largest: bool = True) -> DataFrame:
    """The ``k`` rows of largest (or smallest) value; ties by key."""
    order = F.desc_nulls_last(column) if largest else F.asc_nulls_last(column)
    return rows.orderBy(order, F.asc(key)).limit(k)


def asymmetry(skewed: DataFrame) -> DataFrame:
    """(n_nodes, max_abs): the largest |S + S transposed|, which is 0."""
    sums = with_mirrored(skewed, F.col("value")).groupBy("i", "j").agg(F.sum("value").alias("both"))
    return sums.agg(F.count_distinct("i").alias("n_nodes"), F.coalesce(F.max(F.abs("both")), F.lit(0.0)).alias("max_abs"))
