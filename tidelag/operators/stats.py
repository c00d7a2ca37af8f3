"""Winsorising, descriptions, and regressions of one variable on another."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelag.functions.clean import clip
from tidelag.sources.shared import staged

#: Fewest pairs of a regression, and the least spread of its regressor.
LEAST_PAIRS = 10
LEAST_SPREAD = 1e-20
#: Of the spread of y: a smaller residual counts as none.
EXACT_FIT = 1e-12


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """64-bit numbers in the order of the doubles; both zeros are one, NaN is the largest."""
    values = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = values.view(np.int64)
    return bits ^ (bits >> 63 & np.int64((1 << 63) - 1))


def from_ordered_bits(bits: int) -> float:
    return float((np.array([bits], np.int64) ^ (np.array([bits], np.int64) >> 63 & np.int64((1 << 63) - 1))).view(np.float64)[0])


def values_at(rows: DataFrame, column: str, ranks_of: Callable[[int], list[int]]) -> tuple[int, dict[int, float]]:
    """(number of values, value by rank) for the ranks, from 0, that are asked for that number of values.

    Radix selection on the ordered bits: each of four passes counts the next 16 bits of the values
    that share their bits so far with an asked one, for all ranks at once. Any input takes four.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"bits": ordered_bits(batch.v.to_numpy(np.float64))})

    images = staged(rows.select(F.col(column).cast("double").alias("v")).where("v is not null").mapInPandas(run, "bits long"), "quantiles")
    n = images.count()
    open_ = {rank: (rank, None) for rank in ranks_of(n)}  # rank: (rank among those that share the bits so far, these bits)
    for shift in (48, 32, 16, 0) if open_ else ():
        prefix = F.shiftright("bits", shift + 16) if shift < 48 else F.lit(None).cast("long")
        shared = images if shift == 48 else images.where(prefix.isin(*{p for _, p in open_.values()}))
        counts = shared.groupBy(prefix.alias("prefix"), F.shiftright("bits", shift).alias("bits")).agg(F.count("*").alias("n"))
        running = F.sum("n").over(Window.partitionBy("prefix").orderBy("bits"))
        sums = counts.withColumn("upto", running)
        asked = F.lit(False)
        for rank, p in open_.values():
            asked = asked | (F.col("prefix").eqNullSafe(F.lit(p)) & (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank))
        found = sums.where(asked).collect()  # one row for each rank at most
        for rank, (left, p) in list(open_.items()):
            own = next(r for r in found if r.prefix == p and r.upto - r.n <= left < r.upto)
            open_[rank] = (left - (own.upto - own.n), own.bits)
    return n, {rank: from_ordered_bits(bits) for rank, (_, bits) in open_.items()}


def exact_quantiles(rows: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Quantiles interpolated between neighbours, as ``percentile`` gives them, for any doubles.

    NULL for a table without values; NaN where the neighbours are both infinities.
    """
    places = lambda n: [q * (n - 1) for q in shares] if n else []
    n, at = values_at(rows, column, lambda n: sorted({k for p in places(n) for k in (int(p), min(int(p) + 1, n - 1))}))
    found = []
    for place in places(n):
        low = int(place)
        one, two, part = at[low], at[min(low + 1, n - 1)], place - low
        found.append(one if one == two or not part else one + (two - one) * part if math.isfinite(two - one) else one * (1 - part) + two * part)
    return found or [None for _ in shares]


def winsorize(rows: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``column`` clipped to its own exact quantiles, one pair of bounds for all rows."""
    bounds = exact_quantiles(rows, column, [low, high])
    return rows.withColumn(column, clip(F.col(column), *(F.lit(b).cast("double") for b in bounds)))


def winsorize_by(rows: DataFrame, key: str, column: str, q: float) -> DataFrame:
    """``column`` clipped to the exact quantiles of its key; unchanged unless 0 < q < 0.5."""
    if not 0 < q < 0.5:
        return rows
    bounds = rows.groupBy(key).agg(F.percentile(column, F.array(F.lit(q), F.lit(1 - q))).alias("_q"))
    return rows.join(bounds, key).withColumn(column, clip(F.col(column), F.col("_q")[0], F.col("_q")[1])).drop("_q")


def nonzero(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column) != 0)


def describe(rows: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, extremes, quartiles, mean size and share of values that are not 0."""
    quarters = [F.lit(q).cast("double") for q in exact_quantiles(rows, column, [0.25, 0.5, 0.75])]
    return rows.agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"),
        *(q.alias(name) for q, name in zip(quarters, ("q25", "q50", "q75"), strict=True)), F.max(column).alias("max"),
        F.avg(F.abs(column)).alias("mean_abs"), F.avg((F.col(column) != 0).cast("double")).alias("share_nonzero"),
    )


def ols_by(rows: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """(keys, n, beta, t): intercept regressions of y on x by key, in one aggregate.

    NULL for fewer than ten pairs and for a constant x; t is NULL for an exact fit.
    """
    sums = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy")
    )
    usable = (F.col("n") >= LEAST_PAIRS) & (F.col("sxx") > LEAST_SPREAD)
    beta = F.when(usable, F.try_divide("sxy", "sxx"))
    rest = F.when(usable, F.greatest(F.lit(0.0), F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx"))))
    error = F.sqrt(F.try_divide(rest, (F.col("n") - 2) * F.col("sxx")))
    t = F.when(rest > EXACT_FIT * F.col("syy"), F.try_divide(beta, error))
    return sums.select(*keys, "n", beta.alias("beta"), t.alias("t"))
