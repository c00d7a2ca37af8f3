"""Panels of leads and lags around a neighbour signal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelag.operators.asof import signal

LAGS = 5


@dataclass(frozen=True)
class Roles:
    """Which end of an edge the panel describes, and the names of its columns."""

    entity: str
    source: str
    prefix: str
    signal: str


ROLES = {
    "forward": Roles("supplier_gvkey", "customer_gvkey", "sup_r", "y"),
    "reverse": Roles("customer_gvkey", "supplier_gvkey", "cust_r", "z"),
}


def roles_of(direction: str) -> Roles:
    if direction not in ROLES:
        raise ValueError("direction must be forward or reverse")
    return ROLES[direction]


def panel(returns: DataFrame, edges: DataFrame, direction: str = "forward", horizon_max: int = 5, min_weight: float | None = None) -> DataFrame:
    """Own return, signal (0 without neighbours), returns of the next and last rows of each entity.

    Leads and lags count rows of the entity; all share one window, so one sort. Rows without
    all leads go; lags may be NULL.
    """
    roles = roles_of(direction)
    if min_weight is not None:
        edges = edges.where(F.abs("weight_wji") >= min_weight)
    own = returns.select(F.col("gvkey").alias(roles.entity), "date", F.col("r").alias(roles.prefix))
    found = signal(returns, edges, roles.entity, roles.source, roles.signal)
    joined = own.join(found, [roles.entity, "date"], "left")
    rows = Window.partitionBy(roles.entity).orderBy("date")
    leads = [F.lead(roles.prefix, h).over(rows).alias(f"{roles.prefix}_fwd_{h}") for h in range(1, horizon_max + 1)]
    lags = [F.lag(roles.prefix, k).over(rows).alias(f"{roles.prefix}_lag_{k}") for k in range(1, LAGS + 1)]
    built = joined.select(roles.entity, "date", roles.prefix, F.coalesce(roles.signal, F.lit(0.0)).alias(roles.signal), *leads, *lags)
    return built.dropna(subset=[f"{roles.prefix}_fwd_{h}" for h in range(1, horizon_max + 1)])


def summary(rows: DataFrame, direction: str = "forward") -> DataFrame:
    """Size of a panel and the spread of its signal."""
    roles = roles_of(direction)
    return rows.agg(
        F.count("*").alias("n_rows"), F.count_distinct(roles.entity).alias("n_entities"), F.count_distinct("date").alias("n_dates"),
        F.stddev_samp(roles.signal).alias("std_signal"), F.avg(F.abs(roles.signal)).alias("mean_abs_signal"),
    )
