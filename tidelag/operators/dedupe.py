"""First and last rows of a key, in a stated order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).asc())))
    return ranked.where("_rank = 1").drop("_rank")


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc())))
    return ranked.where("_rank = 1").drop("_rank")


def last_value(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The last value written to each key: a partial aggregate, no sort."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def first_value(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The first value written to each key."""
    return rows.groupBy(*keys).agg(F.min_by(value, order).alias(value))
