"""The neighbour signal over a stream of returns: an extension, not a reference operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.operators.asof import intervals


def streaming_signal(returns: DataFrame, edges: DataFrame, entity: str, source: str, name: str, delay: str = "5 days") -> DataFrame:
    """(entity, day, name) from streamed (gvkey, ts, r) and a table of edges, with late rows up to ``delay``."""
    stream = returns.withWatermark("ts", delay).select(F.col("gvkey").alias(source), "ts", F.to_date("ts").alias("date"), "r")
    held = stream.join(intervals(edges), source).where((F.col("date") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("date") < F.col("hi"))))
    summed = held.groupBy(entity, F.window("ts", "1 day").alias("w")).agg(F.sum(F.col("weight_wji") * F.col("r")).alias(name))
    return summed.select(entity, F.to_date("w.start").alias("date"), name)
