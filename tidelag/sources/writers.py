"""Writers of the result tables; CSV where the text form matters, Parquet else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.functions.text import six_decimals


def edge_rows(edges: DataFrame) -> DataFrame:
    """Edges as text with six decimals, in the order of the input lines."""
    return edges.select(
        "ord", F.date_format("date", "yyyy-MM-dd").alias("date"), "customer_tic", "supplier_tic", "supplier_gvkey",
        *(six_decimals(F.col(c)).alias(c) for c in ("salecs", "total_sale", "weight_wji")), "match_tier",
    )


def neighbour_text(neighbors) -> F.Column:
    """``TIC:weight`` joined by bars."""
    return F.array_join(F.transform(neighbors, lambda n: F.concat(n["customer_tic"], F.lit(":"), six_decimals(n["weight"]))), "|")


def write_edge_list(edges: DataFrame, path: str) -> None:
    edge_rows(edges).orderBy("ord").drop("ord").write.mode("overwrite").option("header", True).csv(path)


def write_adjacency(adjacency: DataFrame, path: str) -> None:
    adjacency.select("date", "supplier_tic", neighbour_text("neighbors").alias("neighbors")).write.mode("overwrite").option("header", True).csv(path)


def write_calendar(calendar: DataFrame, path: str) -> None:
    calendar.select("tic", "fiscal_period_end", "report_date_rdq").write.mode("overwrite").option("header", True).csv(path)


def write_table(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


def regression_name(direction: str, winsorized: bool = False, nonzero: bool = False) -> str:
    """File name of regression results by the options they were made with."""
    return "leadlag_" + direction + "_winsor" * winsorized + "_nonzero" * nonzero + ".csv"


def write_regressions(results: DataFrame, folder: str, direction: str, winsorized: bool = False, nonzero: bool = False) -> None:
    results.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{regression_name(direction, winsorized, nonzero)}")


def write_text(spark: SparkSession, lines: list[str], path: str) -> None:
    """A few lines as one text file."""
    spark.createDataFrame([(k, line) for k, line in enumerate(lines)], "k int, line string").coalesce(1).sortWithinPartitions("k").select("line").write.mode("overwrite").text(path)


def write_edge_scores(scores: DataFrame, path: str) -> None:
    """Highest score first, missing ones last: rows are dealt to files by ranges of that order, so that
    the files, by name, hold them in it, and no task sorts them all."""
    scores.orderBy(F.desc_nulls_last("score"), "customer_gvkey", "supplier_gvkey", "w").write.mode("overwrite").option("header", True).csv(path)


def write_leadingness(rows: DataFrame, path: str) -> None:
    """Highest first, in the same way."""
    rows.orderBy(F.desc_nulls_last("leadingness"), "node").write.mode("overwrite").option("header", True).csv(path)
