"""Readers: raw CSV by position, returns and merged edges, score matrices."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelag.functions.clean import finite, float_text_id, leading_number, log_return
from tidelag.functions.text import csv_fields, normalise, trim_blanks, zero_fill
from tidelag.sources import schemas
from tidelag.sources.shared import staged


def line_order() -> F.Column:
    """Sorts rows as their files hold them: by file, block, and place in the block."""
    return F.struct(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("file_block_start"), F.monotonically_increasing_id().alias("id"))


def read_positional(spark: SparkSession, path: str, schema: T.StructType, least_fields: int, allow_missing: bool = False) -> DataFrame:
    """Trimmed text columns of a CSV with a header of any names, read by position.

    ``ord`` sorts rows as their files hold them: by file, block, and place in the block. A line is
    a row: every quote toggles, and none goes over the end of a line. Lines with fewer than ``least_fields`` fields are dropped; fields beyond the schema are ignored.
    """
    try:
        lines = spark.read.option("lineSep", "\n").text(path)
    except AnalysisException:
        if not allow_missing:
            raise
        return spark.createDataFrame([], T.StructType([T.StructField("ord", schemas.PLACE), *schema.fields]))
    fields = F.col("f")
    parsed = lines.select(line_order().alias("ord"), csv_fields(F.col("value")).alias("f"))
    cut = parsed.select("ord", (F.size(fields) >= least_fields).alias("whole"), *(trim_blanks(F.coalesce(F.get(fields, F.lit(k)), F.lit(""))).alias(c.name) for k, c in enumerate(schema.fields)))
    # written once, so that the places of first lines are those of the rows: one for each file, and no file is sorted
    rows = staged(cut, "lines")
    firsts = staged(rows.where("ord.file_block_start = 0").groupBy("ord.file_path").agg(F.min("ord.id").alias("first")).select("first"), "first-lines")
    return rows.where("whole").join(firsts, F.col("ord.id") == F.col("first"), "left_anti").select("ord", *(c.name for c in schema.fields))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Firms with a ticker and a name; of equal normalised names the first line stays."""
    from tidelag.operators.dedupe import keep_first

    rows = read_positional(spark, path, schemas.METADATA, schemas.LEAST_FIELDS["metadata"])
    firms = rows.select("ord", "tic", "gvkey", "conm", normalise(F.col("conm")).alias("norm_name"), (F.col("costat") == "A").alias("active"))
    return keep_first(firms.where("tic <> '' and norm_name <> ''"), ["norm_name"], "ord")


def read_fundamentals(spark: SparkSession, path: str, allow_missing: bool = False) -> DataFrame:
    """(gvkey, datadate, sale) with the last positive sale of each key."""
    from tidelag.operators.dedupe import last_value

    rows = read_positional(spark, path, schemas.FUNDAMENTALS, schemas.LEAST_FIELDS["fundamentals"], allow_missing)
    sales = rows.select("ord", "gvkey", F.col("datadate").try_cast("date").alias("datadate"), leading_number(F.col("sale")).alias("sale"))
    return last_value(sales.where("sale > 0").repartition("gvkey", "datadate"), ["gvkey", "datadate"], "sale", "ord")


def read_earnings(spark: SparkSession, path: str, allow_missing: bool = False) -> DataFrame:
    """(tic, datadate, rdq) with the last report date of each key."""
    from tidelag.operators.dedupe import last_value

    rows = read_positional(spark, path, schemas.EARNINGS, schemas.LEAST_FIELDS["earnings"], allow_missing)
    dates = rows.where("tic <> '' and rdq <> ''").select("ord", "tic", F.col("datadate").try_cast("date").alias("datadate"), F.col("rdq").try_cast("date").alias("rdq"))
    return last_value(dates.repartition("tic", "datadate"), ["tic", "datadate"], "rdq", "ord")


def read_segments(spark: SparkSession, path: str, allow_missing: bool = False) -> DataFrame:
    """(ord, tic, srcdate, gvkey, cnms, salecs) as text, dates typed."""
    rows = read_positional(spark, path, schemas.SEGMENTS, schemas.LEAST_FIELDS["segments"], allow_missing)
    return rows.select("ord", "tic", F.col("srcdate").try_cast("date").alias("srcdate"), "gvkey", "cnms", "salecs")


def clean_returns(rows: DataFrame, log: bool = False, finite_only: bool = False, order: str | None = None) -> DataFrame:
    """(gvkey, date, r): filled ids, dates without time, no missing return, the last row of each day.

    "Last" is by the column ``order`` (``ord`` where rows have one); rows without an order have
    none that is last, so the largest return of the day stays.
    """
    from tidelag.operators.dedupe import keep_last

    value = F.col("RET").try_cast("double")
    value = finite(value) if finite_only else F.when(~F.isnan(value), value)
    order = order or ("ord" if "ord" in rows.columns else None)
    ord_ = F.col(order) if order else value
    rows = rows.select(zero_fill(F.col("gvkey").cast("string")).alias("gvkey"), F.to_date("date").alias("date"), value.alias("RET"), ord_.alias("ord"))
    kept = keep_last(rows.where(F.col("RET").isNotNull()), ["gvkey", "date"], "ord")
    return kept.select("gvkey", "date", (log_return(F.col("RET")) if log else F.col("RET")).alias("r"))


def clean_edges(rows: DataFrame, min_weight: float | None = None, require_finite: bool = True, source: str | None = None) -> DataFrame:
    """(customer_gvkey, supplier_gvkey, date, weight_wji): ids from float text, weights that are numbers."""
    if source is not None and "source" in rows.columns:
        rows = rows.where(F.col("source") == source)
    weight = F.col("weight_wji").try_cast("double")
    weight = finite(weight) if require_finite else F.when(~F.isnan(weight), weight)
    plain = F.trim(F.col("supplier_gvkey").cast("string"))
    supplier = F.when(plain.contains("."), float_text_id(plain)).otherwise(zero_fill(plain))
    rows = rows.select(float_text_id(F.col("customer_gvkey").cast("string")).alias("customer_gvkey"), supplier.alias("supplier_gvkey"), F.to_date("srcdate").alias("date"), weight.alias("weight_wji"), *([F.col("ord")] if "ord" in rows.columns else []))
    rows = rows.where("weight_wji is not null and customer_gvkey is not null")
    return rows if min_weight is None else rows.where(F.abs("weight_wji") >= min_weight)


def read_returns(spark: SparkSession, path: str, **how) -> DataFrame:
    rows = spark.read.parquet(path)
    return clean_returns(rows.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("ord")), **how)


def read_merged_edges(spark: SparkSession, path: str, **how) -> DataFrame:
    """Edges of CSV files with a header; ``ord`` is the order of their lines."""
    rows = spark.read.option("header", True).csv(path)
    return clean_edges(rows.select("*", line_order().alias("ord")), **how)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, value) of a stored score matrix."""
    return spark.read.parquet(path).select(F.col("i").cast("string"), F.col("j").cast("string"), F.col("value").cast("double"))


def read_edge_scores(spark: SparkSession, path: str) -> DataFrame:
    """Scores of edges with ``rank``, from 1, in the order of their files."""
    rows = spark.read.option("header", True).schema(schemas.EDGE_SCORES).csv(path).select("*", line_order().alias("ord"))
    numbered = rows.orderBy("ord").drop("ord").rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + 1))
    return spark.createDataFrame(numbered, T.StructType([*schemas.EDGE_SCORES.fields, T.StructField("rank", T.LongType())]))
