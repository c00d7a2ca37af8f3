"""Column layouts of the input and output tables."""

from __future__ import annotations

from pyspark.sql import types as T


def text_columns(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names.split()])


# The column order of the raw files, which are read by position.
SEGMENTS = text_columns("tic srcdate gvkey conm cid cnms salecs sid")
METADATA = text_columns("costat curcd datafmt indfmt consol tic datadate gvkey conm")
FUNDAMENTALS = text_columns("costat curcd datafmt indfmt consol tic datadate gvkey conm fyr gsector at sale sich")
EARNINGS = text_columns("costat curcdq datafmt indfmt consol tic datadate gvkey rdq")
#: Fields that a line must have; shorter lines are dropped.
LEAST_FIELDS = {"segments": 7, "metadata": 9, "fundamentals": 13, "earnings": 9}

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "date": T.DateType(), "long": T.LongType(), "int": T.IntegerType()}


def typed_columns(**kinds: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in kinds.items()])


PLACE = typed_columns(file_path="string", file_block_start="long", id="long")
RETURNS = typed_columns(gvkey="string", date="date", r="double")
MERGED_EDGES = typed_columns(customer_gvkey="string", supplier_gvkey="string", date="date", weight_wji="double")
EDGES = typed_columns(
    date="date", customer_tic="string", supplier_tic="string", supplier_gvkey="string", salecs="double", total_sale="double", weight_wji="double", match_tier="int"
)


def require(rows, schema: T.StructType) -> None:
    """An error that names the columns which ``rows`` lack or hold with another type."""
    held = {f.name: f.dataType for f in rows.schema.fields}
    wrong = [f.name for f in schema.fields if held.get(f.name) != f.dataType]
    if wrong:
        raise ValueError("columns missing or of another type: " + ", ".join(wrong))
EDGE_SCORES = typed_columns(customer_gvkey="string", supplier_gvkey="string", w="double", beta_fwd="double", t_fwd="double", beta_rev="double", t_rev="double", n="long", score="double")
