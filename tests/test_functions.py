import math

import pytest
from pyspark.sql import functions as F

from tidelag.functions import clean, text
from tidelag.functions.student import two_sided_p
from tidelag.sources.writers import regression_name


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("raw", "norm"), [("Wal-Mart Stores, Inc. é3M", "WALMARTSTORESINC3M"), ("--- ", ""), (None, None)])
def test_normalise(spark, raw, norm):
    assert one(spark, raw, text.normalise) == norm


def test_tokens_and_suffixes(spark):
    assert one(spark, "Alpha-Beta (UK) Ltd.", text.tokens) == ["ALPHA", "BETA", "UK", "LTD"]
    assert one(spark, "The Acme Acme Group of Co", text.strip_suffixes) == "ACMEACME"
    assert one(spark, "Holdings Inc", text.strip_suffixes) == ""


def test_jaccard_of_empty_sets_is_0(spark):
    row = spark.sql("select array('A','B','C') a, array('B','C','D') b, array() c").select(text.jaccard(F.col("a"), F.col("b")).alias("x"), text.jaccard(F.col("c"), F.col("c")).alias("y")).first()
    assert row.x == 0.5 and row.y == 0.0


@pytest.mark.parametrize(("raw", "filled"), [("12", "000012"), ("1234567", "1234567"), (None, None)])
def test_zero_fill_never_truncates(spark, raw, filled):
    assert one(spark, raw, text.zero_fill) == filled


@pytest.mark.parametrize(("raw", "found"), [("2285.0", "002285"), ("x", None), (None, None), ("1.5", None), ("nan", None)])
def test_float_text_id(spark, raw, found):
    assert one(spark, raw, clean.float_text_id) == found


@pytest.mark.parametrize(("raw", "found"), [("12.5", 12.5), ("inf", None), ("nan", None), ("12abc", None), ("", None)])
def test_to_number(spark, raw, found):
    assert one(spark, raw, clean.to_number) == found


def test_leading_number(spark):
    assert one(spark, " 12abc", clean.leading_number) == 12.0
    assert one(spark, "abc", clean.leading_number) is None


def test_log_return_is_null_at_minus_one(spark):
    assert one(spark, -1.0, clean.log_return, "double") is None
    assert one(spark, 0.5, clean.log_return, "double") == pytest.approx(math.log(1.5))


def test_clip_keeps_null(spark):
    assert one(spark, None, lambda x: clean.clip(x, F.lit(0.0), F.lit(1.0)), "double") is None
    assert one(spark, 5.0, lambda x: clean.clip(x, F.lit(0.0), F.lit(1.0)), "double") == 1.0


def test_capped_share(spark):
    share = lambda part, whole: spark.createDataFrame([(part, whole)], "p double, w double").select(clean.capped_share(F.col("p"), F.col("w")).alias("y")).first().y
    assert share(15.0, 10.0) == 1.0 and share(1.0, 4.0) == 0.25
    assert share(1.0, 0.0) is None and share(float("nan"), 2.0) is None and share(1.0, None) is None


def test_trim(spark):
    assert one(spark, " \t a b \r\n", text.trim_blanks) == "a b"


def test_student_tail():
    assert two_sided_p(1.0, 1) == pytest.approx(0.5)
    assert two_sided_p(math.sqrt(2), 2) == pytest.approx(1 - math.sqrt(2) / 2)
    assert two_sided_p(1.959963985, 1e9) == pytest.approx(0.05, abs=1e-7)
    assert math.isnan(two_sided_p(math.nan, 5))


def test_file_names():
    assert regression_name("forward") == "leadlag_forward.csv"
    assert regression_name("reverse", True, True) == "leadlag_reverse_winsor_nonzero.csv"
