import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidelag.operators import edges, resolve
from tidelag.sources import readers, writers


def write(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_files_to_edges(spark, tmp_path):
    firms = write(tmp_path, "firms.csv", 'a,b,c,d,e,f,g,h,i\nA,USD,STD,I,C,ACM,2020-01-01,77,"Acme, Corp"\nI,USD,STD,I,C,AC2,2020-01-01,78,ACME CORP\nA,USD,STD,I,C,,2020-01-01,79,No Ticker\nshort,row\n')
    funds = write(tmp_path, "funds.csv", "h\n" + "".join(f"A,USD,S,I,C,S1,2020-01-01,000001,Sup,12,1,9,{s},1\n" for s in ("10", "20", "-5", "x")))
    parts = write(tmp_path, "parts.csv", 'tic,srcdate,gvkey,conm,cid,cnms,salecs,sid\nS1,2020-01-01,000001,Sup,1," acme, corp ",5,1\nS1,2020-01-01,000001,Sup,1,acme\nS1,2020-01-01,000001,Sup,1,Export,5,1,more,and more\n')
    days = write(tmp_path, "days.csv", "x\nA,USD,S,I,C,ACM,2020-03-31,77,2020-05-01\nA,USD,S,I,C,ACM,2020-03-31,77,2020-05-02\nA,USD,S,I,C,ZZZ,2020-03-31,77,\n")
    metadata = readers.read_metadata(spark, firms)
    assert [r.tic for r in metadata.collect()] == ["ACM"]
    sales = readers.read_fundamentals(spark, funds)
    assert [r.sale for r in sales.collect()] == [20.0]
    rows = edges.classify(readers.read_segments(spark, parts), resolve.dictionary(metadata), sales)
    assert sorted(r.disposition for r in rows.collect()) == ["ignore", "valid"]
    valid = edges.edge_list(rows)
    assert [(r.customer_tic, r.weight_wji) for r in valid.collect()] == [("ACM", 0.25)]
    calendar = edges.earnings_calendar(readers.read_earnings(spark, days), valid)
    assert [r.report_date_rdq for r in calendar.collect()] == [dt.date(2020, 5, 2)]
    assert edges.to_ids(valid, metadata).first().customer_gvkey == "000077"
    writers.write_edge_list(valid, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().weight_wji == "0.250000"
    writers.write_adjacency(edges.adjacency(valid), str(tmp_path / "adj"))
    assert spark.read.option("header", True).csv(str(tmp_path / "adj")).first().neighbors == "ACM:0.250000"
    writers.write_calendar(calendar, str(tmp_path / "cal"))


def test_missing_files(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_segments(spark, str(tmp_path / "none.csv"))
    assert readers.read_segments(spark, str(tmp_path / "none.csv"), allow_missing=True).count() == 0


def test_returns_and_edges(spark):
    raw = spark.createDataFrame([("7", "2024-01-01", 0.1, 1), ("7", "2024-01-01", 0.2, 2), ("7", "2024-01-02", None, 3), ("8", "2024-01-01", float("inf"), 4)], "gvkey string, date string, RET double, k int")
    assert [(r.gvkey, r.r) for r in readers.clean_returns(raw, finite_only=True, order="k").collect()] == [("000007", 0.2)]
    assert readers.clean_returns(raw, order="k").count() == 2
    rows = spark.createDataFrame([("2285.0", "12", "2024-01-01", "0.5", "a"), ("x", "12", "2024-01-01", "0.5", "a"), ("1.0", "3.0", "2024-01-01", "-0.1", "b"), ("1.0", "3", "2024-01-01", "", "b")], "customer_gvkey string, supplier_gvkey string, srcdate string, weight_wji string, source string")
    assert sorted((r.customer_gvkey, r.supplier_gvkey) for r in readers.clean_edges(rows).collect()) == [("000001", "000003"), ("002285", "000012")]
    assert readers.clean_edges(rows, min_weight=0.2).count() == 1 and readers.clean_edges(rows, source="b").count() == 1


def test_order_of_rows_is_that_of_files_not_of_splits(spark, tmp_path):
    """Small and large files are packed into splits by size; the last row is still that of the last file."""
    from tidelag.sources.readers import read_merged_edges, read_returns

    for k, rows in enumerate((1, 4000, 3)):
        data = [("1", "2024-01-02", k + i / 10000) for i in range(rows)]
        spark.createDataFrame(data, "gvkey string, date string, RET double").coalesce(1).write.parquet(str(tmp_path / f"r{k}"))
        spark.createDataFrame([("2024-01-02", "7", "8.0", k + i / 10000) for i in range(rows)], "srcdate string, supplier_gvkey string, customer_gvkey string, weight_wji double").coalesce(1).write.option("header", True).csv(str(tmp_path / f"e{k}"))
    assert [r.r for r in read_returns(spark, str(tmp_path / "r*")).collect()] == [2.0002]
    edges = read_merged_edges(spark, str(tmp_path / "e*"))
    assert edges.orderBy("ord").tail(1)[0].weight_wji == 2.0002 and edges.count() == 4004


def test_exact_quantiles_narrow_to_the_value(spark):
    import numpy as np

    from tidelag.operators import stats

    values = [0.0] * 40 + [float(v) for v in np.random.default_rng(2).normal(size=60)] + [None]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    shares = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    assert np.allclose(stats.exact_quantiles(rows, "v", shares), np.quantile(values[:-1], shares), atol=1e-15)
    assert stats.exact_quantiles(rows.where("false"), "v", [0.5]) == [None]


def test_quantiles_of_any_doubles_end(spark):
    import numpy as np

    from tidelag.operators import stats

    base = spark.range(20_000).select(F.sin(F.col("id").cast("double")).alias("v"))
    rows = base.union(spark.createDataFrame([(float("inf"),)], "v double"))
    values = sorted(r.v for r in rows.collect())
    n, at = stats.values_at(rows, "v", lambda n: [0, 1, 7, n // 2, n - 2, n - 1])
    assert n == 20_001 and at == {k: values[k] for k in (0, 1, 7, n // 2, n - 2, n - 1)}
    assert stats.exact_quantiles(rows, "v", [1.0]) == [float("inf")] and stats.exact_quantiles(rows, "v", [0.5]) == [values[10_000]]
    assert stats.winsorize(rows, "v").agg(F.max("v")).first()[0] == pytest.approx(np.quantile(values, 0.99))
    odd = [float("-inf"), -1.7e308, -5e-324, -0.0, 0.0, 5e-324, 1.7e308, float("inf")]
    few = spark.createDataFrame([(v,) for v in reversed(odd)], "v double")
    assert list(stats.values_at(few, "v", lambda n: range(n))[1].values()) == odd
    assert stats.exact_quantiles(few, "v", [0.05, 0.5]) == [float("-inf"), 0.0]
    bits = stats.ordered_bits(np.array([*odd, float("nan")]))
    assert (np.diff(bits) >= 0).all() and [stats.from_ordered_bits(b) for b in bits.tolist()][:8] == odd


def test_quotes_toggle(spark, tmp_path):
    lines = [
        'A,2020-01-01,1,x,1,Ab"c,d"e,6,1', 'B,2020-01-01,1,x,1,"Say ""Hi"" Inc",7,1', 'C,2020-01-01,1,"x,1",y', 'D,2020-01-01,1,"open, to the end,1,n,8,1',
        'E,2020-01-01,1,,, padded\t,"9",1,more', '"F",2020-01-01,"1"2,x,1,"","",', "G,2020-01-01,1,x,1,n\rm,10,1\r", "",
    ]
    path = write(tmp_path, "parts.csv", "h\n" + "\n".join(lines) + "\n")
    got = [(r.tic, r.gvkey, r.cnms, r.salecs) for r in readers.read_segments(spark, path).orderBy("ord").collect()]
    assert got == [("A", "1", "Abc,de", "6"), ("B", "1", "Say Hi Inc", "7"), ("E", "1", "padded", "9"), ("F", "12", "", ""), ("G", "1", "n\rm", "10")]


def test_sales_are_read_from_the_front(spark):
    firms = resolve.dictionary(spark.createDataFrame([(1, "ACM", "Acme")], "ord long, tic string, conm string"))
    funds = spark.createDataFrame([("1", dt.date(2020, 1, 1), 100.0)], "gvkey string, datadate date, sale double")
    texts = ["12 USD", "+3e1x", ".5", "5.", "USD 12", "", "-4", "nan", "1e999", "0", "7,000"]
    rows = spark.createDataFrame([(k, "S", dt.date(2020, 1, 1), "1", "acme", t) for k, t in enumerate(texts)], "ord long, tic string, srcdate date, gvkey string, cnms string, salecs string")
    got = {r.ord: (r.disposition, r.sales) for r in edges.classify(rows, firms, funds).collect()}
    assert [got[k] for k in range(4)] == [("valid", 12.0), ("valid", 30.0), ("valid", 0.5), ("valid", 5.0)] and got[10] == ("valid", 7.0)
    assert {got[k][0] for k in range(4, 10)} == {"no_sale"}


def test_a_hot_customer_is_no_hot_key(spark):
    """Half of all rows name one firm; the task that reads most of them reads under three times the median."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        name = F.when(F.col("id") % 2 == 0, "Hot Inc").otherwise(F.concat(F.lit("firm "), (F.col("id") % 997).cast("string")))
        rows = spark.range(40_000).select(F.col("id").alias("ord"), name.alias("name"), (F.col("id") % 10 > 0).alias("reaches"))
        counts = rows.where("reaches").groupBy("name").agg(F.count("*").alias("n"))
        found = counts.select("name", F.upper("name").alias("customer_tic"), F.lit(1).alias("match_tier"))
        joined = edges.with_firms(rows, found, counts)
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert sum(sizes) == 40_000 and sizes[-1] < 3 * sizes[len(sizes) // 2]
        assert joined.where("not (customer_tic <=> case when ord % 10 > 0 then upper(name) end)").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_scores_are_written_in_order(spark, tmp_path):
    score = F.when(F.col("id") % 11 == 0, F.lit(None).cast("double")).otherwise(F.sin(F.col("id").cast("double")))
    rows = spark.range(5000).select(F.col("id").cast("string").alias("customer_gvkey"), F.lit("s").alias("supplier_gvkey"), *(F.lit(1.0).alias(c) for c in ("w", "beta_fwd", "t_fwd", "beta_rev", "t_rev")), F.lit(30).cast("long").alias("n"), score.alias("score"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    writers.write_edge_scores(rows, str(tmp_path / "scores"))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(list((tmp_path / "scores").glob("part-*"))) > 1
    got = [r.score for r in readers.read_edge_scores(spark, str(tmp_path / "scores")).orderBy("rank").collect()]
    numbers = [s for s in got if s is not None]
    assert len(got) == 5000 and numbers == sorted(numbers, reverse=True) and got[len(numbers) :] == [None] * (5000 - len(numbers))


def test_first_lines_go_without_sorting_files(spark, tmp_path):
    """The first line of each file goes, be it short or empty; the same line further on stays."""
    header = "tic,srcdate,gvkey,conm,cid,cnms,salecs,sid"
    for name, lines in {"a": [header, header, "A,2020-01-01,1,,,x,5,"], "b": ["short", "B,2020-01-01,1,,,x,5,"], "c": ["", header, "C,2020-01-01,1,,,x,5,"], "d": ["only"]}.items():
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    rows = readers.read_segments(spark, str(tmp_path))
    assert sorted(r.tic for r in rows.collect()) == ["A", "B", "C", "tic", "tic"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Scan text" not in rows._jdf.queryExecution().executedPlan().toString()
