import datetime as dt

from tidelag.streaming.signal import streaming_signal


def test_stream_of_returns(spark, tmp_path):
    days = [dt.datetime(2024, 1, d, 12) for d in (1, 2, 20)]
    spark.createDataFrame([("c", d, 0.5) for d in days], "gvkey string, ts timestamp, r double").write.parquet(str(tmp_path / "in"))
    edges = spark.createDataFrame([("c", "s", dt.date(2024, 1, 1), 2.0, 1)], "customer_gvkey string, supplier_gvkey string, date date, weight_wji double, ord long")
    stream = spark.readStream.schema("gvkey string, ts timestamp, r double").parquet(str(tmp_path / "in"))
    out = streaming_signal(stream, edges, "supplier_gvkey", "customer_gvkey", "y")
    q = out.writeStream.format("memory").queryName("signals").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r.date.day: r.y for r in spark.table("signals").collect()} == {1: 1.0, 2: 1.0, 20: 1.0}


def test_streamed_edges_equal_the_batch_signal(spark, tmp_path):
    """Rows of both streams in any order within the delay; ties and several rows of a day included."""
    import random

    from pyspark.sql import functions as F

    from tidelag.operators import asof
    from tidelag.sources.readers import clean_returns
    from tidelag.streaming.asof import streaming_asof

    rng, start = random.Random(4), dt.datetime(2024, 1, 1)
    returns = [(f"c{i % 3}", start + dt.timedelta(days=rng.randrange(12), seconds=rng.randrange(86_400)), round(rng.uniform(-1, 1), 3)) for i in range(80)]
    edges = [(f"c{i % 3}", f"s{rng.randrange(4)}", (start + dt.timedelta(days=rng.randrange(12))).date(), round(rng.uniform(0, 1), 3), i) for i in range(60)]
    last = [("end", start + dt.timedelta(days=40), 0.0)], [("end", "end", dt.date(2024, 2, 10), 0.0, 0)]
    kinds = "gvkey string, ts timestamp, r double", "customer_gvkey string, supplier_gvkey string, date date, weight_wji double, ord long"
    rng.shuffle(returns)
    rng.shuffle(edges)
    for k, (parts, kind) in enumerate(zip(((returns[:50], returns[50:], last[0], last[0]), (edges[:20], edges[20:], last[1], last[1])), kinds)):
        for i, part in enumerate(parts):
            spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}" / f"step={i}"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        one, two = (spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in{k}" / "*")) for k, kind in enumerate(kinds))
        out = streaming_asof(one, two, "supplier_gvkey", "customer_gvkey", "y", "20 days")
        q = out.writeStream.format("memory").queryName("contributions").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.unset(provider)
    got = spark.table("contributions").where("supplier_gvkey <> 'end'")
    assert got.count() == got.select("supplier_gvkey", "customer_gvkey", "date").distinct().count()
    sums = {(r.supplier_gvkey, r.date): r.y for r in got.groupBy("supplier_gvkey", "date").agg(F.sum("y").alias("y")).collect()}
    raw = spark.createDataFrame(returns, kinds[0])
    daily = clean_returns(raw.select("gvkey", F.col("ts").alias("date"), F.col("r").alias("RET"), F.struct("ts", "r").alias("k")), order="k")
    ids = lambda c: F.lpad(F.col(c), 6, "0").alias(c)
    known = spark.createDataFrame(edges, kinds[1]).select(ids("customer_gvkey"), "supplier_gvkey", "date", "weight_wji", "ord")
    wanted = {(r.supplier_gvkey, r.date): r.y for r in asof.signal(daily, known, "supplier_gvkey", "customer_gvkey", "y").collect()}
    assert sums.keys() == wanted.keys() and all(abs(sums[k] - wanted[k]) < 1e-12 for k in wanted)
