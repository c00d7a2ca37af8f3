"""Inputs of the registered queries, derived from the given tables; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelag.functions.text import zero_fill


#: From the last order dates to the days after the first returns.
DAYS_ON = 8227


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gvkey, date, r): the last event of a user's day."""
    last = Window.partitionBy("user_id", "date").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", F.to_date("ts").alias("date"))
    rows = rows.withColumn("rn", F.row_number().over(last)).where("rn = 1")
    return rows.select(zero_fill(F.col("user_id").cast("string")).alias("gvkey"), "date", ((F.col("value") - 50.0) / 1000.0).alias("r"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(customer_gvkey, supplier_gvkey, date, weight_wji) of all lines, by customer, supplier and day.

    Firms have the numbers of users, so those with returns grow with ``events``; order dates are
    moved on by one number of days, so that the last of them lie in and after the days of returns.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    grouped = joined.groupBy("o_custkey", "l_suppkey", F.to_date("o_orderdate").alias("day")).agg((F.max("l_extendedprice") / 200000.0).alias("weight_wji"))
    key = lambda c: zero_fill(F.col(c).cast("string"))
    return grouped.select(key("o_custkey").alias("customer_gvkey"), key("l_suppkey").alias("supplier_gvkey"), F.date_add("day", DAYS_ON).alias("date"), "weight_wji")


def firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, tic, conm) of customers, then suppliers."""
    one = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.concat(F.lit("C"), F.col("c_custkey")).alias("tic"), F.col("c_name").alias("conm"))
    two = table(spark, sf_dir, "supplier").select((1000000 + F.col("s_suppkey")).alias("ord"), F.concat(F.lit("S"), F.col("s_suppkey")).alias("tic"), F.col("s_name").alias("conm"))
    return one.union(two)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, tic, srcdate, gvkey, cnms, salecs): dirty edges that meet every outcome."""
    named = F.concat(F.lit(" "), F.replace(F.lower("c_name"), F.lit("#"), F.lit(" - ")), F.lit(", "))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), named.alias("customer"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.trunc("o_orderdate", "year").alias("srcdate"))
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.lower("s_name").alias("supplier"), F.concat(F.lit("S"), F.col("s_suppkey")).alias("tic"), zero_fill(F.col("s_suppkey").cast("string")).alias("gvkey")
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    joined = lines.join(orders.join(customers, "o_custkey").drop("o_custkey"), "l_orderkey").join(suppliers, "l_suppkey")
    kind = F.col("l_orderkey") % 10
    name = F.when(kind == 0, "U.S. Government").when(kind == 1, "Unknown Buyer").when(kind == 2, F.col("supplier")).otherwise(F.col("customer"))
    sales = F.when(kind == 3, "").when(kind == 4, "n/a").when(kind == 5, "-1.5").otherwise(F.col("l_extendedprice").cast("string"))
    return joined.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), "tic", "srcdate", "gvkey", name.alias("cnms"), sales.alias("salecs"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gvkey, datadate, sale) by supplier and year, without 1998."""
    orders = table(spark, sf_dir, "orders").where(F.year("o_orderdate") != 1998).select(F.col("o_orderkey").alias("l_orderkey"), F.trunc("o_orderdate", "year").alias("datadate"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    grouped = lines.join(orders, "l_orderkey").groupBy("l_suppkey", "datadate").agg((F.sum("l_extendedprice") / 50.0).alias("sale"))
    return grouped.select(zero_fill(F.col("l_suppkey").cast("string")).alias("gvkey"), "datadate", "sale")


def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tic, datadate, rdq)."""
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("C"), F.col("o_custkey")).alias("tic"), day.alias("datadate")).agg(F.max(F.date_add(day, 30)).alias("rdq"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name): names of several words."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name"))


SQL = {
    "v_returns": """select lpad(cast(user_id as varchar), 6, '0') as gvkey, d as date, (value - 50.0) / 1000.0 as r
from (select user_id, cast(ts as date) as d, value, row_number() over (partition by user_id, cast(ts as date) order by ts desc, event_id desc) as rn from events) q where rn = 1""",
    "v_edges": f"""select lpad(cast(o_custkey as varchar), 6, '0') as customer_gvkey, lpad(cast(l_suppkey as varchar), 6, '0') as supplier_gvkey,
cast(cast(o_orderdate as date) + {DAYS_ON} as date) as date, max(l_extendedprice) / 200000.0 as weight_wji
from lineitem join orders on l_orderkey = o_orderkey group by 1, 2, 3""",
    "v_firms": """select c_custkey as ord, concat('C', cast(c_custkey as varchar)) as tic, c_name as conm from customer
union all select 1000000 + s_suppkey, concat('S', cast(s_suppkey as varchar)), s_name from supplier""",
    "v_segments": """select l_orderkey * 10 + l_linenumber as ord, concat('S', cast(l_suppkey as varchar)) as tic, cast(date_trunc('year', o_orderdate) as date) as srcdate,
lpad(cast(l_suppkey as varchar), 6, '0') as gvkey,
case l_orderkey % 10 when 0 then 'U.S. Government' when 1 then 'Unknown Buyer' when 2 then lower(s_name) else concat(' ', replace(lower(c_name), '#', ' - '), ', ') end as cnms,
case l_orderkey % 10 when 3 then '' when 4 then 'n/a' when 5 then '-1.5' else cast(l_extendedprice as varchar) end as salecs
from lineitem join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey""",
    "v_fundamentals": """select lpad(cast(l_suppkey as varchar), 6, '0') as gvkey, cast(date_trunc('year', o_orderdate) as date) as datadate, sum(l_extendedprice) / 50.0 as sale
from lineitem join orders on l_orderkey = o_orderkey where extract(year from o_orderdate) <> 1998 group by 1, 2""",
    "v_earnings": """select concat('C', cast(o_custkey as varchar)) as tic, cast(o_orderdate as date) as datadate, max(cast(cast(o_orderdate as date) + 30 as date)) as rdq from orders group by 1, 2""",
    "v_names": """select p_partkey as id, concat(p_name, ' ', p_type, ' ', p_brand) as name from part""",
}
