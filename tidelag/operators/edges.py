"""From raw segments to weighted edges, with an outcome for every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelag.functions.clean import capped_share, leading_number
from tidelag.functions.text import IGNORED_NAMES, is_ignored, normalise, trim_blanks
from tidelag.operators.resolve import resolve
from tidelag.sources.shared import staged


def classify(segments: DataFrame, firms: DataFrame, fundamentals: DataFrame, ignored: tuple[str, ...] = IGNORED_NAMES, mode: str = "compat") -> DataFrame:
    """Every segment with ``disposition``, tested in this order: ignore, no_sale, unresolved,
    self_loop, no_fund, valid; and with what its edge needs.

    Segments are written once, with their names and sales read; what a name needs is found once for
    each distinct one. Only names of rows that get as far reach the resolver.
    """
    read = segments.select("ord", "tic", "srcdate", "gvkey", trim_blanks(F.coalesce("cnms", F.lit(""))).alias("name"), leading_number(F.col("salecs")).alias("sales"))
    rows = staged(read, "segment-rows")
    names = staged(rows.groupBy("name").agg(F.count_if(F.col("sales") > 0).alias("n")).withColumn("ignored", is_ignored(normalise(F.col("name")), ignored)), "names")
    out = staged(names.where("ignored"), "ignored-names").select("name", "ignored")
    rows = rows.join(out, "name", "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))
    reaches = F.coalesce(~F.col("ignored") & (F.col("sales") > 0), F.lit(False))
    asked = names.where("not ignored and n > 0").select("name", "n")
    found = staged(resolve(asked, firms, mode).select("name", F.col("tic").alias("customer_tic"), F.col("tier").alias("match_tier")), "resolved-names")
    funds = fundamentals.where("sale > 0").select("gvkey", F.col("datadate").alias("srcdate"), F.col("sale").alias("total_sale"))
    joined = with_firms(rows.withColumn("reaches", reaches), found, asked).join(funds, ["gvkey", "srcdate"], "left").withColumn("norm", normalise(F.col("name")))
    outcome = (
        F.when(F.col("ignored"), "ignore")
        .when(F.coalesce(F.col("sales") > 0, F.lit(False)) == False, "no_sale")  # noqa: E712
        .when(F.col("customer_tic").isNull(), "unresolved")
        .when(F.col("customer_tic") == F.col("tic"), "self_loop")
        .when(F.col("total_sale").isNull(), "no_fund")
        .otherwise("valid")
    )
    return joined.withColumn("disposition", outcome).withColumn("weight_wji", capped_share(F.col("sales"), F.col("total_sale")))


def with_firms(rows: DataFrame, found: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` (ord, name, reaches) with what ``found`` says of their names; ``reaches`` goes.

    ``counts`` (name, n) tells the names that more than one of ``shuffle.partitions`` parts of all
    rows have: they are fewer than the parts, so their firms are broadcast. Their rows, and those
    that need no firm, get keys of their own that no name has, so that no key of the join is hot.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * parts > total).select("name")
    of_hot = found.join(hot, "name", "left_semi").select(F.col("name").alias("hot_name"), F.col("customer_tic").alias("hot_tic"), F.col("match_tier").alias("hot_tier"))
    marked = rows.join(F.broadcast(of_hot), F.col("reaches") & (F.col("name") == F.col("hot_name")), "left")  # fewer than parts rows
    key = F.when(F.col("reaches") & F.col("hot_name").isNull(), F.col("name")).otherwise(F.concat(F.lit("\n"), F.xxhash64("ord").cast("string")))
    joined = marked.withColumn("key", key).join(found.withColumnRenamed("name", "key"), "key", "left")
    known = joined.withColumns({"customer_tic": F.coalesce("hot_tic", "customer_tic"), "match_tier": F.coalesce("hot_tier", "match_tier")})
    return known.drop("key", "reaches", "hot_name", "hot_tic", "hot_tier")


OUTCOMES = ("ignore", "no_sale", "unresolved", "self_loop", "no_fund", "valid")


def counters() -> list[Column]:
    """What the report of a run counts, as aggregates of classified rows, to be observed as they are written."""
    valid = F.col("disposition") == "valid"
    weight = F.when(valid, F.col("weight_wji"))
    return [
        F.count("*").alias("rows"), *(F.count_if(F.col("disposition") == o).alias(o) for o in OUTCOMES),
        F.sum(weight).alias("weight_sum"), F.max(weight).alias("weight_max"), *(F.count_if(valid & (F.col("match_tier") == k)).alias(f"edges_tier{k}") for k in (1, 2, 3)),
    ]


def report(figures: dict, names: dict[int, int], customers: int, suppliers: int) -> list[str]:
    """Lines on a run: its rows by outcome, weights, distinct names by tier of their match, and the graph."""
    n = figures["valid"]
    lines = [("rows read", figures["rows"]), *((f"rows {o}", figures[o]) for o in OUTCOMES), ("mean weight", f"{(figures['weight_sum'] or 0.0) / n if n else 0.0:.4f}"), ("max weight", f"{figures['weight_max'] or 0.0:.4f}")]
    lines += [(f"names tier {k}" if k else "names unresolved", names.get(k, 0)) for k in (1, 2, 3, 0)] + [(f"edges tier {k}", figures[f"edges_tier{k}"]) for k in (1, 2, 3)]
    return [f"{what}: {value}" for what, value in (*lines, ("customers", customers), ("suppliers", suppliers), ("edges", n))]


def edge_list(classified: DataFrame) -> DataFrame:
    """The valid rows; what they must be is also said of the columns, so that the others go before the joins."""
    return classified.where("disposition = 'valid' and not ignored and sales > 0 and total_sale is not null").select(
        "ord", F.col("srcdate").alias("date"), "customer_tic", F.col("tic").alias("supplier_tic"), F.col("gvkey").alias("supplier_gvkey"),
        F.col("sales").alias("salecs"), "total_sale", "weight_wji", "match_tier",
    )


def dispositions(classified: DataFrame) -> DataFrame:
    return classified.groupBy("disposition").agg(F.count("*").alias("n"))


def edge_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("n_edges"), F.avg("weight_wji").alias("mean_weight"), F.max("weight_wji").alias("max_weight"))


def graph_summary(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count_distinct("customer_tic").alias("customers"), F.count_distinct("supplier_tic").alias("suppliers"), F.count_distinct("date").alias("dates"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(date, supplier_tic, neighbors): customers with weights in the order of the edges, repeats kept."""
    grouped = edges.groupBy("date", "supplier_tic").agg(F.sort_array(F.collect_list(F.struct("ord", "customer_tic", F.col("weight_wji").alias("weight")))).alias("neighbors"))
    return grouped.withColumn("neighbors", F.transform("neighbors", lambda n: F.struct(n["customer_tic"].alias("customer_tic"), n["weight"].alias("weight"))))


def earnings_calendar(earnings: DataFrame, edges: DataFrame) -> DataFrame:
    """Report dates of the firms that are customers in the graph."""
    customers = edges.select(F.col("customer_tic").alias("tic")).distinct()
    return earnings.join(customers, "tic", "left_semi").select("tic", F.col("datadate").alias("fiscal_period_end"), F.col("rdq").alias("report_date_rdq"))


def to_ids(edges: DataFrame, metadata: DataFrame) -> DataFrame:
    """Edges between tickers as edges between firm ids, for the panel and the matrix."""
    from tidelag.functions.text import zero_fill
    from tidelag.operators.dedupe import first_value

    ids = first_value(metadata.where("gvkey <> ''"), ["tic"], "gvkey", "ord").withColumnRenamed("tic", "customer_tic")
    return edges.join(ids, "customer_tic").select(
        zero_fill(F.col("gvkey")).alias("customer_gvkey"), zero_fill(F.col("supplier_gvkey")).alias("supplier_gvkey"), "date", "weight_wji", "ord"
    )
