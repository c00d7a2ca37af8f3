"""The registered queries of the reference operators, with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.functions import clean, text
from tidelag.operators import asof, dedupe, edges, matrix, panel, panelreg, resolve, spectral, stats
from tidelag.plans import views
from tidelag.sources import readers, writers
from tidelag.sources.shared import new_path, staged

#: Defaults of the library, but for the least observations: the tables have 30 days of returns.
HORIZON, MIN_OBS, WINSOR, PERMUTATIONS, SEED = 5, 20, 0.001, 500, 42
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL if there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def rounded(rows: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Doubles rounded by floor, the same in every engine, so that the order of a sum does not show."""
    unit = 10.0**places
    return rows.withColumns({c: F.floor(F.col(c) * unit + 0.5) / unit for c in columns})


def r6(expr: str, name: str) -> str:
    return f"floor(({expr}) * 1000000.0 + 0.5) / 1000000.0 as {name}"


def using(sql: str, *more: tuple[str, str]) -> str:
    """SQL with the views that it names in front."""
    ctes: dict[str, str] = {}

    def need(q: str) -> None:
        for name, body in {**views.SQL, **dict(more)}.items():
            if name not in ctes and re.search(rf"\b{name}\b", q):
                need(body)
                ctes[name] = body

    need(sql)
    return "with " + ", ".join(f"{n} as ({b})" for n, b in ctes.items()) + " " + sql


# Names and numbers

NORM = "upper(regexp_replace({}, '[^A-Za-z0-9]', '', 'g'))"
TOKENS = "list_filter(string_split_regex(upper({}), '[^A-Z0-9]+'), lambda t: t <> '')"
SUFFIXES = "[" + ", ".join(f"'{w}'" for w in text.SUFFIX_WORDS) + "]"
STRIPPED = f"array_to_string(list_filter({TOKENS}, lambda t: not list_contains({SUFFIXES}, t)), '')"
#: A suffix behind each name, by its number, for the queries on suffixes.
TAILS = ("Inc.", "Holdings Group", "Company of the Americas", "& Co", "International LLC")


def tailed(name: Column, number: Column) -> Column:
    tail = reduce(lambda acc, k: acc.when(number % 5 == k, TAILS[k]), range(1, 5), F.when(number % 5 == 0, TAILS[0]))
    return F.concat_ws(" ", name, tail)


TAILED = "concat({0}, ' ', case {1} % 5 " + " ".join(f"when {k} then '{t}'" for k, t in enumerate(TAILS)) + " end)"


@query(f"select c_custkey as id, {NORM.format('c_name')} as norm_name from customer union all select p_partkey, {NORM.format('p_name')} from part")
def normalise_name(spark, sf_dir):
    one = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.normalise(F.col("c_name")).alias("norm_name"))
    return one.union(views.table(spark, sf_dir, "part").select("p_partkey", text.normalise(F.col("p_name"))))


@query(using(f"select id, array_to_string({TOKENS.format('name')}, ' ') as tokens, len({TOKENS.format('name')}) as n_tokens from v_names"))
def tokenise_name(spark, sf_dir):
    words = text.tokens(F.col("name"))
    return views.names(spark, sf_dir).select("id", F.array_join(words, " ").alias("tokens"), F.size(words).cast("long").alias("n_tokens"))


@query(f"select c_custkey as id, {STRIPPED.format(TAILED.format('c_name', 'c_custkey'))} as stripped from customer")
def strip_suffixes(spark, sf_dir):
    return views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.strip_suffixes(tailed(F.col("c_name"), F.col("c_custkey"))).alias("stripped"))


WORDS = ("v_words", f"select id, unnest(list_distinct({TOKENS.format('name')})) as word, len(list_distinct({TOKENS.format('name')})) as n from v_names")


@query(using("""select a.id as a, b.id as b, floor((count(*) / (first(a.n) + first(b.n) - count(*))) * 1000000.0 + 0.5) / 1000000.0 as score from v_words a join v_words b on a.word = b.word and a.id < b.id
group by 1, 2 having count(*) / (first(a.n) + first(b.n) - count(*)) >= 0.8""", WORDS))
def jaccard_pairs(spark, sf_dir):
    rows = views.names(spark, sf_dir).select("id", text.tokens(F.col("name")).alias("tokens"))
    pairs = resolve.token_pairs(rows, rows, "id", "id", 0.8, ordered=True)
    return rounded(pairs.select(F.col("k1").alias("a"), F.col("k2").alias("b"), "score"), "score")


@query("select l_orderkey, l_linenumber, case when length(cast(l_orderkey * 7 as varchar)) < 6 then lpad(cast(l_orderkey * 7 as varchar), 6, '0') else cast(l_orderkey * 7 as varchar) end as id from lineitem")
def zfill_ids(spark, sf_dir):
    return views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.zero_fill((F.col("l_orderkey") * 7).cast("string")).alias("id"))


@query(using("""select ord, case when isfinite(try_cast(salecs as double)) then try_cast(salecs as double) end as number, lpad(cast(ord % 1000 as varchar), 6, '0') as id,
case when ord % 3 = 0 then null else lpad(cast(ord % 1000 as varchar), 6, '0') end as typed_id from v_segments"""))
def clean_numeric(spark, sf_dir):
    whole = F.concat((F.col("ord") % 1000).cast("string"), F.lit(".0"))
    mixed = F.when(F.col("ord") % 3 == 0, "x").otherwise(whole)
    return views.segments(spark, sf_dir).select("ord", clean.to_number(F.col("salecs")).alias("number"), clean.float_text_id(whole).alias("id"), clean.float_text_id(mixed).alias("typed_id"))


@query(using("select gvkey, date, floor((ln(1 + r * 20)) * 1000000.0 + 0.5) / 1000000.0 as r from v_returns where r * 20 > -1 union all select gvkey, date, null from v_returns where not r * 20 > -1"))
def log_returns(spark, sf_dir):
    return rounded(views.returns(spark, sf_dir).select("gvkey", "date", clean.log_return(F.col("r") * 20).alias("r")), "r")


# First and last rows


@query("select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderkey) = 1")
def dedupe_first(spark, sf_dir):
    rows = views.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return dedupe.keep_first(rows, ["o_custkey"], "o_orderkey")


@query(using("select gvkey, date, floor((r) * 1000000.0 + 0.5) / 1000000.0 as r from v_returns"))
def dedupe_last(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("gvkey"), "ts", F.to_date("ts").alias("date"), ((F.col("value") - 50.0) / 1000.0).alias("RET"), F.struct("ts", "event_id").alias("place")
    )
    return rounded(readers.clean_returns(rows, order="place"), "r")


@query("select l_suppkey, max_by(l_extendedprice, (l_orderkey * 10 + l_linenumber) * 10000000.0 + l_extendedprice) as price from lineitem where l_extendedprice > 0 group by 1")
def last_write_map(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").where("l_extendedprice > 0").select("l_suppkey", F.col("l_extendedprice").alias("price"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10000000.0 + F.col("l_extendedprice")).alias("ord"))
    return dedupe.last_value(rows, ["l_suppkey"], "price", "ord")


@query("select l_suppkey, min_by(l_extendedprice, (l_orderkey * 10 + l_linenumber) * 10000000.0 + l_extendedprice) as price from lineitem group by 1")
def first_write_map(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("price"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10000000.0 + F.col("l_extendedprice")).alias("ord"))
    return dedupe.first_value(rows, ["l_suppkey"], "price", "ord")


# Resolver


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.dictionary(views.firms(spark, sf_dir))


FIRMS = ("v_dict", f"select ord, tic, conm, {NORM.format('conm')} as norm_name, {STRIPPED.format('conm')} as stripped, {TOKENS.format('conm')} as tokens from v_firms qualify row_number() over (partition by {NORM.format('conm')} order by ord) = 1")
ASKED = ("v_asked", f"select distinct cnms as name, {NORM.format('cnms')} as norm from v_segments")


@query(using("select name, norm, tic, case when tic is not null then 1 else 0 end as tier from v_asked left join v_dict on norm = norm_name", FIRMS, ASKED))
def resolve_exact(spark, sf_dir):
    return resolve.resolve(views.segments(spark, sf_dir).select(F.col("cnms").alias("name")), dictionary(spark, sf_dir)).withColumn("tier", F.coalesce("tier", F.lit(0)))


DIRTY = ("v_dirty", f"select distinct {TAILED.format('c_name', 'c_custkey')} as name from customer")


@query(using(f"select name, tic from (select name, {STRIPPED.format('name')} as s from v_dirty) d left join (select stripped, min_by(tic, ord) as tic from v_dict where stripped <> '' group by 1) f on s = stripped", FIRMS, DIRTY))
def resolve_stripped(spark, sf_dir):
    names = views.table(spark, sf_dir, "customer").select(tailed(F.col("c_name"), F.col("c_custkey")).alias("name")).distinct()
    return resolve.stripped(names, dictionary(spark, sf_dir)).select("name", "tic")


PARTS = ("v_parts", f"select id as ord, concat('P', cast(id as varchar)) as tic, {TOKENS.format('name')} as tokens from v_names")
QUERY_WORDS = ("v_qwords", f"select name, unnest(t) as word, len(t) as n from (select name, list_distinct({TOKENS.format('name')}) as t from (select distinct concat(p_type, ' ', p_name) as name from part))")
PART_WORDS = ("v_pwords", "select ord, tic, unnest(list_distinct(tokens)) as word, len(list_distinct(tokens)) as n from v_parts")


@query(using("""select name, tic, floor((score) * 1000000.0 + 0.5) / 1000000.0 as score from (select q.name, p.ord, first(p.tic) as tic, count(*) / (first(q.n) + first(p.n) - count(*)) as score
from v_qwords q join v_pwords p on q.word = p.word group by 1, 2) where score >= 0.6 qualify row_number() over (partition by name order by score desc, ord) = 1""", PARTS, QUERY_WORDS, PART_WORDS))
def resolve_jaccard(spark, sf_dir):
    firms = views.names(spark, sf_dir).select(F.col("id").alias("ord"), F.concat(F.lit("P"), F.col("id")).alias("tic"), text.tokens(F.col("name")).alias("tokens"))
    asked = views.table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_type", "p_name").alias("name")).distinct()
    return rounded(resolve.best_jaccard(asked, firms), "score")


# Edges

IGNORED = "(" + ", ".join(f"'{n}'" for n in text.IGNORED_NAMES) + ")"
CLASSIFIED = ("v_classified", f"""select s.*, d.tic as customer_tic, n as sales, f.sale as total_sale, case when n / f.sale > 1 then 1.0 else n / f.sale end as weight_wji,
case when norm in {IGNORED} then 'ignore' when n is null or n <= 0 then 'no_sale' when d.tic is null then 'unresolved' when d.tic = s.tic then 'self_loop' when f.sale is null then 'no_fund' else 'valid' end as disposition
from (select *, {NORM.format('cnms')} as norm, try_cast(salecs as double) as n from v_segments) s left join v_dict d on norm = norm_name left join v_fundamentals f on s.gvkey = f.gvkey and s.srcdate = f.datadate""")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.classify(views.segments(spark, sf_dir), dictionary(spark, sf_dir), views.fundamentals(spark, sf_dir))


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.edge_list(classified(spark, sf_dir))


VALID = ("v_graph", "select ord, srcdate as date, customer_tic, tic as supplier_tic, gvkey as supplier_gvkey, sales as salecs, total_sale, weight_wji, 1 as match_tier from v_classified where disposition = 'valid'")


@query(using("select ord, date, customer_tic, supplier_tic, supplier_gvkey, floor((salecs) * 1000000.0 + 0.5) / 1000000.0 as salecs, floor(total_sale * 10000.0 + 0.5) / 10000.0 as total_sale, floor((weight_wji) * 1000000.0 + 0.5) / 1000000.0 as weight_wji, match_tier from v_graph", FIRMS, CLASSIFIED, VALID))
def edge_list(spark, sf_dir):
    return rounded(rounded(graph(spark, sf_dir), "salecs", "weight_wji"), "total_sale", places=4)


@query(using("select disposition, count(*) as n from v_classified group by 1", FIRMS, CLASSIFIED))
def edge_dispositions(spark, sf_dir):
    return edges.dispositions(classified(spark, sf_dir))


@query(using("select cast(case when customer_tic is not null then 1 else 0 end as int) as tier, count(distinct norm) as names from v_classified where disposition not in ('ignore', 'no_sale') and norm <> '' group by 1", FIRMS, CLASSIFIED))
def resolver_stats(spark, sf_dir):
    """Only names that reach the resolver count."""
    asked = classified(spark, sf_dir).where("disposition not in ('ignore', 'no_sale')").select("name")
    return resolve.stats(resolve.resolve(asked, dictionary(spark, sf_dir)))


@query(using(f"select count(*) as n_edges, {r6('avg(weight_wji)', 'mean_weight')}, {r6('max(weight_wji)', 'max_weight')} from v_graph", FIRMS, CLASSIFIED, VALID))
def edge_stats(spark, sf_dir):
    return rounded(edges.edge_stats(graph(spark, sf_dir)), "mean_weight", "max_weight")


@query(using("select count(distinct customer_tic) as customers, count(distinct supplier_tic) as suppliers, count(distinct date) as dates from v_graph", FIRMS, CLASSIFIED, VALID))
def graph_summary(spark, sf_dir):
    return edges.graph_summary(graph(spark, sf_dir))


@query(using("select date, supplier_tic, string_agg(concat(customer_tic, ':', cast(floor(weight_wji * 1000 + 0.5) as bigint)), '|' order by ord, customer_tic, weight_wji) as neighbors from v_graph group by 1, 2", FIRMS, CLASSIFIED, VALID))
def adjacency_list(spark, sf_dir):
    rows = edges.adjacency(graph(spark, sf_dir))
    return rows.select("date", "supplier_tic", F.array_join(F.transform("neighbors", lambda n: F.concat_ws(":", n["customer_tic"], F.floor(n["weight"] * 1000 + 0.5).cast("bigint").cast("string"))), "|").alias("neighbors"))


@query(using("select tic, datadate as fiscal_period_end, rdq as report_date_rdq from v_earnings where tic in (select customer_tic from v_graph)", FIRMS, CLASSIFIED, VALID))
def earnings_calendar(spark, sf_dir):
    return edges.earnings_calendar(views.earnings(spark, sf_dir), graph(spark, sf_dir))


@query(using(f"select ord, cnms from v_segments where {NORM.format('cnms')} not in {IGNORED}"))
def ignore_anti_join(spark, sf_dir):
    return views.segments(spark, sf_dir).where(~text.is_ignored(text.normalise(F.col("cnms")))).select("ord", "cnms")


EDGE_TEXT = "strftime(date, '%Y-%m-%d') as date, customer_tic, supplier_tic, supplier_gvkey, printf('%.6f', salecs) as salecs, printf('%.6f', total_sale) as total_sale, printf('%.6f', weight_wji) as weight_wji"


@query(using(f"select ord, {EDGE_TEXT}, match_tier from v_graph", FIRMS, CLASSIFIED, VALID))
def format_edges(spark, sf_dir):
    return writers.edge_rows(graph(spark, sf_dir))


# Resolution in all three tiers

CASCADE = ("v_cascade", f"""select distinct case c_custkey % 4 when 0 then lower(c_name) when 1 then {TAILED.format('c_name', 'c_custkey')}
when 2 then concat(split_part(c_name, '#', 2), ' of ', split_part(c_name, '#', 1)) else concat('Nobody ', c_custkey) end as name from customer""")
TIERS = (
    FIRMS, CASCADE,
    ("v_one", f"select name, {NORM.format('name')} as norm, tic from v_cascade left join v_dict on {NORM.format('name')} = norm_name"),
    ("v_two", f"select name, f.tic from (select name, {STRIPPED.format('name')} as s from v_one where tic is null) d join (select stripped, min_by(tic, ord) as tic from v_dict where stripped <> '' group by 1) f on s = stripped"),
    ("v_open", f"select name, unnest(list_distinct({TOKENS.format('name')})) as word, len(list_distinct({TOKENS.format('name')})) as n from v_one where tic is null and name not in (select name from v_two)"),
    ("v_dictwords", "select ord, tic, unnest(list_distinct(tokens)) as word, len(list_distinct(tokens)) as n from v_dict"),
    ("v_three", """select name, tic from (select q.name, p.ord, first(p.tic) as tic, count(*) / (first(q.n) + first(p.n) - count(*)) as score
from v_open q join v_dictwords p on q.word = p.word group by 1, 2) where score >= 0.6 qualify row_number() over (partition by name order by score desc, ord) = 1"""),
)


@query(using("""select name, norm, coalesce(v_one.tic, v_two.tic, v_three.tic) as tic, cast(case when v_one.tic is not null then 1 when v_two.tic is not null then 2 when v_three.tic is not null then 3 else 0 end as int) as tier
from v_one left join v_two using (name) left join v_three using (name)""", *TIERS))
def resolve_tokens(spark, sf_dir):
    name, key = F.col("c_name"), F.col("c_custkey")
    part = lambda k: F.element_at(F.split(name, "#"), k)
    asked = F.when(key % 4 == 0, F.lower(name)).when(key % 4 == 1, tailed(name, key)).when(key % 4 == 2, F.concat(part(2), F.lit(" of "), part(1))).otherwise(F.concat(F.lit("Nobody "), key))
    names = views.table(spark, sf_dir, "customer").select(asked.alias("name"))
    return resolve.resolve(names, dictionary(spark, sf_dir), "tokens").withColumn("tier", F.coalesce("tier", F.lit(0)))


# Files: derived tables are written to the shared folder and read again


def csv_of(spark: SparkSession, rows: DataFrame, name: str, *order: str) -> str:
    """The path of a CSV with a header whose files hold ``rows`` in order."""
    path = new_path(spark, name)
    rows.orderBy(*order).drop(*order).write.option("header", True).csv(path)
    return path


def blank(*names: str) -> list[Column]:
    return [F.lit("").alias(n) for n in names]


@query(using("select tic, srcdate, gvkey, trim(cnms) as cnms, salecs from v_segments"))
def read_segments(spark, sf_dir):
    rows = views.segments(spark, sf_dir).select("ord", "tic", "srcdate", "gvkey", *blank("conm", "cid"), "cnms", "salecs", *blank("sid"))
    return readers.read_segments(spark, csv_of(spark, rows, "segments", "ord")).drop("ord")


@query(using("select tic, srcdate, gvkey, trim(concat(cnms, ', x')) as cnms, salecs from v_segments"))
def read_quoted_segments(spark, sf_dir):
    """Names with a quote inside a field, and commas between quotes; every tenth line has a field too few."""
    dirty = F.concat(F.substring("cnms", 1, 3), F.lit('"'), F.expr("substring(cnms, 4)"), F.lit(', "x'))
    line = F.concat_ws(",", "tic", F.col("srcdate").cast("string"), F.concat(F.lit('"'), "gvkey", F.lit('"')), F.lit('"a, b"'), F.lit(""), dirty, "salecs", F.lit(""))
    rows = views.segments(spark, sf_dir).select("ord", line.alias("line"))
    short = rows.where("ord % 10 = 0").select("ord", F.lit('"tic,srcdate",gvkey,"conm,cid","cnms,salecs",sid').alias("line"))
    path = new_path(spark, "quoted")
    rows.union(short).orderBy("ord").select(F.col("line").alias("header")).write.option("header", True).option("sep", "\x01").option("quote", "\x00").option("escapeQuotes", False).csv(path)
    return readers.read_segments(spark, path).drop("ord")


@query(using(f"select tic, '' as gvkey, conm, {NORM.format('conm')} as norm_name, true as active from v_firms"))
def read_metadata(spark, sf_dir):
    """Each firm is named again further on, in other letters; the first line stays."""
    firms = views.firms(spark, sf_dir)
    both = firms.select(F.lit(0).alias("again"), "ord", "tic", "conm").union(firms.select(F.lit(1), "ord", F.concat(F.lit("X"), "tic"), F.lower("conm")))
    rows = both.select("again", "ord", F.lit("A").alias("costat"), *blank("curcd", "datafmt", "indfmt", "consol"), "tic", *blank("datadate", "gvkey"), "conm")
    return readers.read_metadata(spark, csv_of(spark, rows, "metadata", "again", "ord")).drop("ord")


@query(using("select gvkey, datadate, floor(2 * sale * 10000.0 + 0.5) / 10000.0 as sale from v_fundamentals"))
def read_fundamentals(spark, sf_dir):
    """Three lines for each key: the last sale that is positive counts."""
    sales = F.explode(F.array(*(F.struct(F.lit(k).alias("turn"), (F.col("sale") * x).alias("sale")) for k, x in enumerate((1, 2, -1))))).alias("s")
    lines = views.fundamentals(spark, sf_dir).select("gvkey", "datadate", sales).select("s.turn", "datadate", "gvkey", "s.sale")
    rows = lines.select("turn", F.xxhash64("gvkey", "datadate").alias("spread"), *blank("costat", "curcd", "datafmt", "indfmt", "consol", "tic"), "datadate", "gvkey", *blank("conm", "fyr", "gsector", "at"), "sale", *blank("sich"))
    return rounded(readers.read_fundamentals(spark, csv_of(spark, rows, "fundamentals", "turn", "spread")), "sale", places=4)


@query(using("select * from v_earnings"))
def read_earnings(spark, sf_dir):
    """Two lines for each key: the last report date counts, also where it is the earlier one."""
    dates = F.explode(F.array(*(F.struct(F.lit(k).alias("turn"), F.date_add("rdq", d).alias("rdq")) for k, d in enumerate((5, 0))))).alias("d")
    lines = views.earnings(spark, sf_dir).select("tic", "datadate", dates)
    rows = lines.select("d.turn", F.xxhash64("tic", "datadate").alias("spread"), *blank("costat", "curcdq", "datafmt", "indfmt", "consol"), "tic", "datadate", *blank("gvkey"), "d.rdq")
    return readers.read_earnings(spark, csv_of(spark, rows, "earnings", "turn", "spread"))


@query(using("select gvkey, date, floor((r) * 1000000.0 + 0.5) / 1000000.0 as r from v_returns"))
def read_returns(spark, sf_dir):
    """Of several rows of a day the last one in the order of the files counts."""
    path = new_path(spark, "returns")
    rows = views.table(spark, sf_dir, "events").orderBy("ts", "event_id").select(F.col("user_id").alias("gvkey"), F.col("ts").alias("date"), ((F.col("value") - 50.0) / 1000.0).alias("RET"))
    rows.write.parquet(path)
    return rounded(readers.read_returns(spark, path), "r")


@query(using("select customer_gvkey, supplier_gvkey, date, floor((weight_wji) * 1000000.0 + 0.5) / 1000000.0 as weight_wji from v_edges where abs(weight_wji) >= 0.2"))
def read_merged_edges(spark, sf_dir):
    as_float = lambda c: F.concat(F.col(c).cast("long").cast("string"), F.lit(".0")).alias(c)
    rows = views.edges(spark, sf_dir).select("date", F.col("date").alias("srcdate"), F.col("supplier_gvkey").cast("long").alias("supplier_gvkey"), as_float("customer_gvkey"), "weight_wji")
    return rounded(readers.read_merged_edges(spark, csv_of(spark, rows, "merged", "date"), min_weight=0.2).drop("ord"), "weight_wji")


@query(using("select customer_gvkey as i, supplier_gvkey as j, floor(max(weight_wji) * 1000000.0 + 0.5) / 1000000.0 as value from v_edges group by 1, 2"))
def read_matrix(spark, sf_dir):
    path = new_path(spark, "matrix")
    writers.write_table(views.edges(spark, sf_dir).groupBy(F.col("customer_gvkey").alias("i"), F.col("supplier_gvkey").alias("j")).agg(F.max("weight_wji").alias("value")), path)
    return rounded(readers.read_matrix(spark, path), "value")


def text_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


@query(using(f"select {EDGE_TEXT}, '1' as match_tier from v_graph", FIRMS, CLASSIFIED, VALID))
def write_edge_list(spark, sf_dir):
    path = new_path(spark, "edges")
    writers.write_edge_list(graph(spark, sf_dir), path)
    return text_of(spark, path)


@query(using("select strftime(date, '%Y-%m-%d') as date, supplier_tic, string_agg(concat(customer_tic, ':', printf('%.6f', weight_wji)), '|' order by ord, customer_tic, weight_wji) as neighbors from v_graph group by date, supplier_tic", FIRMS, CLASSIFIED, VALID))
def write_adjacency(spark, sf_dir):
    path = new_path(spark, "adjacency")
    writers.write_adjacency(edges.adjacency(graph(spark, sf_dir)), path)
    return text_of(spark, path)


@query(using("select tic, strftime(datadate, '%Y-%m-%d') as fiscal_period_end, strftime(rdq, '%Y-%m-%d') as report_date_rdq from v_earnings where tic in (select customer_tic from v_graph)", FIRMS, CLASSIFIED, VALID))
def write_calendar(spark, sf_dir):
    path = new_path(spark, "calendar")
    writers.write_calendar(edges.earnings_calendar(views.earnings(spark, sf_dir), graph(spark, sf_dir)), path)
    return text_of(spark, path)


# Reports on tables of results, here with balances and prices in the place of coefficients and eigenvalues


@query(f"select c_nationkey as h, {r6('avg(c_acctbal)', 'beta')}, {r6('stddev_samp(c_acctbal)', 'se')}, {r6('avg(c_acctbal) - 1.96 * stddev_samp(c_acctbal)', 'low')}, {r6('avg(c_acctbal) + 1.96 * stddev_samp(c_acctbal)', 'high')} from customer group by 1")
def profile_band(spark, sf_dir):
    results = views.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("h")).agg(F.avg("c_acctbal").alias("beta"), F.stddev_samp("c_acctbal").alias("se"))
    return rounded(panelreg.horizon_profile(results), "beta", "se", "low", "high")


@query(f"""with b as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders)
select cast(least({spectral.BINS - 1}, floor({spectral.BINS} * (o_totalprice - lo) / (hi - lo))) as int) as bin, count(*) as n from orders, b group by 1""")
def histogram_of_values(spark, sf_dir):
    return spectral.histogram(views.table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("null_maxeig")))


@query(f"select 200000.0::double as obs_maxeig, count(*) filter (o_totalprice >= 200000.0) as exceed, count(*) as n_perm, {r6('(1 + count(*) filter (o_totalprice >= 200000.0)) / (1 + count(*))', 'p_value')} from orders")
def p_value_of_values(spark, sf_dir):
    return rounded(spectral.permutation_p(views.table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("null_maxeig")), 200000.0), "p_value")


# Panels

HELD = ("v_held", "select *, date as lo, lead(date) over (partition by customer_gvkey, supplier_gvkey order by date) as hi from v_edges")
FORWARD = ("v_forward", "select h.supplier_gvkey, x.date, sum(h.weight_wji * x.r) as y from v_held h join v_returns x on x.gvkey = h.customer_gvkey and x.date >= h.lo and (h.hi is null or x.date < h.hi) group by 1, 2")
REVERSE = ("v_reverse", "select h.customer_gvkey, x.date, sum(h.weight_wji * x.r) as z from v_held h join v_returns x on x.gvkey = h.supplier_gvkey and x.date >= h.lo and (h.hi is null or x.date < h.hi) group by 1, 2")


def panel_sql(prefix: str, signal: str, entity: str, sig: str, r: str = "r", q: str = "v_returns") -> str:
    leads = ", ".join(f"lead(v, {h}) over w as {prefix}_fwd_{h}" for h in range(1, HORIZON + 1))
    lags = ", ".join(f"lag(v, {k}) over w as {prefix}_lag_{k}" for k in range(1, panel.LAGS + 1))
    return (
        f"select * from (select gvkey as {entity}, date, v as {prefix}, coalesce({signal}, 0.0) as {signal}, {leads}, {lags} from (select x.gvkey, x.date, {r} as v, s.{signal} "
        f"from {q} x left join {sig} s on s.{entity} = x.gvkey and s.date = x.date) z0 window w as (partition by gvkey order by date)) p0 where "
        + " and ".join(f"{prefix}_fwd_{h} is not null" for h in range(1, HORIZON + 1))
    )


def panel_columns(prefix: str, signal: str) -> list[str]:
    return [prefix, signal, *(f"{prefix}_fwd_{h}" for h in range(1, HORIZON + 1)), *(f"{prefix}_lag_{k}" for k in range(1, panel.LAGS + 1))]


def round_all(view: str, key: str, columns: list[str]) -> str:
    return f"select {key}, date, " + ", ".join(r6(c, c) for c in columns) + f" from {view}"


PANEL_F = ("v_panelf", panel_sql("sup_r", "y", "supplier_gvkey", "v_forward"))
PANEL_R = ("v_panelr", panel_sql("cust_r", "z", "customer_gvkey", "v_reverse"))


@query(using("select supplier_gvkey, date, floor((y) * 1000000.0 + 0.5) / 1000000.0 as y from v_forward", HELD, FORWARD))
def weighted_signal_forward(spark, sf_dir):
    return rounded(asof.signal(views.returns(spark, sf_dir), views.edges(spark, sf_dir), "supplier_gvkey", "customer_gvkey", "y"), "y")


@query(using("select customer_gvkey, date, floor((z) * 1000000.0 + 0.5) / 1000000.0 as z from v_reverse", HELD, REVERSE))
def weighted_signal_reverse(spark, sf_dir):
    return rounded(asof.signal(views.returns(spark, sf_dir), views.edges(spark, sf_dir), "customer_gvkey", "supplier_gvkey", "z"), "z")


@query(using("select customer_gvkey, supplier_gvkey, c.date, floor((weight_wji) * 1000000.0 + 0.5) / 1000000.0 as weight_wji from v_held h join (select distinct date from v_returns) c on c.date >= lo and (hi is null or c.date < hi)", HELD))
def asof_weights(spark, sf_dir):
    dates = asof.calendar(views.returns(spark, sf_dir))
    return rounded(asof.weights_on(views.edges(spark, sf_dir), dates), "weight_wji")


@query(using(round_all("v_panelf", "supplier_gvkey", panel_columns("sup_r", "y")), HELD, FORWARD, PANEL_F))
def panel_forward(spark, sf_dir):
    return rounded(panel.panel(views.returns(spark, sf_dir), views.edges(spark, sf_dir), "forward", HORIZON), *panel_columns("sup_r", "y"))


@query(using(round_all("v_panelr", "customer_gvkey", panel_columns("cust_r", "z")), HELD, REVERSE, PANEL_R))
def panel_reverse(spark, sf_dir):
    return rounded(panel.panel(views.returns(spark, sf_dir), views.edges(spark, sf_dir), "reverse", HORIZON), *panel_columns("cust_r", "z"))


@query(using(f"select count(*) as n_rows, count(distinct supplier_gvkey) as n_entities, count(distinct date) as n_dates, {r6('stddev_samp(y)', 'std_signal')}, {r6('avg(abs(y))', 'mean_abs_signal')} from v_panelf", HELD, FORWARD, PANEL_F))
def panel_summary(spark, sf_dir):
    rows = panel.panel(views.returns(spark, sf_dir), views.edges(spark, sf_dir), "forward", HORIZON)
    return rounded(panel.summary(rows), "std_signal", "mean_abs_signal")


LOGGED = ("v_logged", "select gvkey, date, ln(1 + r) as r from v_returns")


@query(using(round_all("v_panell", "supplier_gvkey", panel_columns("sup_r", "y")), HELD, LOGGED, ("v_signall", FORWARD[1].replace("v_returns", "v_logged")), ("v_panell", panel_sql("sup_r", "y", "supplier_gvkey", "v_signall", q="v_logged"))))
def panel_logret(spark, sf_dir):
    logged = views.returns(spark, sf_dir).withColumn("r", clean.log_return(F.col("r")))
    return rounded(panel.panel(logged, views.edges(spark, sf_dir), "forward", HORIZON), *panel_columns("sup_r", "y"))


@query(using("select customer_gvkey, supplier_gvkey, date, floor((weight_wji) * 1000000.0 + 0.5) / 1000000.0 as weight_wji from v_edges where abs(weight_wji) >= 0.2"))
def min_weight_edges(spark, sf_dir):
    raw = views.edges(spark, sf_dir).withColumnRenamed("date", "srcdate").withColumn("customer_gvkey", F.concat(F.col("customer_gvkey").cast("int").cast("string"), F.lit(".0")))
    return rounded(readers.clean_edges(raw, min_weight=0.2).drop("ord"), "weight_wji")


# Statistics


def forward_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.panel(views.returns(spark, sf_dir), views.edges(spark, sf_dir), "forward", HORIZON)


WINSORIZED = ("v_wins", "select supplier_gvkey, date, greatest(lo, least(hi, y)) as y from v_panelf, (select quantile_cont(y, 0.01) as lo, quantile_cont(y, 0.99) as hi from v_panelf)")


@query(using("select supplier_gvkey, date, floor((y) * 1000000.0 + 0.5) / 1000000.0 as y from v_wins", HELD, FORWARD, PANEL_F, WINSORIZED))
def winsorize_signal(spark, sf_dir):
    return rounded(stats.winsorize(forward_panel(spark, sf_dir), "y").select("supplier_gvkey", "date", "y"), "y")


@query(using("select supplier_gvkey, date, floor((y) * 1000000.0 + 0.5) / 1000000.0 as y from v_wins where y <> 0", HELD, FORWARD, PANEL_F, WINSORIZED))
def nonzero_signal(spark, sf_dir):
    return rounded(stats.nonzero(stats.winsorize(forward_panel(spark, sf_dir), "y"), "y").select("supplier_gvkey", "date", "y"), "y")


@query(using("select count(y) as n, " + ", ".join(r6(e, n) for e, n in (
    ("avg(y)", "mean"), ("stddev_samp(y)", "std"), ("min(y)", "min"), ("quantile_cont(y, 0.25)", "q25"), ("quantile_cont(y, 0.5)", "q50"), ("quantile_cont(y, 0.75)", "q75"),
    ("max(y)", "max"), ("avg(abs(y))", "mean_abs"), ("avg(cast(y <> 0 as double))", "share_nonzero"))) + " from v_panelf", HELD, FORWARD, PANEL_F))
def signal_describe(spark, sf_dir):
    return rounded(stats.describe(forward_panel(spark, sf_dir), "y"), "mean", "std", "min", "q25", "q50", "q75", "max", "mean_abs", "share_nonzero")


CLIPPED = ("v_clipped", f"select x.gvkey, date, greatest(lo, least(hi, r)) as r from v_returns x join (select gvkey, quantile_cont(r, {WINSOR}) as lo, quantile_cont(r, {1 - WINSOR}) as hi from v_returns group by 1) b on x.gvkey = b.gvkey")


@query(using("select gvkey, date, floor(r * 100000000.0 + 0.5) / 100000000.0 as r from v_clipped", CLIPPED))
def winsorize_by_entity(spark, sf_dir):
    return rounded(stats.winsorize_by(views.returns(spark, sf_dir), "gvkey", "r", WINSOR), "r", places=8)


# Matrix

SERIES = ("v_series", "select c.gvkey, t, r from v_clipped c join (select date, row_number() over (order by date) as t from (select distinct date from v_returns)) d on c.date = d.date")
PAIRS = ("v_pairs", "select distinct customer_gvkey as a, supplier_gvkey as b from v_edges union select distinct supplier_gvkey, customer_gvkey from v_edges")
FITTED = ("v_fitted", """select a, b, n, case when ok then sxy / sxx end as beta, case when ok and greatest(0, syy - sxy * sxy / sxx) > 1e-12 * syy then (sxy / sxx) / sqrt(greatest(0, syy - sxy * sxy / sxx) / (n - 2) / sxx) end as t
from (select a, b, count(*) as n, regr_sxx(y.r, x.r) as sxx, regr_sxy(y.r, x.r) as sxy, regr_syy(y.r, x.r) as syy, count(*) >= 10 and regr_sxx(y.r, x.r) > 1e-20 as ok
from v_pairs join v_series x on x.gvkey = a join v_series y on y.gvkey = b and y.t = x.t + 1 group by 1, 2)""")
MATRIX = (CLIPPED, SERIES, PAIRS, FITTED)


def scored(ahead: str, back: str) -> tuple[str, str]:
    return ("v_scored", f"select e.customer_gvkey, e.supplier_gvkey, e.weight_wji as w, f.beta as beta_fwd, f.t as t_fwd, v.beta as beta_rev, v.t as t_rev, least(f.n, v.n) as n, e.weight_wji * ({ahead} - {back}) as score from v_edges e join v_fitted f on f.a = customer_gvkey and f.b = supplier_gvkey join v_fitted v on v.a = supplier_gvkey and v.b = customer_gvkey where least(f.n, v.n) >= {MIN_OBS}")


SCORED = scored("f.t", "v.t")
C = ("v_c", "select customer_gvkey as i, supplier_gvkey as j, avg(score) as value from v_scored where score is not null group by 1, 2")
S = ("v_s", "select i, j, sum(value) as value from (select i, j, value from v_c union all select j, i, -value from v_c) group by 1, 2")
LEADING = ("v_leading", "select i as node, sum(value) as leadingness from v_s group by 1")
SCORE_COLUMNS = ("w", "beta_fwd", "t_fwd", "beta_rev", "t_rev", "score")
SCORE_SQL = "select customer_gvkey, supplier_gvkey, n, " + ", ".join(r6(c, c) for c in SCORE_COLUMNS) + " from v_scored"


def scores(spark: SparkSession, sf_dir: str, score: str = "tstat_diff") -> DataFrame:
    return matrix.edge_scores(views.returns(spark, sf_dir), views.edges(spark, sf_dir), 1, MIN_OBS, WINSOR, score)


def skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.skew(matrix.score_matrix(scores(spark, sf_dir)))


@query(using(f"select a, b, n, {r6('beta', 'beta')}, {r6('t', 't')} from v_fitted", *MATRIX))
def pair_ols(spark, sf_dir):
    series = staged(stats.winsorize_by(matrix.indexed(views.returns(spark, sf_dir)), "gvkey", "r", WINSOR), "series")
    return rounded(matrix.directed_ols(series, matrix.both_ways(matrix.among(series, views.edges(spark, sf_dir)))), "beta", "t")


@query(using(SCORE_SQL, *MATRIX, SCORED))
def edge_scores_tstat(spark, sf_dir):
    return rounded(scores(spark, sf_dir), *SCORE_COLUMNS)


@query(using(SCORE_SQL, *MATRIX, scored("f.beta", "v.beta")))
def edge_scores_beta(spark, sf_dir):
    return rounded(scores(spark, sf_dir, "beta_diff"), *SCORE_COLUMNS)


@query(using(f"select row_number() over (order by v_scored.score desc nulls last, customer_gvkey, supplier_gvkey, w) as rank, {r6('score', 'score')} from v_scored", *MATRIX, SCORED))
def write_edge_scores(spark, sf_dir):
    """Written in order of score, and numbered as the files hold them."""
    path = new_path(spark, "edge-scores")
    writers.write_edge_scores(scores(spark, sf_dir), path)
    return rounded(readers.read_edge_scores(spark, path).select("rank", "score"), "score")


@query(using(f"select i, j, {r6('value', 'value')} from v_c", *MATRIX, SCORED, C))
def lead_lag_matrix_c(spark, sf_dir):
    return rounded(matrix.score_matrix(scores(spark, sf_dir)), "value")


@query(using(f"select i, j, {r6('value', 'value')} from v_s", *MATRIX, SCORED, C, S))
def skew_matrix_s(spark, sf_dir):
    return rounded(skewed(spark, sf_dir), "value")


@query(using(f"select node, {r6('leadingness', 'leadingness')} from v_leading", *MATRIX, SCORED, C, S, LEADING))
def leadingness(spark, sf_dir):
    return rounded(matrix.leadingness(skewed(spark, sf_dir)), "leadingness")


@query(using(f"select node, {r6('leadingness', 'leadingness')} from v_leading order by v_leading.leadingness desc, node limit 20", *MATRIX, SCORED, C, S, LEADING))
def top_leaders(spark, sf_dir):
    return rounded(matrix.top(matrix.leadingness(skewed(spark, sf_dir)), "leadingness", "node"), "leadingness")


@query(using(f"select node, {r6('leadingness', 'leadingness')} from v_leading order by v_leading.leadingness, node limit 20", *MATRIX, SCORED, C, S, LEADING))
def bottom_laggers(spark, sf_dir):
    return rounded(matrix.top(matrix.leadingness(skewed(spark, sf_dir)), "leadingness", "node", largest=False), "leadingness")


@query(using("select count(distinct i) as n_nodes, max(abs(both_)) as max_abs from (select i, sum(v) as both_ from (select i, j, value as v from v_s union all select j, i, value from v_s) group by i, j)", *MATRIX, SCORED, C, S))
def skew_sanity(spark, sf_dir):
    return matrix.asymmetry(skewed(spark, sf_dir))


# Regressions and spectrum: iterative, without SQL; tested against dense solutions


@query()
def panel_ols_forward(spark, sf_dir):
    return panelreg.run_panel(forward_panel(spark, sf_dir), "forward", HORIZON)


@query()
def panel_ols_reverse(spark, sf_dir):
    rows = panel.panel(views.returns(spark, sf_dir), views.edges(spark, sf_dir), "reverse", HORIZON)
    return panelreg.run_panel(rows, "reverse", HORIZON)


@query()
def horizon_profile(spark, sf_dir):
    return panelreg.horizon_profile(panelreg.run_panel(forward_panel(spark, sf_dir), "forward", HORIZON))


@query()
def eigenvalues(spark, sf_dir):
    return spectral.eigenvalues(skewed(spark, sf_dir))


@query(using("""select count(distinct a.i) as n, floor(log10(sum(a.value * a.value)) * 1000000.0 + 0.5) / 1000000.0 as log_squares,
floor(log10((select sum(v * v) from (select x.i, y.j, sum(x.value * y.value) as v from v_s x join v_s y on x.j = y.i group by 1, 2))) * 1000000.0 + 0.5) / 1000000.0 as log_fourths from v_s a""", *MATRIX, SCORED, C, S))
def spectrum_moments(spark, sf_dir):
    """Sums of the squares and fourth powers of all eigenvalues, which are those of the cells of S and of S squared."""
    sums = spectral.moments(skewed(spark, sf_dir)).select("n", F.log10("squares").alias("log_squares"), F.log10("fourths").alias("log_fourths"))
    return rounded(sums, "log_squares", "log_fourths")


@query()
def eigenvectors_topk(spark, sf_dir):
    return spectral.eigenvectors(skewed(spark, sf_dir))


@query(using("select k, cast(1.0 as double) as length, cast(0.0 as double) as residual from (select cast(unnest(range(1, 1 + least(10, count(distinct i)))) as int) as k from v_s)", *MATRIX, SCORED, C, S))
def leading_eigenpairs(spark, sf_dir):
    """Length and residual of the first ten eigenvectors, from S as a table: i S v - eigval v."""
    s = staged(skewed(spark, sf_dir), "skew")
    v = spectral.eigenvectors(s, 10).join(spectral.eigenvalues(s, 10).withColumnRenamed("rank", "k"), "k")
    image = s.join(v.withColumnRenamed("node", "j"), "j").groupBy(F.col("i").alias("node"), "k").agg(F.sum(-F.col("value") * F.col("im")).alias("x"), F.sum(F.col("value") * F.col("re")).alias("y"))
    away = F.sum(F.pow(F.coalesce("x", F.lit(0.0)) - F.col("eigval") * F.col("re"), F.lit(2)) + F.pow(F.coalesce("y", F.lit(0.0)) - F.col("eigval") * F.col("im"), F.lit(2)))
    checked = v.join(image, ["node", "k"], "left").groupBy("k").agg(F.sqrt(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("length"), F.sqrt(away).alias("residual"))
    return rounded(checked, "length", "residual")


@query(using("select count(*) as places, floor(log10(sum(value * value)) * 1000000.0 + 0.5) / 1000000.0 as log_squares from v_s where i < j and value <> 0", *MATRIX, SCORED, C, S))
def permuted_matrix(spark, sf_dir):
    """Distinct places above the diagonal, and squares, of one permutation as a table: as many as before it."""
    cells = spectral.permuted_cells(spectral.Skew(skewed(spark, sf_dir)), SEED, 1)
    return rounded(cells.where("r < c").agg(F.count_distinct("r", "c").alias("places"), F.log10(F.sum(F.col("value") * F.col("value"))).alias("log_squares")), "log_squares")


def null_of(spark: SparkSession, sf_dir: str) -> tuple[float, DataFrame]:
    s = spectral.Skew(skewed(spark, sf_dir))
    return spectral.largest(s), spectral.permutation_null(s, PERMUTATIONS, SEED)


@query()
def permutation_null(spark, sf_dir):
    return null_of(spark, sf_dir)[1]


@query()
def permutation_pvalue(spark, sf_dir):
    observed, null = null_of(spark, sf_dir)
    return spectral.permutation_p(null, observed)


@query()
def embedding_2d(spark, sf_dir):
    return spectral.embedding(skewed(spark, sf_dir), seed=SEED)


@query()
def null_histogram(spark, sf_dir):
    return spectral.histogram(null_of(spark, sf_dir)[1])


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
