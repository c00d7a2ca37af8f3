import datetime as dt

import pytest

from tidelag.operators import edges, resolve
from tidelag.operators.dedupe import first_value, keep_last

DAY = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def firms(spark):
    rows = [(1, "ACM", "ACME CORP"), (2, "ABG", "ALPHA BETA GAMMA"), (3, "AB2", "Alpha-Beta-Gamma"), (4, "ABD", "ALPHA BETA DELTA"), (5, "", "No Ticker"), (6, "EMP", "---")]
    return resolve.dictionary(spark.createDataFrame(rows, "ord long, tic string, conm string"))


def found(spark, firms, name, mode):
    row = resolve.resolve(spark.createDataFrame([(name,)], "name string"), firms, mode).first()
    return row.tic, row.tier


@pytest.mark.parametrize(
    ("name", "compat", "tokens"),
    [
        ("acme corp.", ("ACM", 1), ("ACM", 1)), ("Acme", (None, None), ("ACM", 2)), ("gamma beta alpha x", (None, None), ("ABG", 3)),
        ("--- ", (None, None), (None, None)), ("alpha beta", (None, None), ("ABG", 3)), ("unheard of", (None, None), (None, None)),
    ],
)
def test_tiers(spark, firms, name, compat, tokens):
    assert found(spark, firms, name, "compat") == compat
    assert found(spark, firms, name, "tokens") == tokens


def test_dictionary_keeps_the_first_of_a_name(firms):
    assert sorted(r.tic for r in firms.collect()) == ["ABD", "ABG", "ACM"]


def test_mode_is_checked(spark, firms):
    with pytest.raises(ValueError):
        resolve.resolve(spark.createDataFrame([("x",)], "name string"), firms, "fuzzy")


SEGMENTS = [
    (1, "S1", DAY, "000001", "U.S. Government", "", "ignore"), (2, "S1", DAY, "000001", "acme corp", "n/a", "no_sale"),
    (3, "S1", DAY, "000001", "acme corp", "-1", "no_sale"), (4, "S1", DAY, "000001", "nobody", "5", "unresolved"),
    (5, "ACM", DAY, "000009", "Acme Corp", "5", "self_loop"), (6, "S1", dt.date(2021, 1, 1), "000001", "acme corp", "5", "no_fund"),
    (7, "S1", DAY, "000001", " ACME, CORP", "15", "valid"), (8, "S1", DAY, "000001", "alpha beta gamma", "2.5", "valid"),
    (9, "S1", DAY, "000001", None, "2.5", "unresolved"), (10, "S1", DAY, "000001", "acme corp", "nan", "no_sale"), (11, "S1", DAY, "000001", "acme corp", None, "no_sale"),
]


@pytest.fixture(scope="module")
def classified(spark, firms):
    rows = spark.createDataFrame([r[:6] for r in SEGMENTS], "ord long, tic string, srcdate date, gvkey string, cnms string, salecs string")
    funds = spark.createDataFrame([("000001", DAY, 10.0)], "gvkey string, datadate date, sale double")
    return edges.classify(rows, firms, funds)


def test_cascade(classified):
    assert {r.ord: r.disposition for r in classified.collect()} == {r[0]: r[6] for r in SEGMENTS}
    assert sum(r.n for r in edges.dispositions(classified).collect()) == len(SEGMENTS)


def test_edges_and_neighbours(classified):
    valid = edges.edge_list(classified)
    assert {r.ord: r.weight_wji for r in valid.collect()} == {7: 1.0, 8: 0.25}
    row = edges.adjacency(valid).first()
    assert [(n.customer_tic, n.weight) for n in row.neighbors] == [("ACM", 1.0), ("ABG", 0.25)]


def test_calendar_keeps_customers_with_any_ticker(spark, classified):
    dates = spark.createDataFrame([("ACM", DAY, DAY), ("A_B", DAY, DAY)], "tic string, datadate date, rdq date")
    assert [r.tic for r in edges.earnings_calendar(dates, edges.edge_list(classified)).collect()] == ["ACM"]


def test_first_and_last(spark):
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 7.0), ("b", 3, 1.0)], "k string, ord long, v double")
    assert {r.k: r.v for r in first_value(rows, ["k"], "v", "ord").collect()} == {"a": 5.0, "b": 1.0}
    assert {r.k: r.v for r in keep_last(rows, ["k"], "ord").collect()} == {"a": 7.0, "b": 1.0}


def test_copies_of_words_meet_once_and_leave_as_pairs(spark, monkeypatch):
    """Many keys of few sets: sets are compared, keys travel in packs, and every pair comes out."""
    from itertools import combinations

    from pyspark.sql import functions as F

    monkeypatch.setattr(resolve, "PACK", 20)
    texts = ["a b c d e", "e d c b a a", "a b c d", "x y", "", "b c d e"]
    words = {k: set(texts[k % len(texts)].split()) for k in range(300)}
    rows = spark.createDataFrame([(k, texts[k % len(texts)].split()) for k in range(300)], "id long, tokens array<string>")
    wanted = {(a, b) for a, b in combinations(range(300), 2) if words[a] | words[b] and len(words[a] & words[b]) >= 0.8 * len(words[a] | words[b])}
    got = resolve.token_pairs(rows, rows, "id", "id", 0.8, ordered=True).collect()
    assert len(got) == len(wanted) and {(r.k1, r.k2) for r in got} == wanted
    sets = resolve.with_sets(rows, "id", "id")
    assert sets.select("t").distinct().count() == 4 and resolve.set_pairs(sets, sets, 0.8).count() == 8
    assert resolve.in_packs(sets, "id", "t").select(F.max(F.size("ids"))).first()[0] <= 45


def test_the_first_of_firms_with_equal_words_wins(spark):
    firms = spark.createDataFrame([(9, "Z", ["p", "q"]), (3, "T", ["q", "p", "p"]), (1, None, ["p", "q", "r"]), (2, "U", ["p", "q", "s"])], "ord long, tic string, tokens array<string>")
    names = spark.createDataFrame([("p q",), ("Q-P",), ("p q t",), ("",)], "name string")
    firms = firms.select("ord", "tic", spark_upper("tokens").alias("tokens"))
    got = {(r.name, r.tic, round(r.score, 6)) for r in resolve.best_jaccard(names, firms).collect()}
    assert got == {("p q", "T", 1.0), ("Q-P", "T", 1.0), ("p q t", "T", 0.666667)}


def spark_upper(column):
    from pyspark.sql import functions as F

    return F.transform(column, F.upper)


def test_segments_are_evaluated_once(classified):
    """What is left to evaluate holds the table of sales alone; segments were written with their names and sales read."""
    plan = classified._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1
