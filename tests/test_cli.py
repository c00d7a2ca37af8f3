import numpy as np

from tidelag import cli
from tidelag.plans import views
from tidelag.sources import readers


def test_study_from_files(spark, tmp_path):
    sf, out = "/root/testdata/sf0.001", str(tmp_path)
    views.returns(spark, sf).withColumnRenamed("r", "RET").write.parquet(f"{out}/returns")
    views.edges(spark, sf).write.parquet(f"{out}/edges")
    common = ["--returns", f"{out}/returns", "--edges", f"{out}/edges"]
    cli.main(["panel", *common, "--horizon-max", "2", "--out", f"{out}/panel"], spark)
    cli.main(["regress", "--panel", f"{out}/panel", "--horizon-max", "2", "--winsorize", "--out", f"{out}/reg"], spark)
    cli.main(["profile", "--results", f"{out}/reg/leadlag_forward_winsor.csv", "--out", f"{out}/profile"], spark)
    assert spark.read.parquet(f"{out}/profile").count() == 2
    cli.main(["matrix", *common, "--min-obs", "15", "--out", f"{out}/matrix"], spark)
    cli.main(["spectrum", "--matrix", f"{out}/matrix/S", "--permtest", "--n-perm", "10", "--embed", "--c", f"{out}/matrix/C", "--edge-scores", f"{out}/matrix/edge_scores", "--out", f"{out}/spectrum"], spark)
    assert 1 / 11 <= spark.read.parquet(f"{out}/spectrum/permutation").first().p_value <= 1
    assert [r.value.split("=")[0] for r in spark.read.text(f"{out}/spectrum/perm_test.txt").collect()] == ["obs_maxeig", "p_value"]
    assert spark.read.text(f"{out}/spectrum/sanity.txt").first().value == "max|S + S^T| = 0"
    scores = readers.read_edge_scores(spark, f"{out}/matrix/edge_scores")
    assert scores.exceptAll(readers.read_edge_scores(spark, f"{out}/spectrum/edge_scores_copy")).count() == 0 < scores.count()
    assert spark.read.parquet(f"{out}/spectrum/C_copy").count() == spark.read.parquet(f"{out}/matrix/C").count()
    lead = [float(r.leadingness) for r in spark.read.option("header", True).csv(f"{out}/matrix/leadingness").collect()]
    assert abs(np.sum(lead)) < 1e-9 and lead == sorted(lead, reverse=True)


def test_edges_from_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("h\nA,USD,S,I,C,ACM,2020-01-01,77,Acme Corp\n")
    (tmp_path / "s.csv").write_text("h\nS1,2020-01-01,1,Sup,1,ACME,5,1\nS1,2020-01-01,1,Sup,1,Exports,5,1\nS1,2020-01-01,1,Sup,1,Nobody,5,1\nS1,2020-01-01,1,Sup,1,Acme,x,1\nS2,2020-01-01,2,Sup,1,Acme,1,1\nACM,2020-01-01,1,Sup,1,Acme Corp,1,1\n")
    (tmp_path / "f.csv").write_text("h\nA,USD,S,I,C,S1,2020-01-01,1,Sup,12,1,9,20,1\n")
    base = ["edges", "--metadata", f"{tmp_path}/m.csv", "--segments", f"{tmp_path}/s.csv", "--fundamentals", f"{tmp_path}/f.csv", "--earnings", f"{tmp_path}/none.csv"]
    cli.main([*base, "--mode", "tokens", "--out", f"{tmp_path}/out"], spark)
    row = spark.read.parquet(f"{tmp_path}/out/merged_edges").first()
    assert (row.customer_gvkey, row.supplier_gvkey, row.weight_wji) == ("000077", "000001", 0.25)
    report = dict(r.value.rsplit(": ", 1) for r in spark.read.text(f"{tmp_path}/out/report.txt").collect())
    assert report == {
        "rows read": "6", "rows ignore": "1", "rows no_sale": "1", "rows unresolved": "1", "rows self_loop": "1", "rows no_fund": "1", "rows valid": "1",
        "mean weight": "0.2500", "max weight": "0.2500", "names tier 1": "1", "names tier 2": "1", "names tier 3": "0", "names unresolved": "1",
        "edges tier 1": "0", "edges tier 2": "1", "edges tier 3": "0", "customers": "1", "suppliers": "1", "edges": "1",
    }
    outcomes = {r.disposition: r.n for r in spark.read.parquet(f"{tmp_path}/out/dispositions").collect()}
    assert outcomes == {k: int(report[f"rows {k}"]) for k in outcomes}
