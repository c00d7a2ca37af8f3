"""Command line: the stages of a lead-lag study, each from files to files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidelag.operators import edges, matrix, panel, panelreg, resolve, spectral, stats
from tidelag.sources import readers, writers
from tidelag.sources.shared import staged


def build_edges(spark: SparkSession, a: argparse.Namespace) -> None:
    """Raw files to edges, adjacency, earnings calendar, counters, and edges between firm ids."""
    metadata = readers.read_metadata(spark, a.metadata)
    firms, seen = resolve.dictionary(metadata), Observation("segments")
    found = edges.classify(readers.read_segments(spark, a.segments), firms, readers.read_fundamentals(spark, a.fundamentals, allow_missing=True), mode=a.mode)
    writers.write_table(found.observe(seen, *edges.counters()), f"{a.out}/classified")
    rows = spark.read.parquet(f"{a.out}/classified")
    graph = edges.edge_list(rows)
    writers.write_edge_list(graph, f"{a.out}/edges")
    writers.write_adjacency(edges.adjacency(graph), f"{a.out}/adjacency")
    writers.write_calendar(edges.earnings_calendar(readers.read_earnings(spark, a.earnings, allow_missing=True), graph), f"{a.out}/calendar")
    writers.write_table(edges.dispositions(rows), f"{a.out}/dispositions")
    names = resolve.stats(rows.where("disposition not in ('ignore', 'no_sale')").select("norm", F.col("match_tier").alias("tier")))
    ends = edges.graph_summary(graph).first()
    writers.write_text(spark, edges.report(seen.get, {r.tier: r.names for r in names.collect()}, ends.customers, ends.suppliers), f"{a.out}/report.txt")
    writers.write_table(edges.to_ids(graph, metadata), f"{a.out}/merged_edges")


def load_edges(spark: SparkSession, path: str, min_weight: float | None = None) -> DataFrame:
    """Edges between firm ids: CSV with a header, or the table that ``edges`` writes."""
    if path.endswith(".csv"):
        return readers.read_merged_edges(spark, path, min_weight=min_weight)
    rows = spark.read.parquet(path)
    return rows if min_weight is None else rows.where(F.abs("weight_wji") >= min_weight)


def build_panel(spark: SparkSession, a: argparse.Namespace) -> None:
    returns = readers.read_returns(spark, a.returns, log=a.use_logret)
    rows = panel.panel(returns, load_edges(spark, a.edges, a.min_edge_weight), a.direction, a.horizon_max)
    writers.write_table(rows, a.out)


def run_tests(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = spark.read.parquet(a.panel)
    signal = panel.roles_of(a.direction).signal
    if a.winsorize:
        rows = stats.winsorize(rows, signal)
    if a.nonzero:
        rows = stats.nonzero(rows, signal)
    writers.write_regressions(panelreg.run_panel(rows, a.direction, a.horizon_max), a.out, a.direction, a.winsorize, a.nonzero)


def build_matrix(spark: SparkSession, a: argparse.Namespace) -> None:
    returns = readers.read_returns(spark, a.returns, finite_only=True)
    scores = matrix.edge_scores(returns, load_edges(spark, a.edges), a.horizon, a.min_obs, a.winsor_q, a.score)
    scores = staged(scores, "edge-scores")
    writers.write_edge_scores(scores, f"{a.out}/edge_scores")
    if not scores.limit(1).count():
        raise SystemExit("no edge has enough observations for a score: check the ids and min-obs")
    c = matrix.score_matrix(scores)
    writers.write_table(c, f"{a.out}/C")
    writers.write_table(matrix.skew(c), f"{a.out}/S")
    writers.write_leadingness(matrix.leadingness(matrix.skew(c)), f"{a.out}/leadingness")


def run_spectrum(spark: SparkSession, a: argparse.Namespace) -> None:
    s = readers.read_matrix(spark, a.matrix)
    sanity = matrix.asymmetry(s)
    writers.write_table(sanity, f"{a.out}/sanity")
    found = sanity.first()
    writers.write_text(spark, [f"max|S + S^T| = {found.max_abs:.6g}", f"shape = ({found.n_nodes}, {found.n_nodes})"], f"{a.out}/sanity.txt")
    writers.write_table(spectral.eigenvalues(s), f"{a.out}/eigenvalues")
    writers.write_table(spectral.eigenvectors(s, a.top_k), f"{a.out}/eigenvectors")
    if a.embed:
        writers.write_table(spectral.embedding(s, seed=a.seed), f"{a.out}/embedding")
    if a.permtest:
        cells = spectral.Skew(s)
        writers.write_table(spectral.permutation_null(cells, a.n_perm, a.seed), f"{a.out}/null")
        null = spark.read.parquet(f"{a.out}/null")
        summary = spectral.permutation_p(null, spectral.largest(cells))
        writers.write_table(summary, f"{a.out}/permutation")
        p = summary.first()
        writers.write_text(spark, [f"obs_maxeig={p.obs_maxeig:.6g}", f"p_value={p.p_value:.6g}"], f"{a.out}/perm_test.txt")
        writers.write_table(spectral.histogram(null), f"{a.out}/histogram")
    if a.c:
        writers.write_table(readers.read_matrix(spark, a.c), f"{a.out}/C_copy")
    if a.edge_scores:
        writers.write_edge_scores(readers.read_edge_scores(spark, a.edge_scores).drop("rank"), f"{a.out}/edge_scores_copy")


def profile(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = spark.read.option("header", True).option("inferSchema", True).csv(a.results)
    writers.write_table(panelreg.horizon_profile(rows), a.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidelag")
    stages = top.add_subparsers(required=True)

    def stage(name: str, run, *required: str) -> argparse.ArgumentParser:
        p = stages.add_parser(name, help=run.__doc__)
        p.set_defaults(run=run)
        for r in (*required, "out"):
            p.add_argument(f"--{r}", required=True)
        return p

    stage("edges", build_edges, "metadata", "segments", "fundamentals", "earnings").add_argument("--mode", choices=("compat", "tokens"), default="compat")
    p = stage("panel", build_panel, "returns", "edges")
    p.add_argument("--direction", choices=tuple(panel.ROLES), default="forward")
    p.add_argument("--horizon-max", type=int, default=5)
    p.add_argument("--min-edge-weight", type=float, default=0.0)
    p.add_argument("--use-logret", action="store_true")
    p = stage("regress", run_tests, "panel")
    p.add_argument("--direction", choices=tuple(panel.ROLES), default="forward")
    p.add_argument("--horizon-max", type=int, default=5)
    p.add_argument("--winsorize", action="store_true")
    p.add_argument("--nonzero", action="store_true")
    p = stage("matrix", build_matrix, "returns", "edges")
    p.add_argument("--horizon", type=int, default=1)
    p.add_argument("--min-obs", type=int, default=80)
    p.add_argument("--winsor-q", type=float, default=0.001)
    p.add_argument("--score", choices=tuple(matrix.SCORES), default="tstat_diff")
    p = stage("spectrum", run_spectrum, "matrix")
    p.add_argument("--top-k", type=int, default=50)
    p.add_argument("--permtest", action="store_true")
    p.add_argument("--n-perm", type=int, default=500)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--embed", action="store_true")
    p.add_argument("--c", help="a score matrix to keep beside the results")
    p.add_argument("--edge-scores", help="edge scores to keep beside the results")
    stage("profile", profile, "results")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(spark or SparkSession.builder.appName("tidelag").getOrCreate(), a)


if __name__ == "__main__":
    main()
