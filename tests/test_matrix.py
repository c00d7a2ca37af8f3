import datetime as dt
import os
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tidelag.operators import dense, lanczos, matrix, spectral


def test_cells_without_scores_vanish(spark):
    scores = spark.createDataFrame([("a", "x", 1.0), ("a", "y", None), ("b", "x", None)], "customer_gvkey string, supplier_gvkey string, score double")
    c = matrix.score_matrix(scores)
    assert [(r.i, r.j, r.value) for r in c.collect()] == [("a", "x", 1.0)]
    s = matrix.skew(c)
    assert sorted(r.node for r in matrix.nodes(s).collect()) == ["a", "x"]
    assert {r.node: r.leadingness for r in matrix.leadingness(s).collect()} == {"a": 1.0, "x": -1.0}
    assert matrix.asymmetry(s).first().max_abs == 0.0


def test_scores_shift_by_the_calendar(spark):
    rng = np.random.default_rng(4)
    days = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(30)]
    r = {k: rng.normal(size=30) for k in "ab"}
    returns = [(k, d, float(v)) for k in "ab" for d, v in zip(days, r[k], strict=True) if not (k == "a" and d.day == 7)]
    edges = spark.createDataFrame([("a", "b", 0.5), ("a", "zz", 1.0)], "customer_gvkey string, supplier_gvkey string, weight_wji double")
    got = matrix.edge_scores(spark.createDataFrame(returns, "gvkey string, date date, r double"), edges, 1, 10, 0.0, "beta_diff").collect()
    fit = lambda x, y, skip: np.polyfit([x[t] for t in range(29) if t not in skip], [y[t + 1] for t in range(29) if t not in skip], 1)[0]
    assert len(got) == 1 and got[0].n == 28
    assert got[0].beta_fwd == pytest.approx(fit(r["a"], r["b"], {6})) and got[0].beta_rev == pytest.approx(fit(r["b"], r["a"], {5}))
    assert got[0].score == pytest.approx(0.5 * (got[0].beta_fwd - got[0].beta_rev))
    with pytest.raises(ValueError):
        matrix.edge_scores(None, None, score="other")


@pytest.fixture
def skew(spark):
    return spark.createDataFrame([("1", "2", 2.0), ("2", "1", -2.0), ("2", "3", 1.0), ("3", "2", -1.0)], "i string, j string, value double")


def test_spectrum(spark, skew):
    values = [r.eigval for r in spectral.eigenvalues(skew).orderBy("rank").collect()]
    assert values == pytest.approx([5**0.5, 0.0, -(5**0.5)], abs=1e-12)
    assert spectral.largest(skew) == pytest.approx(5**0.5)
    assert spectral.eigenvectors(skew, 2).count() == 6 and spectral.embedding(skew).count() == 3


def random_skew(n, cells, seed=0):
    """(r, c, value) above the diagonal, and the dense matrix."""
    rng = np.random.default_rng(seed)
    r, c = np.triu_indices(n, 1)
    at = np.sort(rng.choice(len(r), min(cells, len(r)), replace=False))
    r, c, value = r[at], c[at], rng.standard_normal(len(at))
    dense = np.zeros((n, n))
    dense[r, c], dense[c, r] = value, -value
    return r, c, value, dense


@pytest.mark.parametrize(("n", "cells", "k", "block"), [(150, 3000, 50, 8), (150, 11175, 10, 8), (300, 900, 1, 1), (5, 10, 5, 8), (40, 30, 40, 8), (200, 150, 120, 8), (12, 0, 3, 8)])
def test_leading_pairs_equal_dense_ones(n, cells, k, block):
    r, c, value, dense = random_skew(n, cells)
    space = lanczos.Held(r, c, value, n)
    found, u = lanczos.leading(space, n, k, block)
    v = space.q @ u
    assert np.allclose(found, np.linalg.eigvalsh(1j * dense)[::-1][:k], atol=1e-8)
    assert np.abs(1j * dense @ v - v * found).max() < 1e-7 and np.allclose(v.conj().T @ v, np.eye(k), atol=1e-8)


def test_repeated_eigenvalues_are_all_found():
    value = np.r_[np.full(20, 3.0), np.ones(5)]
    r = 2 * np.arange(25)
    found, _ = lanczos.leading(lanczos.Held(r, r + 1, value, 80), 80, 30, 8)
    assert np.allclose(found, [3.0] * 20 + [1.0] * 5 + [0.0] * 5, atol=1e-8)


def as_matrix(spark, r, c, value):
    name = lambda x: f"n{x:05d}"
    rows = [x for i, j, v in zip(r.tolist(), c.tolist(), value.tolist(), strict=True) for x in ((name(i), name(j), v), (name(j), name(i), -v))]
    return spark.createDataFrame(rows, "i string, j string, value double")


def test_tables_and_one_task_agree(spark):
    r, c, value, dense = random_skew(40, 300, 3)
    held = spectral.Skew(as_matrix(spark, r, c, value))
    wanted = np.linalg.eigvalsh(1j * dense)[::-1]
    for spread in (False, True):
        listed, vectors = spectral.pairs(held, 3, spread=spread)
        assert [x.eigval for x in listed.orderBy("k").collect()] == pytest.approx(wanted[:3], abs=1e-8)
        v = np.zeros((40, 3), complex)
        for x in vectors.collect():
            v[x["at"], x.k - 1] = complex(x.re, x.im)
        assert np.abs(1j * dense @ v - v * wanted[:3]).max() < 1e-6 and np.allclose(v.conj().T @ v, np.eye(3), atol=1e-8)


def test_many_nodes_need_no_dense_matrix(spark):
    rng = np.random.default_rng(1)
    n = 20_000
    cells = {(min(x), max(x)) for x in rng.integers(0, n, (30_000, 2)).tolist() if x[0] != x[1]} | {(k, k + 1) for k in range(n - 1)}
    r, c = np.array(sorted(cells)).T
    value = np.r_[50.0, 40.0, rng.standard_normal(len(r) - 2)]
    held = spectral.Skew(as_matrix(spark, r, c, value))
    assert held.n == n
    first = spectral.largest(held)
    listed, vectors = spectral.pairs(held, 2)
    assert [x.eigval for x in listed.orderBy("k").collect()][0] == pytest.approx(first, abs=1e-6)
    v = np.zeros(n, complex)
    for x in vectors.where("k = 1").collect():
        v[x["at"]] = complex(x.re, x.im)
    image = np.zeros(n, complex)
    np.add.at(image, r, 1j * value * v[c])
    np.add.at(image, c, -1j * value * v[r])
    assert np.abs(image - first * v).max() < 1e-5


@pytest.mark.parametrize("n", [1, 2, 3, 10, 45, 100, 1000, 4950])
def test_moved_is_a_permutation(n):
    for perm_id in range(3):
        assert sorted(spectral.moved(np.arange(n), n, 7, perm_id).tolist()) == list(range(n))
    assert n < 10 or spectral.moved(np.arange(n), n, 7, 0).tolist() != spectral.moved(np.arange(n), n, 7, 1).tolist()


def test_places_above_the_diagonal():
    for n in (2, 3, 7, 50):
        r, c = np.triu_indices(n, 1)
        assert spectral.place_of(r, c, n).tolist() == list(range(len(r)))
        assert [x.tolist() for x in spectral.cell_of(np.arange(len(r)), n)] == [r.tolist(), c.tolist()]
    n = 1_000_000_000
    for place in (0, n - 2, n - 1, n * (n - 1) // 2 - 1, 123_456_789_012_345_678):
        r, c = spectral.cell_of(np.array([place]), n)
        assert 0 <= r[0] < c[0] < n and spectral.place_of(r, c, n)[0] == place


def test_places_move_evenly():
    """Each of 12 places is equally likely to be sent to each, over 2,000 permutations."""
    counts = np.zeros((12, 12))
    for b in range(2000):
        counts[np.arange(12), spectral.moved(np.arange(12), 12, 1, b)] += 1
    assert ((counts - 2000 / 12) ** 2 / (2000 / 12)).sum() < 200  # 121 degrees of freedom: mean 121, deviation 15.6


def test_null_agrees_with_dense_permutations(spark):
    r, c, value, dense = random_skew(20, 60, 5)
    held = spectral.Skew(as_matrix(spark, r, c, value))
    ours = np.array([x.null_maxeig for x in spectral.permutation_null(held, 400, 1).collect()])
    rng, upper = np.random.default_rng(2), np.triu_indices(held.n, 1)
    theirs = []
    for _ in range(400):
        s = np.zeros((held.n, held.n))
        s[upper] = rng.permutation(np.r_[value, np.zeros(len(upper[0]) - len(value))])
        theirs.append(np.linalg.eigvalsh(1j * (s - s.T))[-1])
    both = np.sort(np.r_[ours, theirs])
    apart = np.abs(np.searchsorted(np.sort(ours), both, side="right") - np.searchsorted(np.sort(theirs), both, side="right")).max() / 400
    assert apart < 0.12  # two-sample Kolmogorov-Smirnov: 0.096 at 5 %, 0.137 at 0.1 %


def test_permutations(spark, skew):
    one = spectral.permutation_null(skew, 20, 1).orderBy("perm_id").collect()
    assert one == spectral.permutation_null(skew, 20, 1).orderBy("perm_id").collect()
    assert spectral.permutation_null(skew, 5, 1, "sequential").count() == 5
    held = spectral.Skew(skew)
    moved = spectral.permuted_cells(held, 1, 3).collect()
    assert sorted(abs(x.value) for x in moved) == [1.0, 2.0] and all(0 <= x.r < x.c < 3 for x in moved)
    null = spark.createDataFrame([(float(k < 73),) for k in range(1000)], "null_maxeig double")
    assert spectral.permutation_p(null, 1.0).first().p_value == pytest.approx(0.0739261, abs=1e-7)
    assert sum(r.n for r in spectral.histogram(null).collect()) == 1000


def test_centrality(spark, skew):
    got = {x.node: x.centrality for x in spectral.centrality(skew).collect()}
    a = np.array([[1, 2, 0], [2, 1, 1], [0, 1, 1.0]])
    wanted = np.abs(np.linalg.eigh(a)[1][:, -1])
    assert [got[k] for k in "123"] == pytest.approx(wanted, abs=1e-6)


def test_spectrum_of_nothing(spark, skew):
    none = skew.limit(0)
    assert spectral.largest(none) == 0.0 and spectral.eigenvalues(none).count() == spectral.eigenvectors(none).count() == spectral.eigenvalues(none, 3).count() == 0
    flat = spark.createDataFrame([("a", "b", 0.0), ("b", "a", 0.0)], "i string, j string, value double")
    assert [x.eigval for x in spectral.eigenvalues(flat).collect()] == [0.0, 0.0]
    assert spectral.eigenvectors(flat, 2).count() == 4 and spectral.permutation_null(flat, 2).first().null_maxeig == 0.0


@pytest.mark.parametrize(("n", "cells", "scale"), [(150, 3000, 1.0), (300, 900, 1e-6), (2, 1, 1.0), (3, 2, 1e6), (40, 30, 1.0)])
def test_largest_value_without_a_space(monkeypatch, n, cells, scale):
    monkeypatch.setattr(lanczos, "SLICE", 64)
    r, c, value, dense = random_skew(n, cells)
    held = lanczos.Cells(r, c, value * scale, n)
    x = np.random.default_rng(1).standard_normal(n)
    assert np.allclose(held.times(x), scale * dense @ x)
    assert lanczos.largest_value(held) == pytest.approx(scale * np.linalg.eigvalsh(1j * dense)[-1], rel=1e-8)


def test_equal_largest_values():
    r = 2 * np.arange(25)
    assert lanczos.largest_value(lanczos.Cells(r, r + 1, np.r_[np.full(20, 3.0), np.ones(5)], 80)) == pytest.approx(3.0, abs=1e-8)


def test_matrices_that_the_driver_does_not_gather(spark, monkeypatch):
    """More cells than are gathered: the same null from tasks that get the cells by a shuffle."""
    held = spectral.Skew(as_matrix(spark, *random_skew(60, 500, 4)[:3]))
    wanted = {x.perm_id: x.null_maxeig for x in spectral.permutation_null(held, 30, 1).collect()}
    monkeypatch.setattr(spectral, "GATHERED", 100)
    monkeypatch.setattr(spectral, "AT_ONCE", 64)
    with pytest.raises(ValueError):
        held.arrays()
    got = {x.perm_id: x.null_maxeig for x in spectral.permutation_null(held, 30, 1).collect()}
    assert set(got) == set(range(30)) and all(got[k] == pytest.approx(wanted[k], abs=1e-9) for k in got)
    assert spectral.largest(held) > 0


def test_moments_of_more_nodes_than_a_whole_spectrum(spark, monkeypatch):
    r, c, value, dense = random_skew(40, 200, 8)
    r, c, value = np.r_[r, np.zeros(30, int)], np.r_[c, np.arange(40, 70)], np.r_[value, np.linspace(1, 2, 30)]  # a hub
    monkeypatch.setattr(spectral, "MOST_NODES", 10)
    dense = np.zeros((70, 70))
    dense[r, c], dense[c, r] = value, -value
    got = spectral.moments(as_matrix(spark, r, c, value)).first()
    powers = np.linalg.eigvalsh(1j * dense)
    assert got.n == 70 and got.squares == pytest.approx((powers**2).sum()) and got.fourths == pytest.approx((powers**4).sum())


def test_pairs_without_returns_go_before_the_regressions(spark):
    series = spark.createDataFrame([("a", 0, 0.1), ("b", 0, 0.1)], "gvkey string, t_idx int, r double")
    edges = spark.createDataFrame([("a", "b", 0.5), ("a", "b", 0.7), ("a", "zz", 1.0), ("yy", "b", 1.0)], "customer_gvkey string, supplier_gvkey string, weight_wji double")
    assert sorted(tuple(x) for x in matrix.both_ways(matrix.among(series, edges)).collect()) == [("a", "b"), ("b", "a")]


@pytest.mark.parametrize("vectors", [68, 84, 164])
def test_the_matrix_of_60_times_the_tables_fits_a_task(vectors):
    """2, 10 and 50 pairs of 89,983 nodes and 3,224,644 cells: what all steps over tables would rewrite stays in one task."""
    s = object.__new__(spectral.Skew)
    s.n, s.count = 89_983, 3_224_644
    assert s.fits(2 * vectors)


def test_whole_spectrum_by_connected_parts(spark):
    """More nodes than one dense matrix may have: a star, many pairs, a ring with chords, and a node without cells."""
    rng = np.random.default_rng(5)
    star = [(f"h{0:05d}", f"h{i:05d}", 1.0 + i % 3) for i in range(1, 4500)]
    pairs = [(f"p{i:05d}a", f"p{i:05d}b", float(i + 1)) for i in range(40)]
    ring = {(i, (i + d) % 21): float(rng.normal()) for i in range(21) for d in (1, 3)}
    rows = star + pairs + [(f"r{i:02d}", f"r{j:02d}", v) for (i, j), v in ring.items()] + [("z", "z", 0.0)]
    cells = pd.DataFrame([x for i, j, v in rows for x in ((i, j, v), (j, i, -v))], columns=["i", "j", "value"])
    got = spectral.eigenvalues(spark.createDataFrame(cells)).orderBy("rank").toPandas()
    dense = np.zeros((21, 21), complex)
    for (i, j), v in ring.items():
        dense[i, j], dense[j, i] = 1j * v, -1j * v
    sigma = np.sqrt(sum(v * v for _, _, v in star))
    want = [sigma, -sigma, *[x for p in pairs for x in (p[2], -p[2])], *np.linalg.eigvalsh(dense)]
    want = np.sort(np.concatenate([want, np.zeros(4500 + 80 + 21 + 1 - len(want))]))[::-1]
    assert got["rank"].tolist() == list(range(1, 4603))
    assert np.allclose(got.eigval, want, atol=1e-9)


@pytest.mark.parametrize(("n", "cells", "hubs", "width"), [(1, 0, 0, 4), (2, 1, 0, 4), (9, 20, 0, 4), (65, 400, 0, 16), (130, 900, 0, 96), (200, 700, 15, 96), (300, 900, 70, 96), (40, 60, 5, 3)])
def test_whole_spectrum_in_half_the_size(n, cells, hubs, width, monkeypatch):
    """Random matrices, and those whose cells all touch a few nodes, which are folded."""
    monkeypatch.setattr(dense, "WIDTH", width)
    monkeypatch.setattr(spectral, "FOLDED", 32)
    r, c, value, full = random_skew(n, cells, n)
    if hubs:
        kept = r < hubs
        r, c, value = r[kept], c[kept], value[kept]
        full[hubs:, hubs:] = 0
    got = spectral.whole_spectrum(r, c, value, n)
    assert len(got) == n and np.allclose(got, np.linalg.eigvalsh(1j * full)[::-1], atol=1e-11)


def test_a_connected_part_of_more_than_4000_nodes():
    """A random part that no few nodes touch: the sums of squares and of fourth powers are those of the cells."""
    rng, n = np.random.default_rng(6), 4100
    at = np.unique(np.concatenate([np.arange(n - 1) * n + np.arange(1, n), *(np.sort(rng.integers(0, n, (6 * n, 2)), axis=1) @ [[n], [1]]).T]))
    r, c = at // n, at % n
    r, c = r[r < c], c[r < c]
    value = rng.standard_normal(len(r))
    cells = pd.DataFrame({"r": r, "c": c, "value": value})
    got = spectral.part_spectrum(cells).eigval.to_numpy()
    assert 2 * spectral.cover_of(r, c, n).sum() > 4000 and len(got) == n and np.allclose(got, -got[::-1], atol=1e-10)
    assert (got**2).sum() == pytest.approx(2 * (value**2).sum(), rel=1e-11)
    assert got[0] == pytest.approx(lanczos.largest_value(lanczos.Cells(r, c, value, n)), rel=1e-8)


def test_a_permuted_matrix_of_many_cells_takes_little_memory(monkeypatch):
    """What a task holds beside its packs, while it permutes them and multiplies: below 30 bytes a cell, and the same values."""
    monkeypatch.setattr(spectral, "PACK", 1 << 14)
    monkeypatch.setattr(lanczos, "SLICE", 1 << 14)
    n, m = 4000, 600_000
    rng = np.random.default_rng(9)
    at = np.sort(rng.choice(n * (n - 1) // 2, m, replace=False))
    r, c = spectral.cell_of(at, n)
    value = rng.standard_normal(m)
    table = pa.RecordBatch.from_pydict({"r": r.astype(np.int32), "c": c.astype(np.int32), "value": value})
    packs, keys = spectral.unpacked(spectral.pack(table.slice(k, 10_000) for k in range(0, m, 10_000)))
    assert len(packs) > 20 and sum(len(p[3]) for p in packs) == m
    x = rng.standard_normal(n)
    assert np.allclose(spectral.joined(packs, n).times(x), lanczos.Cells(r, c, value, n).times(x))
    tracemalloc.start()
    cells = spectral.permuted_packs(packs, n, 7, 3)
    image = cells.times(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * m
    assert np.allclose(image, lanczos.Cells(*spectral.permuted(r, c, value, n, 7, 3), n).times(x))


def test_close_values_of_many_nodes_take_few_products(monkeypatch):
    """Single vectors reach the same pairs as blocks with less than half of the products, and a larger value that is left out shows."""
    n, k = 3000, 6
    r, c, value, _ = random_skew(n, 30_000, 2)
    products, times = [0], lanczos.Cells.times

    def counted(self, x):
        products[0] += 1
        return times(self, x)

    monkeypatch.setattr(lanczos.Cells, "times", counted)
    wanted, _ = lanczos.leading(lanczos.Held(r, c, value, n), n, k)
    by_blocks, products[0] = products[0], 0
    monkeypatch.setattr(lanczos, "MANY", 100)
    space = lanczos.Held(r, c, value, n)
    found, u = lanczos.leading_of_many(space, n, k)
    assert products[0] < by_blocks / 2
    v = space.q @ u
    image = np.stack([times(space.cells, v[:, j].real.copy()) + 1j * times(space.cells, v[:, j].imag.copy()) for j in range(k)], axis=1)
    assert np.allclose(found, wanted, atol=1e-8) and np.abs(1j * image - v * found).max() < 1e-6 and np.allclose(v.conj().T @ v, np.eye(k), atol=1e-8)
    pairs = 2 * np.arange(60)  # values that are there twelve times
    r, c, value = pairs, pairs + 1, np.r_[np.full(12, 3.0), np.linspace(0.1, 2.9, 48)]
    assert np.allclose(lanczos.leading_of_many(lanczos.Held(r, c, value, 400), 400, 10)[0], 3.0, atol=1e-8)


def test_tables_of_a_space_are_deleted(spark):
    """Steps over tables leave no table that was replaced, and none at the end."""
    r, c, value, _ = random_skew(30, 100, 3)
    held = spectral.Skew(as_matrix(spark, r, c, value))
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    space = lanczos.Spread(held.cells, held.names.select("at"))
    lanczos.leading(space, held.n, 2, 4)
    left = [x for x in set(os.listdir(folder)) - before if x.startswith("lanczos-space")]
    assert len(left) == 1
    space.drop()
    assert not [x for x in set(os.listdir(folder)) - before if x.startswith("lanczos")]
