import datetime as dt
import math

import numpy as np
import pytest

from tidelag.operators import asof, panel, panelreg, stats

D = [dt.date(2024, 1, d) for d in (1, 2, 5)]


def test_asof(spark):
    edges = spark.createDataFrame([("c", "s", D[1], 1.0, 1), ("c", "s", D[1], 2.0, 2)], "customer_gvkey string, supplier_gvkey string, date date, weight_wji double, ord long")
    days = spark.createDataFrame([(d,) for d in D], "date date")
    assert {r.date: r.weight_wji for r in asof.weights_on(edges, days).collect()} == {D[1]: 2.0, D[2]: 2.0}
    returns = spark.createDataFrame([("c", d, 0.5) for d in D], "gvkey string, date date, r double")
    assert {r.date: r.y for r in asof.signal(returns, edges, "supplier_gvkey", "customer_gvkey", "y").collect()} == {D[1]: 1.0, D[2]: 1.0}


def test_asof_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = dt.date(2024, 1, 1)
    edges = sorted({(f"c{rng.integers(4)}", f"s{rng.integers(3)}", base + dt.timedelta(int(rng.integers(30)))): float(rng.random()) for _ in range(60)}.items())
    returns = {(f"c{i}", base + dt.timedelta(d)): float(rng.normal()) for i in range(4) for d in range(30) if rng.random() < 0.8}
    expected = {}
    for (c, d), r in returns.items():
        for s in ("s0", "s1", "s2"):
            known = [(k[2], w) for k, w in edges if k[:2] == (c, s) and k[2] <= d]
            if known:
                expected[s, d] = expected.get((s, d), 0.0) + max(known)[1] * r
    e = spark.createDataFrame([(*k, w, i) for i, (k, w) in enumerate(edges)], "customer_gvkey string, supplier_gvkey string, date date, weight_wji double, ord long")
    x = spark.createDataFrame([(*k, r) for k, r in returns.items()], "gvkey string, date date, r double")
    got = {(r.supplier_gvkey, r.date): r.y for r in asof.signal(x, e, "supplier_gvkey", "customer_gvkey", "y").collect()}
    assert got.keys() == expected.keys() and all(math.isclose(got[k], expected[k], abs_tol=1e-12) for k in got)


def test_leads_count_rows_of_the_entity(spark):
    returns = spark.createDataFrame([("a", D[0], 1.0), ("a", D[2], 3.0), ("b", D[0], 1.0), ("b", D[1], 2.0), ("b", D[2], 3.0)], "gvkey string, date date, r double")
    none = spark.createDataFrame([], "customer_gvkey string, supplier_gvkey string, date date, weight_wji double, ord long")
    rows = {(r.supplier_gvkey, r.date): r for r in panel.panel(returns, none, "forward", 1).collect()}
    assert rows["a", D[0]].sup_r_fwd_1 == 3.0 and rows["b", D[0]].sup_r_fwd_1 == 2.0 and rows["b", D[1]].sup_r_lag_1 == 1.0
    assert all(r.y == 0.0 for r in rows.values()) and ("a", D[2]) not in rows
    with pytest.raises(ValueError):
        panel.panel(returns, none, "sideways")


def test_quantiles_are_exact(spark):
    rows = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 10.0)], "x double")
    got = sorted(r.x for r in stats.winsorize(rows, "x").collect())
    assert got == pytest.approx([1.03, 2.0, 4.0, 9.82])


def test_ols_guards_and_parity(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=30), rng.normal(size=30)
    data = [("ok", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [("short", float(i), 1.0 * i * i) for i in range(9)] + [("flat", 1.0, float(i)) for i in range(12)] + [("exact", float(i), 2.0 * i) for i in range(12)]
    got = {r.k: r for r in stats.ols_by(spark.createDataFrame(data, "k string, x double, y double"), ["k"], "y", "x").collect()}
    xc = x - x.mean()
    beta = xc @ y / (xc @ xc)
    rest = y - y.mean() - beta * xc
    assert got["ok"].beta == pytest.approx(beta) and got["ok"].t == pytest.approx(beta / math.sqrt(rest @ rest / 28 / (xc @ xc)))
    assert got["short"].beta is None and got["flat"].beta is None and got["exact"].beta == pytest.approx(2.0) and got["exact"].t is None


def test_fixed_effects_equal_dummy_regression(spark):
    rng = np.random.default_rng(2)
    rows = [(f"e{i}", dt.date(2024, 1, 1) + dt.timedelta(t), *map(float, rng.normal(size=3))) for i in range(8) for t in range(20) if rng.random() < 0.85]
    rows = [(e, d, y + 0.7 * a, a, b) for e, d, y, a, b in rows]
    frame = spark.createDataFrame(rows, "e string, date date, y double, a double, b double")
    fit = panelreg.within_ols(frame, ["y"], ["a", "b"], "e")[0]
    names, days = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    x = np.array([[r[3], r[4], *(r[0] == n for n in names), *(r[1] == d for d in days[1:])] for r in rows], float)
    y = np.array([r[2] for r in rows])
    full = np.linalg.lstsq(x, y, rcond=None)[0]
    assert fit["nobs"] == len(rows) and fit["beta"] == pytest.approx(full[0], abs=1e-9)
    dummies = x[:, 2:]
    within = x[:, :2] - dummies @ np.linalg.lstsq(dummies, x[:, :2], rcond=None)[0]
    scores = np.array([within[[r[0] == n for r in rows]].T @ (y - x @ full)[[r[0] == n for r in rows]] for n in names])
    bread = np.linalg.inv(within.T @ within)
    g, n, k = len(names), len(rows), 2 + len(names) + len(days) - 1
    error = math.sqrt((bread @ scores.T @ scores @ bread)[0, 0] * g / (g - 1) * (n - 1) / (n - k))
    assert fit["se"] == pytest.approx(error, rel=1e-6) and 0 <= fit["p"] <= 1
    assert math.isnan(panelreg.within_ols(frame.limit(3), ["y"], ["a", "b"], "e")[0]["beta"])


def test_signal_in_groups_of_few_intervals(spark, monkeypatch):
    """Hot entities over several groups, gaps, NULL returns and weights, several blocks: against plain loops."""
    import datetime as dt

    import numpy as np

    from tidelag.operators import asof

    monkeypatch.setattr(asof, "GROUP", 40)
    monkeypatch.setattr(asof, "AT_ONCE", 16)
    rng = np.random.default_rng(3)
    day = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(70)]
    r = {(f"s{s}", d): None if rng.random() < 0.1 else float(rng.normal()) for s in range(30) for d in day if rng.random() < 0.8}
    edges = {(f"e{e}", f"s{s}", day[int(rng.integers(70))]): None if rng.random() < 0.1 else float(rng.random()) for e, most in ((0, 90), (1, 10), (2, 3)) for s in rng.integers(0, 35, most).tolist()}
    got = asof.signal(
        spark.createDataFrame([(s, d, v) for (s, d), v in r.items()], "gvkey string, date date, r double"),
        spark.createDataFrame([(*k, w) for k, w in edges.items()], "supplier_gvkey string, customer_gvkey string, date date, weight_wji double"), "supplier_gvkey", "customer_gvkey", "y",
    ).collect()
    wanted = {}
    for (e, s, lo), w in edges.items():
        hi = min((d for a, b, d in edges if (a, b) == (e, s) and d > lo), default=dt.date.max)
        for d in day:
            if lo <= d < hi and (s, d) in r:
                wanted[e, d] = wanted.get((e, d), 0.0) + (0.0 if w is None or r[s, d] is None else w * r[s, d])
    assert len(got) == len(wanted) and {(x.supplier_gvkey, x.date): round(x.y, 9) for x in got} == {k: round(v, 9) for k, v in wanted.items()}
