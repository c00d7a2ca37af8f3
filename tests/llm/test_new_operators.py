"""Hard negatives, the manifest and the mixture against brute force, with odd rows."""

from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from tidelag.llm import manifest, mixing, negatives

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, size long"


def brute_negatives(rows, every=100):
    """From distinct vec_ids only."""
    kept = []
    for vec_id, label, v in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [int(np.floor(256 * x)) for x in v]))
    out = []
    for a, la, va in kept:
        if a % every:
            continue
        found = sorted((-sum(x * y for x, y in zip(va, v)), i, lab) for i, lab, v in kept if i != a and len(v) == len(va))
        for score, i, lab in [x for x in found if x[2] == la][:5]:
            inside = [x for x in found if x[2] != la and 30 * -score <= 100 * -x[0] <= 90 * -score][:10]
            out += [(a, i, r + 1, x[1], -score, -x[0]) for r, x in enumerate(inside)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 60)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 7)
    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(0.05, 0.1, (400, 6)), 2)
    vectors[50:150] = vectors[50]  # ties
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(400, None, [0.1] * 6), (401, 1, None), (402, 1, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (403, 1, [float("nan")] * 6), (404, 1, [float("inf")] * 6), (405, 2, [0.5] * 3), (410, 2, [0.4] * 3), (420, 1, [0.3] * 3), (430, 1, []), (440, 1, []), (-20, 1, [0.2] * 6)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, cell string")
    got = sorted(map(tuple, negatives.mine(df, every=10).collect()))
    assert got == brute_negatives(rows, 10) and len(got) > 500


def test_hard_negatives_of_repeated_rows_and_empty_tables(spark):
    rows = [(100, 1, [1.0]), (100, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.5]), (2, 2, [0.5]), (None, 1, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert sorted(map(tuple, negatives.mine(df).collect())) == [(100, 1, 1, 2, 65536, 32768), (100, 1, 2, 2, 65536, 32768)]
    assert negatives.mine(df.limit(0)).collect() == []


def test_keys_sort_as_numbers():
    rows = [(a, f, k, i) for a in (-3, 0, 2**62) for f in (-(2**62), 0, 5) for k in (0, 1) for i in (-1, 0, 9)]
    assert sorted(rows) == [(a, -s, k, i) for a, s, k, i in map(negatives.unpacked, sorted(negatives.key(*r) for r in rows))]


def test_large_components_have_exact_scores(spark):
    rows = [(100, 1, [1e6, 3.0]), (1, 1, [1e6, 1.0]), (2, 2, [0.8e6, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert [tuple(r) for r in negatives.mine(df).collect()] == brute_negatives(rows) != []


def text_of(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute_manifest(rows):
    """rows of (doc_id, text, lang, source, n_chars)."""
    h = lambda *d: sha256("".join(d).encode()).hexdigest()
    trees = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        moved = n + 1 if n is not None and doc_id is not None and crc32(str(doc_id).encode()) % 7 == 0 else n
        own, seen = (h(*(text_of(x) for x in (doc_id, source, lang, m, text))) for m in (n, moved))
        trees[lang].append(((doc_id is not None, doc_id or 0, own), doc_id, own, seen))

    def proofs(nodes):
        at, paths = list(range(len(nodes))), [[] for _ in nodes]
        while len(nodes) > 1:
            for k, i in enumerate(at):
                paths[k].append((i & 1, nodes[i ^ 1] if i ^ 1 < len(nodes) else ""))
            nodes, at = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], [i >> 1 for i in at]
        return nodes[0], paths

    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    lower = {}
    for lang in order:
        trees[lang].sort()
        lower[lang] = proofs([x[2] for x in trees[lang]])
    root, upper = proofs([lower[x][0] for x in order])
    out = []
    for lang, above in zip(order, upper):
        subroot, paths = lower[lang]
        for (_, doc_id, own, seen), path in zip(trees[lang], paths):
            node = seen
            for left, beside in path + above:
                node = h(beside, node) if left else h(node, beside)
            out.append((doc_id, own, subroot, root, h(*(b for _, b in path + above)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1, 2, 9])
def test_manifest_equals_brute_force(spark, bits):
    rng = np.random.default_rng(bits)
    ids = [-5, -1, 0, 63, 64, 65, 2**20, 2**40, 2**62, -(2**63), *rng.choice(5000, 60, replace=False).tolist()]
    rows = [(int(i), f"text {i}" if i % 5 else None, [None, "", "de", "é", "z"][i % 5] if i % 3 else "en", None if i % 4 == 0 else "s", None if i % 6 == 0 else int(i) % 100) for i in ids]
    rows += [(7, "a", "en", "s", 1), (7, "b", "en", "s", 1), (7, "b", "en", "s", 1), (None, "x", "en", "s", 3), (None, "y", "en", None, None), (None, "x", None, "s", 3), (9, "long " * 50_000, "xx", "s", 250_000)]
    df = spark.createDataFrame([(*r, "?", 3, 4) for r in rows], DOCS)
    got = sorted((tuple(r) for r in manifest.manifest(df, slot_bits=bits).collect()), key=str)
    assert got == brute_manifest(rows)


def test_manifest_of_one_row_and_of_none(spark):
    df = spark.createDataFrame([(3, "a", "en", "s", 1, "", 0, 0)], DOCS)
    row = manifest.manifest(df).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == sha256(b"").hexdigest() and row.verified
    assert manifest.manifest(df.limit(0)).collect() == []


def brute_targets(sizes):
    names = sorted({s for s in sizes if s is not None}, key=lambda x: x.encode()) + [None] * (None in sizes)
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= over


@pytest.mark.parametrize("share_rows", [20, 2000])
def test_mixture(spark, monkeypatch, share_rows):
    monkeypatch.setattr(mixing, "SHARE_ROWS", share_rows)
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 60)), "en", ["a", "b", "B", "é", "z", None][min(5, int(rng.exponential(1.2)))], 1, "t", 0, 7) for i in range(3000)]
    rows += [(None, "x y z\x0bq", "en", "a", 1, "t", 0, 7), (5001, None, "en", "only", 1, "t", 0, 7), (5002, "", "en", "only", 1, "t", 0, 7)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    sizes, source = defaultdict(int), {}
    for r in rows:
        n = len((r[1] or "").replace("\x0b", " ").split(" ")) - (r[1] or " ").endswith(" ") if r[1] else 0
        sizes[r[3]] += n
        source[r[0]] = r[3]
    assert len(got) == len(rows)
    wanted, taken = brute_targets(dict(sizes)), defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(wanted[s]) and r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
    assert all(abs(taken[s] - wanted[s]) <= 30 for s in sizes)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(df.limit(0)).collect() == []


def test_mixture_draws_each_document_alike(spark):
    """Over seeds a document's mean share of its size is its source's ratio."""
    df = spark.createDataFrame([(i, "w " * (1 + i % 9), "en", "ab"[i % 2], 1, "", 0, 0) for i in range(120)], DOCS)
    runs = [mixing.mix(df, seed=s).where("source_size > 0").collect() for s in range(12)]
    ratio = np.mean([[r.taken / r["size"] for r in sorted(run, key=lambda r: r.doc_id)] for run in runs], axis=0)
    target = {r.doc_id: r.target / r.source_size for r in runs[0]}
    for side in (0, 1):
        own = [ratio[i] for i in range(120) if i % 2 == side]
        assert np.mean(own) == pytest.approx(target[side], abs=0.08)
