"""Operators on small fixtures against brute force: nulls, empty and long texts, ties, repeated rows."""

import collections
import hashlib
import math
import re
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelag.llm import common, decontaminate, jaccard, media, pii, pitman_yor, quality, separators, substrings, toxicity
from tidelag.llm.common import hashed_words

LONG = " ".join(f"w{i % 97} the{i}" for i in range(3000))
BASE = "the quick brown fox jumps over the lazy dog while many other animals look on and wonder what all of this is about today " * 3
TEXTS = [
    (0, BASE), (1, BASE), (2, BASE.replace("quick", "slow", 1)), (3, None), (4, ""), (5, "   \n\t "), (6, LONG), (7, LONG + " end"), (8, "one two"), (9, "ONE Two"),
    (10, "x" * 150 + "y" + "x" * 150), (11, "Shti " * 200), (12, "café " * 60), (13, BASE[40:260]), (13, BASE[40:260]), (14, "a b c d e"), (15, "unrelated words stand here alone in this row of the table"),
]


def frame(spark, rows=TEXTS):
    data = [(i, t, "en", "clash", "clash", 1) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, component_id string, n string, label int")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, []).where("false")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_media(docs, empty):
    rows = media.media_digest(docs).collect()
    assert len(rows) == len(TEXTS) and media.media_digest(empty).count() == 0
    by_id = {r.doc_id: r for r in rows}
    for i, text in TEXTS:
        payload = media.pad((text or "").encode())
        r = by_id[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert by_id[0].media_sha256 == by_id[1].media_sha256 != by_id[2].media_sha256


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_jaccard(spark, docs, empty):
    got = jaccard.components(docs).collect()
    assert len(got) == len(TEXTS) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(TEXTS)
    assert jaccard.components(empty).count() == 0


def test_jaccard_chains_and_groups(spark):
    rng = np.random.default_rng(5)
    rows, start = [], [f"t{rng.integers(50)}" for _ in range(80)]
    for i in range(120):  # a chain: each a few words on from the one before
        if i % 3 == 0:
            start = list(start)
            start[rng.integers(80)] = f"u{i}"
        rows.append((i, " ".join(start)))
    rows += [(1000 + i, " ".join(f"v{rng.integers(9)}" for _ in range(rng.integers(3, 40)))) for i in range(80)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_jaccard_blocks_of_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_BLOCK", 3)
    monkeypatch.setattr(jaccard, "star_pairs", lambda m: m.select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).where("false"))
    rows = [(i, " ".join(f"w{k}" for k in range(60) if k != i)) for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def outlier_family(n):
    """Near copies, and a document of smaller id that shares their shingles but links with none."""
    text = [f"w{k}" for k in range(120)]
    near = [(i, " ".join([*text[: 20 + i % 80], f"x{i}", *text[21 + i % 80 :]])) for i in range(1, n)]
    return [(0, " ".join([*text[:100], *(f"y{k}" for k in range(60))])), *near]


def test_jaccard_pairs_stay_linear(spark, monkeypatch):
    compared = []
    verify, tile_links = jaccard.verify, jaccard.tile_links
    monkeypatch.setattr(jaccard, "verify", lambda pairs, *a: compared.append(pairs.count()) or verify(pairs, *a))
    monkeypatch.setattr(jaccard, "tile_links", lambda *a: compared.append((found := tile_links(*a)).count()) or found)
    rows = outlier_family(2000)
    got = {r.component_id for r in jaccard.components(frame(spark, rows)).collect()}
    assert got == {0, 1} and sum(compared) < 10 * len(rows)


def test_jaccard_families_that_do_not_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_BLOCK", 20)
    rng = np.random.default_rng(3)
    text = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(60):  # each a few words from the common text, so that most pairs are near the threshold
        own = list(text)
        for k in rng.choice(100, 1 + i % 4, replace=False):
            own[k] = f"z{i}-{k}"
        rows.append((i, " ".join(own)))
    rows += outlier_family(40)[::-1][:30]
    rows = [(100 * k + i, t) for k, (i, t) in enumerate(rows)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(frame(spark, rows).repartition(3)).collect()}
    assert got == brute_components(rows)


def test_jaccard_rows_of_one_doc_id(spark):
    one, two = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    rows = [(5, one), (5, two), (3, one + " end"), (8, two + " end"), (9, two), (7, one), (1, "apart from all of the others")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.components(frame(spark, rows).repartition(4)).collect()}
    assert {c for (i, _), c in got.items() if i != 1} == {3} and got[1, 2] == 1


SEED = bytes(range(16))


def test_jaccard_sends_what_the_text_holds(spark):
    rows = [(i, " ".join(f"w{(i * 37 + k * k) % 5000}" for k in range(150))) for i in range(3000)]
    ids, flat, sizes = next(jaccard.units(iter([frame(spark, rows).select("doc_id", "text").toPandas()]), SEED, 5))

    def size(buckets):
        sent = jaccard.unit_rows(0, ids, flat, sizes, buckets)
        return sum(len(zlib.compress(b"".join(sent[c]), 1)) for c in ("slots", "more", "low", "high", "counts")) + 40 * len(sent)

    assert size(512) < 1.1 * size(8)
    few = jaccard.profile(frame(spark, rows).select("doc_id", "text"), buckets=3, seed=SEED).drop("sig", "shared", "prefix", "own")
    many = jaccard.profile(frame(spark, rows).select("doc_id", "text"), buckets=200, seed=SEED).drop("sig", "shared", "prefix", "own")
    assert few.exceptAll(many).count() == 0


def test_jaccard_deals_near_misses_once(spark, monkeypatch):
    """Families that share most shingles and link nowhere: rows dealt grow with the family, not with its square."""
    dealt, real = [], jaccard.compared
    monkeypatch.setattr(jaccard, "compared", lambda rows, *a: dealt.append(rows.count()) or real(rows, *a))
    counts = []
    for m in (250, 500, 1000):
        common = [f"w{k}" for k in range(100)]
        rows = [(i, " ".join(common[:50] + [f"own{i}x{k}" for k in range(15)] + common[50:])) for i in range(m)]
        dealt.clear()
        got = jaccard.components(frame(spark, rows)).collect()
        assert all(r.component_id == r.doc_id for r in got)
        counts.append(sum(dealt))
    assert counts[0] > 0 and counts[1] <= 2.2 * counts[0] and counts[2] <= 2.2 * counts[1]


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_spent_shuffles_leave_the_disk(spark):
    """What a staged table was made of goes as soon as it is written, and the session's setting is as it was."""
    before, setting = shuffle_files(spark), spark.conf.get(common.CLEANUP)
    table = common.staged(frame(spark, [(i, f"w{i % 7}") for i in range(100)]).groupBy("text").count(), "spent-test")
    counted = jaccard.shared_shingles(common.texts(frame(spark)).coalesce(2), buckets=3)
    assert not shuffle_files(spark) - before and spark.conf.get(common.CLEANUP) == setting
    assert table.count() == 7 and counted.where("kind = 1").count() == 2


def test_jaccard_holds_few_bytes_for_each_shingle():
    """A unit and a range of hashes hold some 60 bytes for each shingle at most, of which 8 are the input's."""
    rng = np.random.default_rng(1)
    n, each = 400_000, 200
    flat = np.sort(rng.integers(0, 1 << 63, (n // each, each), dtype=np.uint64), axis=1).ravel()
    ids, sizes = np.arange(n // each), np.full(n // each, each)
    tracemalloc.start()
    try:
        rows = [jaccard.unit_rows(u, ids, flat, sizes, 3) for u in range(2)]
        made = tracemalloc.get_traced_memory()
        assert made[1] - made[0] < 60 * n
        batch = pd.concat([r[(r.kind == jaccard.KEYS) & (r.bucket == 0)] for r in rows])
        held = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        found = jaccard.shared_keys(batch)
        assert tracemalloc.get_traced_memory()[1] - held < 60 * 2 * n / 3
    finally:
        tracemalloc.stop()
    assert sum(len(h) for h in found.high) == sum(len(h) for h in batch.high)


def test_jaccard_gets_few_rows_at_once(spark, monkeypatch):
    """Texts come to a task in batches of ``BATCH_ROWS``, and the session's setting is as it was."""
    setting, real = spark.conf.get(common.BATCH), jaccard.units
    monkeypatch.setattr(jaccard, "BATCH_ROWS", 2)

    def watched(batches, *how):
        def seen():
            for batch in batches:
                if len(batch) > 2:
                    raise ValueError(f"{len(batch)} rows at once")
                yield batch

        return real(seen(), *how)

    jaccard.units = watched
    try:
        assert jaccard.shared_shingles(common.texts(frame(spark)).coalesce(1), buckets=3).count()
    finally:
        jaccard.units = real
    assert spark.conf.get(common.BATCH) == setting


def test_jaccard_sums_of_equal_keys():
    keys, weight = np.array([5, 1, 5, 9, 1, 5], np.uint64), np.array([1, 2, 3, 4, 5, 6], np.uint32)
    assert jaccard.sums_of_equal(keys, weight).tolist() == [10, 7, 10, 4, 7, 10]


def test_hashed_words_are_the_words():
    texts_ = [t or "" for _, t in TEXTS] + ["A a\x1cb Ünï\u00a0x\x0b\x0cz", " lead", "trail "]
    hashes, lengths = hashed_words(texts_, SEED)
    flat = [w for t in texts_ for w in words(t)]
    assert lengths.tolist() == [len(words(t)) for t in texts_]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


def test_jaccard_copies_in_descending_order(spark):
    text = [f"w{k}" for k in range(60)]
    near = [" ".join(text[:k] + ["x"] + text[k + 1 :]) for k in (3, 30)]
    rows = [(10, " ".join(text)), (5, " ".join(text)), (8, near[0]), (7, near[1]), (2, near[1]), (9, "alone")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(frame(spark, rows).coalesce(1)).collect()}
    assert got == brute_components(rows) and got[10][1] == 2


def brute_substrings(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\x01" * 100
            seen.add(w)
        out[i] = (len(raw), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


def test_substrings(spark, empty):
    rows = [r for k, r in enumerate(TEXTS) if k != 14]  # one row for each doc_id
    got = substrings.digest(substrings.remove_repeats(frame(spark, rows).repartition(3))).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_substrings(rows)
    assert substrings.remove_repeats(empty).count() == 0
    assert substrings.remove_repeats(frame(spark)).count() == len(TEXTS)


def test_substrings_random(spark):
    rng = np.random.default_rng(8)
    pool = ["".join(rng.choice(list("abé "), 130)) for _ in range(6)]
    rows = [(i, "".join(pool[rng.integers(6)][rng.integers(30) :] + "".join(rng.choice(list("xyz"), rng.integers(4))) for _ in range(rng.integers(1, 5)))) for i in range(60)]
    got = substrings.digest(substrings.remove_repeats(frame(spark, rows))).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_substrings(rows)


def test_substrings_that_a_plain_hash_takes_for_equal(spark):
    """Ten bytes that a polynomial modulo 2**64 cannot tell from ten others, between equal letters."""
    a, b = "a" * 60, "b" * 60
    rows = [(1, a + "=<h<P@e<<<" + b), (2, a + "<Y<G<<<g?X" + b)]
    got = substrings.digest(substrings.remove_repeats(frame(spark, rows))).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in got} == {1: (130, 0, 0), 2: (130, 0, 0)}
    one, two = (np.frombuffer(x[1].encode(), np.uint8) for x in rows)
    whole = np.array([0]), np.array([130])
    assert substrings.Hashes(one).of(*whole) == substrings.Hashes(two).of(*whole)


def test_substrings_of_repeated_rows(spark):
    rng = np.random.default_rng(4)
    one, two, three = ("".join(rng.choice(list("abcdef"), 400)) for _ in range(3))
    once = [(3, one), (5, two), (6, two[:150] + "#" + two[150:]), (7, three + "-" + three), (9, one[:250])]
    rows = [*once, (3, one), (5, two), (6, two[:150] + "#" + two[150:]), (7, three + "-" + three), (3, one)]
    got = substrings.digest(substrings.remove_repeats(frame(spark, rows).repartition(3))).collect()
    assert len(got) == len(rows) and {tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got} == {(i, *x) for i, x in brute_substrings(once).items()}


def test_separators(spark, docs, empty, tmp_path):
    import public_tokenizers

    coder = separators.tokenizer(str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    got = separators.count_tokens(docs, block_tokens=64).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((i, len(coder.encode_ordinary(t or ""))) for i, t in TEXTS)
    assert separators.count_tokens(empty).count() == 0
    flat = np.array([5, 6, 50256, 50256, 7, 8, 9], "<u2")
    (tmp_path / "a.bin").write_bytes(flat.tobytes())
    for size in (1, 2, 3, 100):
        found = separators.scan(separators.blocks_of_files(spark, f"file://{tmp_path}/a.bin", block_tokens=size), block_tokens=size).orderBy("ordinal").collect()
        assert [(r.start, r.n_tokens) for r in found] == [(0, 2), (3, 0), (4, 3)]


KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(x):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(x[::-1])) % 10 == 0


def counts(kind, value):
    n = re.sub("[^0-9]", "", value)
    return kind == "email" or kind == "ip" and all(int(p) <= 255 for p in value.split(".")) or kind == "card" and 16 <= len(n) <= 19 and luhn(n) or kind == "phone" and 8 <= len(n) <= 15


PII_TEXTS = [
    "a@b@c.d_e@f.gh %x@y.z..a@b.c", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4", "4111 1111 1111 1111-4111-1111-1111-1111 x 4111111111111111 +1 (555) 123-4567 +12 é", None, "",
    'é中😀 foo@bar.com 😀 +1 2 3 4 5 6 7 8 token = "abc123def"', "1" * 5000, "1.1." * 1000, "a" * 50000 + "@x", "a.b@c" + ".d" * 2000, "- 4111-1111-1111-1111 - 4", "+1+12345678901+1", "x" * 20000,
]


def test_pii(spark, empty):
    rows = [(i, t) for i, t in enumerate(PII_TEXTS)] + [(100 + i, f'token = "{hashlib.sha1(bytes([i])).hexdigest()}" and token = "id-{i}-key"') for i in range(12)]
    found = pii.find(frame(spark, rows))
    for r in found.collect():
        text = dict(rows)[r.doc_id] or ""
        for kind, pattern in KINDS:
            expected = [(m.start(), m.end()) for m in re.finditer(pattern, text) if counts(kind, m[0])]
            assert [(x.start, x.end) for x in r[kind]] == expected, (r.doc_id, kind)
        if r.doc_id >= 100:  # the second identifier is found by what the first ones taught
            assert [(text[x.start : x.end]).startswith(("id-", text[9:13])) for x in r.further] in ([True], [True, True])
    assert pii.find(empty).count() == 0
    cleaned = {r.doc_id: r.text for r in pii.redact(frame(spark, rows)).collect()}
    assert cleaned[3] is None and cleaned[4] == "" and cleaned[5].startswith("é中😀 <EMAIL> 😀 <PHONE>")
    assert pii.redact(frame(spark, rows)).columns == frame(spark, []).columns


def brute_redacted(text, spans):
    merged = []
    for start, end, kind in sorted(spans):
        if merged and merged[-1][1] > start:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    out, at = [], 0
    for start, end, kind in merged:
        out += [text[at:start], f"<{'ID' if kind == 'further' else kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def test_pii_redaction_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 3)
    monkeypatch.setattr(pii, "PIECE", 5)
    rng = np.random.default_rng(8)
    bits = ["a.b@c.de", "10.2.3.4", "+1 (555) 123-4567", "4111 1111 1111 1111", "é😀", "id-77x9z", "name", "@", ".", " ", " ", "\n", "+49 4111111111111111"]
    rows = [(i, "".join(rng.choice(bits, rng.integers(1, 60)))) for i in range(150)]
    found = {r.doc_id: r for r in pii.find(frame(spark, rows)).collect()}
    cleaned = {r.doc_id: r.text for r in pii.redact(frame(spark, rows)).collect()}
    for i, text in rows:
        spans = [(x.start, x.end, k) for k in (*pii.KINDS, "further") for x in found[i][k]]
        assert cleaned[i] == brute_redacted(text, spans), i
        for kind, pattern in KINDS:
            assert [(x.start, x.end) for x in found[i][kind]] == [(m.start(), m.end()) for m in re.finditer(pattern, text) if counts(kind, m[0])]


def test_pii_long_text_of_matches(spark):
    """A hundred thousand identifiers in one text; the cost is near linear."""
    import time

    text = " ".join(f"user{i % 977}@mail{i % 89}.org 10.0.{i % 256}.{i % 199} key-{i:07d}" for i in range(40_000))
    began = time.time()
    row = pii.find(frame(spark, [(1, text), (2, None)])).where("doc_id = 1").select(*(F.size(k).alias(k) for k in pii.KINDS)).first()
    assert (row.email, row.ip) == (40_000, 40_000) and len(text) > 1_500_000
    short = pii.redact(frame(spark, [(1, text)])).select(F.length("text").alias("n"), F.substring("text", -60, 40).alias("end")).first()
    assert short.n < len(text) and "<IP>" in short.end and time.time() - began < 60


def test_decontamination(spark, docs, empty):
    items = [(1, "What is the colour of a clear sky at noon in summer when no cloud stands in the way? It is a deep and even blue all over."), (2, None), (3, ""), (4, "Seven brown foxes. They jumped over eleven lazy hounds before breakfast.")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, f"start {items[0][1].upper()} end"), (2, "pad " * 500 + items[3][1] + " pad" * 300), (3, "It is a deep and even blue all over."), (4, None), (5, "a clear sky at noon in summer " * 30), (2, items[3][1])]
    got = decontaminate.leaks(frame(spark, rows), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 4), (2, 4)]
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.where("false")).count() == 0


def test_wand_finds_all_that_full_scoring_finds():
    rng = np.random.default_rng(9)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(2, 9)))) for i in range(80)]
    df = collections.Counter(w for _, t in items for w in set(t.split()))
    index = decontaminate.build_index(items, df, len(items), 5.0)
    for _ in range(300):
        query = [index.terms[w] for w in set(rng.choice(vocabulary, rng.integers(1, 25))) if w in index.terms]
        scores = collections.Counter()
        for t in query:
            for p, v in zip(index.places[t], index.impacts[t], strict=True):
                scores[p] += v
        expected = {p for p, v in scores.items() if v >= 1.0 - 1e-9}
        assert {p for p, _ in index.search(query)} == expected


def brute_leaks(docs, items):
    """Every passage against every item, scored in full."""
    items = [(i, decontaminate.item_words(t or ""), t) for i, t in items if decontaminate.item_words(t or "")]
    df = collections.Counter(w for _, ws, _ in items for w in set(ws))
    mean = sum(len(ws) for _, ws, _ in items) / len(items)
    out = []
    for doc, text in docs:
        own = decontaminate.item_words(text or "")
        for i, ws, t in items:
            window = 1 << max(0, len(ws) - 1).bit_length()
            norm = 1.2 * (0.25 + 0.75 * len(ws) / mean)
            impact = {w: math.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + norm) for w, c in collections.Counter(ws).items()}
            best = None
            question, answer = map(decontaminate.trigrams, decontaminate.question_and_answer(t))
            for s in [k for k in range(0, len(own), window) if k == 0 or k < len(own) - window]:
                passage = own[s : s + 2 * window]
                score = sum(v for w, v in impact.items() if w in set(passage)) / (0.8 * sum(impact.values()))
                held = decontaminate.trigrams(passage)
                q = len(question & held) / max(1, len(question))
                a = len(answer & held) / len(answer) if answer else q
                if score >= 1 and min(q, a) >= 0.6:
                    best = max(best or (0,), (score, q, a))
            if best:
                out.append((doc, i if i is not None else -1, *(round(x, 6) for x in best)))
    return sorted(out)


def test_decontamination_equals_full_scoring_for_any_number_of_indices(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(150)] + ["Straße", "don't", "a_b"]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(3, 40))) + ". " + " ".join(rng.choice(vocabulary, rng.integers(0, 9)))) for i in range(60)]
    items += [(None, items[3][1]), (7, items[7][1]), (90, ""), (91, None)]
    docs = []
    for d in range(80):
        text = list(rng.choice(vocabulary, rng.integers(0, 300)))
        for k in rng.choice(60, 2):
            held = items[k][1].split()
            for x in rng.choice(len(held), len(held) * (d % 4) // 8, replace=False):
                held[x] = "other"
            at = rng.integers(0, len(text) + 1)
            text[at:at] = held
        docs.append((d, " ".join(text)))
    docs += [(100, None), (101, ""), (5, docs[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute_leaks(docs, items)

    def found(**how):
        return sorted((r.doc_id, r.item_id if r.item_id is not None else -1, *(round(r[c], 6) for c in ("score", "question_overlap", "answer_overlap"))) for r in decontaminate.leaks(frame(spark, docs), bench, **how).collect())

    assert len(expected) > 40 and found() == expected
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    monkeypatch.setattr(decontaminate, "CELLS", 500)
    monkeypatch.setattr(decontaminate, "PASS_BYTES", decontaminate.INDEX_BYTES + 1)
    assert found(index_words=150) == expected


def test_language_model(spark, docs, empty):
    rows = {(r.doc_id): r for r in pitman_yor.score_documents(docs).collect()}
    train = collections.Counter(w for i, t in TEXTS if zlib.crc32(str(i).encode()) % 5 != 1 for w in [*words(t), None])
    n, v = sum(train.values()), len(train)
    for i, t in TEXTS:
        tokens, r = [*words(t), None], rows[i]
        base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens), sum(train[w] > 0 for w in tokens), n, zlib.crc32(str(i).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    assert sum(r.score for r in rows.values()) > sum(r.base_score for r in rows.values())
    assert pitman_yor.score_documents(empty).count() == 0


def test_language_model_asks_once_for_a_frequent_pair(docs):
    chunk = pitman_yor.Chunk.of(["the cat " * 5000, "the cat ran"], 3)
    pair_of, asked = chunk.pairs(3)
    assert len(pair_of) == 10005 and sum(len(pairs) for *_, pairs in asked) == len(set(pair_of)) == 6
    plan = pitman_yor.score_documents(docs)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" not in plan  # one word's tokens do not meet in a group


def test_language_model_keeps_and_sends_only_pairs_that_recur(spark, docs):
    pairs = collections.Counter()
    for i, t in TEXTS:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            line = [pitman_yor.START, *words(t), pitman_yor.END]
            pairs.update(zip(line[:-1], line[1:], strict=True))
    rows = pitman_yor.texts(docs).withColumn("held_out", pitman_yor.remainder5() == 1)
    counts = pitman_yor.count_words(pitman_yor.chunked(rows, 3), 3)
    kept = {}
    for r in counts.where(counts.kind == pitman_yor.COUNTS).collect():
        table = pitman_yor.unpack(r.bucket, r.a, r.b, r.c, r.d, r.e)
        kept |= {(table.words[w], int(u)): int(n) for w, u, n in zip(table.word, table.context, table.count, strict=True)}
    assert kept == {(w.encode(), int(pitman_yor.hash_of([u])[0])): n for (u, w), n in pairs.items() if n > 1} and 0 < len(kept) < len(pairs)
    asked = counts.where(counts.kind == pitman_yor.ASKED).collect()
    assert all(not (r.c or r.d or r.e) for r in asked) and sum(len(r.b) // 4 for r in asked) >= len(pairs)  # places, no hashes
    model, _ = pitman_yor.fit(counts, 3)
    assert model.totals[0] == pitman_yor.Totals(sum(pairs.values()), len(pairs), len({w for _, w in pairs})) and len(model.totals) == 1 + pitman_yor.SWEEPS
    once, twice = (sum(n == k for n in pairs.values()) for k in (1, 2))
    assert model.discount == pytest.approx(min(0.95, max(0.1, once / (once + 2 * twice))))


def test_language_model_contexts_are_whole_words(spark):
    # "bat" and "hat" end alike; what follows them does not
    rows = [(i, "bat red" if i % 2 else "hat blue") for i in range(80)] + [(100, "bat blue"), (101, "hat red")]
    got = {r.doc_id: r.score for r in pitman_yor.score_documents(frame(spark, rows).repartition(3)).collect()}
    assert got[1] > got[100] + 0.3 and got[0] > got[101] + 0.3
    chunk = pitman_yor.Chunk.of([" ".join(f"{i}at" for i in range(9000))], 3)
    assert len(np.unique(chunk.context)) == 9001  # as many contexts as words before


def test_seating_is_a_restaurant():
    rng = np.random.default_rng(1)
    c = np.array([0, 1, 5, 40, 4000])
    t = pitman_yor.seat(c, np.full(5, 2.0), 0.5, rng)
    assert t[0] == 0 and t[1] == 1 and (t <= c).all() and (t[2:] >= 1).all()
    draws = np.array([pitman_yor.seat(np.full(1, 3), np.full(1, 1.0), 0.0, np.random.default_rng(s))[0] for s in range(4000)])
    assert draws.mean() == pytest.approx(1 + 1 / 2 + 1 / 3, abs=0.05)  # weight 1: the k-th opens a table with 1/k


@pytest.mark.parametrize(("weight", "discount", "count"), [(100.0, 0.8, 1000), (3000.0, 0.8, 10000), (0.3, 0.5, 1000), (2.0, 0.0, 40)])
def test_seating_of_many_customers_equals_one_by_one(weight, discount, count):
    rng = np.random.default_rng(2)
    exact = np.ones(400)
    for k in range(1, count):
        exact += rng.random(400) * (weight + k - discount * exact) < weight
    got = pitman_yor.seat(np.full(400, count), np.full(400, weight), discount, rng)
    assert abs(got.mean() - exact.mean()) < 4 * math.sqrt((got.var() + exact.var()) / 400)
    assert 0.7 < (got.std() + 0.1) / (exact.std() + 0.1) < 1.4


def labelled_docs(spark):
    rng = np.random.default_rng(3)
    plain = [f"p{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = list(rng.choice(plain, 40))
        if bad:
            w = [x + "!!" for x in w] if i % 8 == 0 else w[:10] * 4
            w[::7] = ["vile"] * len(w[::7])
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(bad)))
    return frame(spark, [*rows, (900, None), (901, "")]), spark.createDataFrame([*labels, (0, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int"), rows


def test_quality(spark, empty):
    docs, labels, rows = labelled_docs(spark)
    from tidelag.llm.common import texts

    model = quality.fit(texts(docs), labels)
    got = {r.doc_id: r.score for r in quality.score(texts(docs), model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == 402 and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    assert np.mean([(got[i] >= 0.3) == (i % 4 != 0) for i in held]) > 0.9
    assert quality.score(texts(empty), model).count() == 0
    none = quality.fit(texts(docs), labels.where("false"))
    assert 0 <= quality.score(texts(docs), none).first().score <= 1


def test_quality_fits_all_features_of_long_texts(spark, monkeypatch):
    from tidelag.llm.common import texts
    from tidelag.llm.features import ngram_indicators

    long = [" ".join(f"{'g' if i % 2 else 'b'}{i}x{k}" for k in range(3000)) for i in range(12)]
    docs, labels = frame(spark, list(enumerate(long))), spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    fitted, real = [], quality.dual_coordinate_descent
    monkeypatch.setattr(quality, "dual_coordinate_descent", lambda rows, *more: fitted.extend(rows) or real(rows, *more))
    quality.fit(texts(docs), labels)
    sizes = np.bincount(ngram_indicators(long, quality.BITS)[0])
    assert fitted and min(sizes) > 4000 and {len(at) for at, _ in fitted} <= set(sizes.tolist())


def test_dual_coordinate_descent_separates():
    rows = [(np.array([k % 2]), np.array([1.0])) for k in range(20)]
    y = np.array([1.0 if k % 2 else -1.0 for k in range(20)])
    w = quality.dual_coordinate_descent(rows, y, 2, np.ones(20))
    assert all(np.sign(w[at] @ v + w[-1]) == y[i] for i, (at, v) in enumerate(rows))


def test_toxicity(spark, empty):
    docs, labels, rows = labelled_docs(spark)
    from tidelag.llm.common import texts

    model = toxicity.fit(texts(docs), labels)
    assert (np.diff(model.cuts) >= 0).all()
    got = {r.doc_id: r for r in toxicity.score(texts(docs), model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].toxic == int(i % 4 == 0) for i in held) and got[900].toxic == 0
    assert all(r.expected_severity >= r.p_toxic - 1e-12 for r in got.values())
    assert toxicity.score(texts(empty), toxicity.fit(texts(docs), labels.where("false"))).count() == 0
    assert not any(r.toxic for r in toxicity.score(texts(docs), toxicity.fit(texts(docs), labels.where("toxic = 0"))).collect())


def test_null_doc_ids_are_left_out(spark):
    rows = [(None, BASE), (1, BASE)]
    assert [r.doc_id for r in jaccard.components(frame(spark, rows)).collect()] == [1]
    assert pii.redact(frame(spark, rows)).count() == 2
    assert frame(spark, rows).where(F.col("doc_id").isNull()).count() == 1
