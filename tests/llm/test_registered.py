"""The registered queries over the smallest tables, and every stage of the pipeline on odd rows, against plain Python."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from test_operators import KINDS, TEXTS, brute_components, brute_leaks, brute_redacted, counts, frame, words
from tokenizers import Tokenizer

import corpus_pipeline
from tidelag.llm import bpe, features, jaccard, media, mpeg, pii, quality, queries, separators, toxicity
from tidelag.llm.common import staged, texts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def run(spark, name):
    return {r.doc_id: r for r in queries.queries()[name](spark, SF).collect()}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op1_base_spans(spark, table):
    got = run(spark, "op1_pii_bootstrap")
    assert len(got) == len(table)
    for i, text in table:
        spans = [(kind, m.start(), m.end()) for kind, pattern in KINDS for m in re.finditer(pattern, text) if counts(kind, m[0])]
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert (got[i].base_sha256, [got[i][f"n_{k}"] for k, _ in KINDS]) == (sha(base.encode()), [sum(k == x[0] for x in spans) for k, _ in KINDS])
        assert got[i].spans == base or got[i].spans.startswith(base + "," * bool(base)) and set(re.findall("[a-z]+", got[i].spans[len(base) :])) == {"id"}


def naive_quality(model, text):
    """Score of one text, feature by feature."""
    tokens, mask, k, full = features.TOKENS.findall(text), (1 << quality.BITS) - 1, 0x9E3779B97F4A7C15, (1 << 64) - 1
    mixed = lambda x: int(features.mix64(np.array([x & full], np.uint64))[0]) & mask
    word = [xxhash.xxh64_intdigest(t.lower().encode()) for t in tokens]
    shape = [(xxhash.xxh64_intdigest(features.shape_of(t).encode()) + 0x51) & full for t in tokens]
    found = {mixed(w) for w in word} | {mixed(a * k + b) for a, b in zip(word, word[1:])} | {mixed(a * k + b) for a, b in zip(shape, shape[1:])}
    found |= {mixed(((a * k + b) & full) * k + c) for a, b, c in zip(shape, shape[1:], shape[2:])}
    margin = sum(model.weights[f] for f in found) / math.sqrt(max(1, len(found))) + model.bias
    return 1 / (1 + math.exp(-max(-50, min(50, model.slope * margin + model.offset))))


def test_op2_scores(spark, table):
    got = run(spark, "op2_quality_nbsvm")
    model = quality.fit(texts(spark.read.parquet(f"{SF}/documents.parquet")), spark.read.parquet(f"{SF}/labels.parquet"))
    for i, text in table:
        score = naive_quality(model, text)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].score == pytest.approx(score, abs=1e-9) and got[i].predicted == int(got[i].score >= 0.3)


def test_op2_counts_and_fit(spark):
    rows = [(i, f"good {i % 7} fine text" if i % 2 else f"bad!! {i % 5} JUNK") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    chosen = features.labelled(texts(frame(spark, rows)), labels, "quality", 1000)
    negative, positive = features.class_counts(chosen.select("doc_id", "text", "label"), 10)
    wanted = np.zeros((2, 1 << 10), np.int64)
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 5:
            for f in set(features.ngram_indicators([text], 10)[1].tolist()):
                wanted[i % 2, f] += 1
    assert (negative == wanted[0]).all() and (positive == wanted[1]).all()
    rng = np.random.default_rng(0)
    sparse = [(np.sort(rng.choice(30, 5, replace=False)), rng.normal(size=5)) for _ in range(60)]
    y, cost = np.where(rng.random(60) < 0.5, 1.0, -1.0), np.full(60, 1.0)
    w = quality.dual_coordinate_descent(sparse, y, 30, cost, epochs=2000)
    loss = lambda w: 0.5 * w @ w + sum(max(0.0, 1 - s * (w[at] @ v + w[-1])) for (at, v), s in zip(sparse, y, strict=True))
    best = loss(w)
    assert all(loss(w + step) >= best - 1e-4 for step in rng.normal(scale=0.02, size=(300, 31)))


def test_op3_counts(spark, table):
    coder = separators.tokenizer(str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    got = run(spark, "op3_token_counts")
    assert {i: got[i].n_tokens for i, _ in table} == {i: len(coder.encode_ordinary(t)) for i, t in table}


def naive_severity(model, text):
    held = {int(h) for h in model.words}
    found = {h for h in (xxhash.xxh64_intdigest(w.encode()) for w in features.LETTERS.findall(text.lower())) if h in held}
    x = sum(model.weights[int(np.searchsorted(model.words, np.uint64(h)))] for h in found)
    return [1 / (1 + math.exp(-max(-50, min(50, x - c)))) for c in model.cuts]


def test_op5_scores(spark, table):
    got = run(spark, "op5_toxicity_ordinal")
    model = toxicity.fit(texts(spark.read.parquet(f"{SF}/documents.parquet")), spark.read.parquet(f"{SF}/labels.parquet"))
    for i, text in table:
        reach = naive_severity(model, text)
        r = got[i]
        assert (r.expected_severity, r.p_toxic) == (pytest.approx(sum(reach), abs=1e-9), pytest.approx(reach[0], abs=1e-9))
        assert (r.grade, r.toxic) == (sum(p >= 0.5 for p in reach), int(reach[0] >= 0.5))


def test_op5_fit_is_a_minimum():
    rng = np.random.default_rng(1)
    pairs = np.unique(np.stack([rng.integers(0, 80, 240), rng.integers(0, 12, 240)], axis=1), axis=0)
    doc, at, grade = pairs[:, 0], pairs[:, 1], rng.integers(0, 4, 80)
    w, b = toxicity.fit_cumulative_link(doc, at, grade, 12, rounds=3000)

    def loss(w, b):
        total = 0.01 * sum(x * x for x in w)
        for i in range(80):
            x = sum(w[k] for d, k in pairs if d == i)
            for k in range(3):
                total += math.log1p(math.exp(-(x - b[k]) if grade[i] > k else x - b[k]))
        return total

    best = loss(w, b)
    assert (np.diff(b) >= 0).all() and all(loss(w + s[:12], np.sort(b + s[12:])) >= best - 5e-3 for s in rng.normal(scale=0.03, size=(60, 15)))


def test_op7_columns(spark, table):
    got = run(spark, "op7_pitman_yor")
    train = Counter(w for i, t in table if zlib.crc32(str(i).encode()) % 5 != 1 for w in [*words(t), None])
    n, v = sum(train.values()), len(train)
    for i, t in table:
        tokens, r = [*words(t), None], got[i]
        base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(tokens), sum(train[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    held = [i for i, _ in table if got[i].held_out]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_op8_leaks(spark, table):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = queries.queries()["op8_benchmark_leaks"](spark, SF).collect()
    assert sorted((r.doc_id, r.item_id, *(round(r[c], 6) for c in ("score", "question_overlap", "answer_overlap"))) for r in rows) == brute_leaks(table, items)


def library():
    coder = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    coder.no_truncation()
    coder.no_padding()
    return coder


def test_op9_equals_the_library(spark, table):
    coder, got = library(), run(spark, "op9_bpe_codec")
    for i, text in table:
        ids = coder.encode(text, add_special_tokens=False).ids
        decoded = coder.decode(ids, skip_special_tokens=False)
        assert tuple(got[i])[1:] == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(decoded.encode()))


def test_op10_columns(spark, table):
    got = run(spark, "op10_media_columns")
    for i, text in table:
        payload = media.pad(text.encode())
        stream = mpeg.write_stream(payload)
        found = mpeg.read_stream(stream)
        share = [c / len(payload) for c in Counter(payload).values()]
        seek = zlib.crc32(b"".join(struct.pack("<q", o) for o in found.offsets))
        feature = f"frames={len(found.offsets)};seconds={len(found.offsets) * 1152 / 32000:.3f};seek={seek:08x};entropy={-sum(p * math.log2(p) for p in share) + 0.0:.4f}"
        assert tuple(got[i])[1:] == (len(text.encode()), len(payload), sha(payload), zlib.crc32(payload[-64:]), len(stream), sha(stream), feature.replace("-0.0000", "0.0000"))


def test_op10_stored_columns(spark):
    rows = media.media_columns(frame(spark)).collect()
    assert len(rows) == len(TEXTS) and all(bytes(r.payload) == mpeg.read_stream(bytes(r.media)).payload for r in rows)
    assert all(r.bad_crc == r.skipped_bytes == 0 and len(r.seek_offsets) == r.frames for r in rows)


def test_op9_odd_rows(spark):
    from tidelag.llm import bpe

    coder = library()
    got = bpe.encoding_digest(frame(spark)).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((i, len(coder.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS)
    assert bpe.encoding_digest(frame(spark, [])).count() == 0


ODD = [*TEXTS, (20, TEXTS[6][1]), (None, TEXTS[0][1]), (None, None), (21, "mail me at some.one@mail.org or +1 555 123 4567 now"), (21, "mail me at some.one@mail.org or +1 555 123 4567 now")]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def kept(spark, name, rows):
    before = frame(spark, rows)
    after = stage(name)(spark, before, SF)
    assert after.columns == before.columns and stage(name)(spark, before.where("false"), SF).count() == 0
    return sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in after.collect())


def plain(rows):
    return sorted((i is not None, i or 0, t or "") for i, t in rows)


def test_stage_toxicity(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = [*ODD, *((1000 + r.doc_id, r.text) for r in docs.limit(120).collect())]
    rows += [(r.doc_id, r.text) for r in docs.join(labels, "doc_id").collect()]
    model = toxicity.fit(texts(frame(spark, rows)), labels)
    assert kept(spark, "toxicity", rows) == plain((i, t) for i, t in rows if naive_severity(model, t or "")[0] < toxicity.THRESHOLD)


def test_stage_near_duplicates(spark):
    named = [(i, t) for i, t in ODD if i is not None]
    component = brute_components(named)
    assert kept(spark, "near_duplicates", ODD) == plain((i, t) for i, t in ODD if i is None or component[i][1] == i)


def test_stage_decontamination(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [*ODD, (30, "before it " + items[0][1] + " after it"), (31, items[1][1]), (31, "else"), (None, items[2][1])]
    gone = {x[0] for x in brute_leaks([r for r in rows if r[0] is not None], items)}
    assert {30, 31} <= gone and kept(spark, "decontamination", rows) == plain((i, t) for i, t in rows if i not in gone)


def test_stage_personal_data(spark):
    found = {(r.doc_id, r.kept): [(x.start, x.end, k) for k in (*pii.KINDS, "further") for x in r[k]] for r in pii.find(frame(spark, ODD), F.col("text")).collect()}
    assert kept(spark, "personal_data", ODD) == plain((i, brute_redacted(t or "", found[i, t])) for i, t in ODD)


def test_stage_encoding(spark):
    coder = library()
    got = stage("encoding")(spark, frame(spark, ODD), SF).collect()
    wanted = []
    for i, t in ODD:
        ids = coder.encode(t or "", add_special_tokens=False).ids
        wanted.append((str(i), ids, len(ids), sha(coder.decode(ids, skip_special_tokens=False).encode())))
    assert sorted((str(r.doc_id), list(r.ids), r.n_tokens, r.text_sha256) for r in got) == sorted(wanted)
    assert stage("encoding")(spark, frame(spark, []), SF).count() == 0


def test_stage_encoding_bounds_what_a_worker_gets(spark, monkeypatch):
    written = []

    def spy(df, name, **how):
        written.append((name, how, df._jdf.queryExecution().toString()))
        return staged(df, name, **how)

    monkeypatch.setattr(corpus_pipeline, "staged", spy)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = stage("encoding")(spark, frame(spark, ODD), SF)._jdf.queryExecution().toString()
    assert "InPandas" not in plan and "sha2(" not in plan  # whoever writes the rows runs no Python under other settings
    (_, how, own), = written
    assert how["batch_rows"] <= 1000 and "InPandas" in own and "sha2(" not in own  # decoded texts do not travel back
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_encoding_of_many_symbols_in_parts(monkeypatch):
    known = bpe.load(bpe.default_vocabulary())
    words = ["".join(chr(97 + (i * k) % 26) for k in range(1, 12)) + "aaaa" for i in range(60)]
    whole = [x.tolist() for x in known.encode(words)]
    monkeypatch.setattr(bpe, "NOTED", 7)
    assert [x.tolist() for x in known.encode(words)] == whole and whole[3] == library().encode(words[3], add_special_tokens=False).ids


def test_link_bounds_of_equal_sets():
    assert jaccard.linked(4, 4, 4) and not jaccard.linked(4, 4, 3) and jaccard.linked(7, 7, 6)
