"""Exact removal of repeated 100-byte strings, corpus-wide, with suffix arrays where strings part.

Every window of 100 bytes has one anchor, the 24-byte gram of least hash in it, so equal
windows have equal anchors. Windows in a row with one anchor form a segment. Segments are
brought together by their anchor; of segments with equal bytes only the first can be new. Equal
bytes are told by a 128-bit BLAKE2b digest under a key drawn for each run, so that no text can be
made to look like another; the plain hashes of anchors only say who meets.
Where segments with one anchor differ, their common runs of windows are sorted in a suffix
array, and of equal windows all but the first are marked.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b, sha256
from secrets import token_bytes

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.llm.common import blocks, from_planes, large, mix64, planes, ragged, read_table, release_memory, small, staged, tasks_for, texts
from tidelag.llm.suffixes import suffix_array

WINDOW = 100
GRAM = 24
CHUNK_CHARS = 1_000_000
#: Segments that a task gathers before it sends them; characters of text behind a bucket of anchors and a part of compared segments.
UNIT_SEGMENTS = 400_000
BUCKET_CHARS = 24_000_000
PART_CHARS = 12_000_000
#: Bytes of runs that share one suffix array; runs of one anchor always do.
SORTED_BYTES = 20_000
_BASE = 0x2545F4914F6CDD1D
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, np.uint64(b))]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


class Hashes:
    """Hashes of any substrings of some bytes, from one running sum."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(documents: list[bytes]) -> tuple[np.ndarray, ...]:
    """(document index, first window, last window, anchor hash) of all segments in order."""
    sizes = np.array([len(d) for d in documents], np.int64)
    data = np.frombuffer(b"".join(documents), np.uint8)
    begins = np.cumsum(sizes) - sizes
    usable = np.maximum(0, sizes - WINDOW + 1)
    starts = ragged(begins, usable)
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    hashes = Hashes(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = hashes.of(at, at + GRAM)
    packed = (gram >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    anchor = (least_of(packed, WINDOW - GRAM + 1)[starts] & np.uint64((1 << 32) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[first[1:], len(starts)] - 1
    doc = np.searchsorted(begins, starts[first], side="right") - 1
    # documents without bytes begin where the next one does
    lo, hi = starts[first], starts[last]
    return doc, lo - begins[doc], hi - begins[doc], gram[anchor[first]]


def digests_of(documents: list[bytes], doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, key: bytes) -> np.ndarray:
    """Digests of the segments' bytes, as two numbers each."""
    found = b"".join(blake2b(documents[d][a:b], digest_size=16, key=key).digest() for d, a, b in zip(doc.tolist(), lo.tolist(), (hi + WINDOW).tolist(), strict=True))
    return np.frombuffer(found, np.uint64).reshape(-1, 2)


def units(batches: Iterator[pd.DataFrame], key: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc_id, ordinal, anchor, digest) of all segments of units of whole documents."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        for part in blocks(all_texts := batch.text.tolist(), CHUNK_CHARS):
            ids = batch.doc_id.iloc[part].to_numpy("<i8")
            raw = [t.encode("utf-8", "surrogatepass") for t in all_texts[part]]
            doc, lo, hi, gram = segments(raw)
            content = digests_of(raw, doc, lo, hi, key)
            count = np.bincount(doc, minlength=len(ids))
            ordinal = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)).astype("<u4")
            held.append((ids[doc], ordinal, gram, content))
            if sum(len(h[0]) for h in held) >= UNIT_SEGMENTS:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held = []
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


ROWS = "kind int, bucket int, gram binary, content binary, doc binary, counts binary, ordinal binary"
NAMES = [c.split()[0] for c in ROWS.split(", ")]
ASKED, MARKED = 0, 1


def marks_of(doc: np.ndarray, ordinal: np.ndarray, flag: np.ndarray, buckets: int) -> list[tuple]:
    """Rows of flags for the buckets of their documents."""
    side = np.abs(doc) % buckets
    order = np.argsort(side, kind="stable")
    cut = np.searchsorted(side[order], np.arange(buckets + 1))
    own = [(int(b), order[cut[b] : cut[b + 1]]) for b in np.flatnonzero(np.diff(cut))]
    return [(MARKED, b, flag[o].tobytes(), b"", planes(doc[o]), b"", planes(ordinal[o], "<u4")) for b, o in own]


def unit_rows(doc: np.ndarray, ordinal: np.ndarray, gram: np.ndarray, content: np.ndarray, buckets: int) -> pd.DataFrame:
    """Of equal segments of a unit the first, by buckets of anchors; the others are marked at once.

    A row names only documents that have a segment in its bucket, so rows grow in proportion to
    the segments, whatever the number of buckets; and of a segment that very many documents hold
    each unit sends one.
    """
    order = np.lexsort((ordinal, doc, content[:, 1], content[:, 0], gram))
    doc, ordinal, gram, content = doc[order], ordinal[order], gram[order], content[order]
    differ = lambda *x: np.r_[True, np.any([c[1:] != c[:-1] for c in x], axis=0)] if len(doc) else np.zeros(0, bool)
    new, place = differ(gram, *content.T), differ(gram, *content.T, doc, ordinal)
    again = place & ~new  # a repeated row names its places again; none is earlier than itself
    rows = marks_of(doc[again], ordinal[again], np.ones(int(again.sum()), np.uint8), buckets)
    doc, ordinal, gram, content = doc[new], ordinal[new], gram[new], content[new]
    bucket = ((gram >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((ordinal, doc, bucket))
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cut)).tolist():
        own = order[cut[b] : cut[b + 1]]
        ids, counts = np.unique(doc[own], return_counts=True)
        short = (gram[own] & np.uint64((1 << 40) - 1)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
        rows.append((ASKED, b, short, content[own].tobytes(), planes(ids), small(counts), planes(ordinal[own], "<u4")))
    return pd.DataFrame(rows, columns=NAMES)


def repeated_segments(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, ordinals binary (u4), flags binary (u1): 1 for segments whose bytes came before,
    2 for the first ones of their bytes whose anchor has other segments too."""
    key = token_bytes(16)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for unit in units(batches, key):
            yield unit_rows(*unit, buckets)
            release_memory()

    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        rows = [tuple(r[1:]) for r in batch[batch.kind == MARKED].itertuples()]
        batch = batch[batch.kind == ASKED]
        if not len(batch):
            return pd.DataFrame(rows, columns=NAMES)
        short = np.frombuffer(b"".join(batch.gram), np.uint8).reshape(-1, 5)
        gram = np.zeros((len(short), 8), np.uint8)
        gram[:, :5] = short
        gram = gram.view(np.uint64).ravel()
        content = np.frombuffer(b"".join(batch.content), np.uint64).reshape(-1, 2)
        ordinal = np.concatenate([from_planes(x, "<u4") for x in batch.ordinal])
        ids = [from_planes(x) for x in batch.doc]
        doc = np.concatenate([np.repeat(d, large(c, len(d))) for d, c in zip(ids, batch.counts, strict=True)])
        by_gram = np.argsort(gram, kind="stable")
        same = gram[by_gram][1:] == gram[by_gram][:-1]
        shared = np.r_[same, False] | np.r_[False, same]
        at = by_gram[shared]
        at = at[np.lexsort((ordinal[at], doc[at], content[at, 1], content[at, 0], gram[at]))]
        if len(at):
            at = at[np.r_[True, np.any([x[at][1:] != x[at][:-1] for x in (ordinal, doc, *content.T, gram)], axis=0)]]
        g, c = gram[at], content[at]
        new_gram = np.r_[True, g[1:] != g[:-1]] if len(at) else np.zeros(0, bool)
        new_content = new_gram | np.r_[True, (c[1:] != c[:-1]).any(axis=1)] if len(at) else new_gram
        group = np.cumsum(new_gram) - 1
        several = np.bincount(group, new_content)[group] > 1 if len(at) else new_gram
        flag = np.where(new_content, np.where(several, 2, 0), 1).astype(np.uint8)
        keep = flag > 0
        rows += marks_of(doc[at[keep]], ordinal[at[keep]], flag[keep], buckets)
        release_memory()
        return pd.DataFrame(rows, columns=NAMES)

    def gather(batch: pd.DataFrame) -> pd.DataFrame:
        doc = np.concatenate([from_planes(x) for x in batch.doc])
        ordinal, flag = np.concatenate([from_planes(x, "<u4") for x in batch.ordinal]), np.frombuffer(b"".join(batch.gram), np.uint8)
        order = np.lexsort((ordinal, doc))
        doc, ordinal, flag = doc[order], ordinal[order], flag[order]
        cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        ends = np.r_[cut[1:], len(doc)]
        return pd.DataFrame({"doc_id": doc[cut], "ordinals": [ordinal[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], "flags": [flag[i:j].tobytes() for i, j in zip(cut, ends, strict=True)]})

    found = docs.mapInPandas(send, ROWS).groupBy("bucket").applyInPandas(compare, ROWS)
    return found.groupBy("bucket").applyInPandas(gather, "doc_id long, ordinals binary, flags binary")


def intervals_and_segments(marked: DataFrame, parts: int) -> DataFrame:
    """Of documents with marks: what is repeated at once (part -1: pairs of byte places), and the
    segments (part by anchor: bytes with their place) that are to be compared."""
    schema = "part int, doc_id long, gram long, start long, data binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in blocks(all_texts := batch.text.tolist(), CHUNK_CHARS):
                raw = [t.encode("utf-8", "surrogatepass") for t in all_texts[block]]
                own = batch.iloc[block]
                doc, lo, hi, gram = segments(raw)
                at = np.searchsorted(doc, np.arange(len(raw)))
                rows = []
                for k, (doc_id, ordinals, flags) in enumerate(zip(own.doc_id, own.ordinals, own["flags"], strict=True)):
                    index = at[k] + np.frombuffer(ordinals, "<u4").astype(np.int64)
                    flag = np.frombuffer(flags, np.uint8)
                    again, first = index[flag == 1], index[flag == 2]
                    if len(again):
                        rows.append((-1, doc_id, 0, 0, np.stack([lo[again], hi[again] + WINDOW], axis=1).astype("<i8").tobytes()))
                    for i in first.tolist():
                        key = int(gram[i])
                        rows.append((key % parts, doc_id, key - (1 << 63), int(lo[i]), raw[k][lo[i] : hi[i] + WINDOW]))
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return marked.mapInPandas(run, schema)


def mark_equal_windows(runs: list[tuple[int, int, bytes]]) -> list[tuple[int, int]]:
    """(document, place) of the windows in ``runs`` (document, place, bytes) that are not the
    first of their bytes: neighbours in the suffix array with 100 equal bytes form a group."""
    text: list[int] = []
    where: list[tuple[int, int] | None] = []
    for doc, place, data in runs:
        text += [x + 2 for x in data]
        where += [(doc, place + k) if k + WINDOW <= len(data) else None for k in range(len(data))]
        text.append(1)
        where.append(None)
    text.append(0)
    where.append(None)
    order = suffix_array(text)
    flat = bytes(max(0, x - 2) for x in text)
    marked, group, before = [], [], None
    for i in order:
        if where[i] is None:
            continue
        own = flat[i : i + WINDOW]
        if own != before:
            marked += sorted(set(group))[1:]
            group, before = [], own
        group.append(where[i])
    return marked + sorted(set(group))[1:]


def compare_segments(rows: DataFrame) -> DataFrame:
    """doc_id, data: pairs of byte places repeated, for segments that share anchors."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        sizes = np.array([len(x) for x in batch.data], np.int64)
        data = np.frombuffer(b"".join(batch.data), np.uint8)
        begins = np.cumsum(sizes) - sizes
        windows = sizes - WINDOW + 1
        starts = ragged(begins, windows)
        owner = np.repeat(np.arange(len(sizes)), windows)
        content = Hashes(data).of(starts, starts + WINDOW)
        _, inverse, counts = np.unique(content, return_inverse=True, return_counts=True)
        kept = counts[inverse] > 1
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        index = np.flatnonzero(kept)
        if len(index):
            cut = np.flatnonzero(np.r_[True, (np.diff(starts[index]) != 1) | (np.diff(owner[index]) != 0)])
            ends = np.r_[cut[1:], len(index)]
            doc, gram, start = batch.doc_id.to_numpy(), batch.gram.to_numpy(), batch.start.to_numpy()
            whole = data.tobytes()
            seen: dict[tuple[int, bytes], list[tuple[int, int]]] = defaultdict(list)
            for i, j in zip(index[cut].tolist(), index[ends - 1].tolist(), strict=True):
                o = int(owner[i])
                seen[int(gram[o]), whole[starts[i] : starts[j] + WINDOW]].append((int(doc[o]), int(start[o] + starts[i] - begins[o])))
            by_gram: dict[int, list[tuple[int, int, bytes]]] = defaultdict(list)
            for (g, bytes_), places in seen.items():
                places = sorted(set(places))
                by_gram[g].append((*places[0], bytes_))
                for d, p in places[1:]:
                    found[d].append((p, p + len(bytes_)))
            batch_runs: list[tuple[int, int, bytes]] = []
            pending = 0
            for k, runs in enumerate(groups := [x for x in by_gram.values() if len(x) > 1]):
                batch_runs += runs
                pending += sum(len(x[2]) for x in runs)
                if pending >= SORTED_BYTES or k == len(groups) - 1:
                    for d, p in mark_equal_windows(batch_runs):
                        found[d].append((p, p + WINDOW))
                    batch_runs, pending = [], 0
        return pd.DataFrame({"doc_id": list(found), "data": [np.array(x, "<i8").tobytes() for x in found.values()]})

    return rows.groupBy("part").applyInPandas(run, "doc_id long, data binary")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept binary for every document.

    Null and empty texts and texts under 100 bytes lose nothing; of equal texts the one with
    the smallest doc_id stays; rows with one doc_id lose the same places, and none to each
    other where their texts are equal; an empty table gives no rows; columns other than doc_id and text are not read.
    """
    docs = texts(docs)
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    tasks = tasks_for(docs.sparkSession)
    parts = max(tasks * 4, -(-total // PART_CHARS))
    marks = staged(repeated_segments(docs, max(tasks, -(-total // BUCKET_CHARS))), "substring-marks")
    rows = staged(intervals_and_segments(docs.join(marks, "doc_id"), parts), "substring-rows")
    compared = compare_segments(rows.where("part >= 0"))
    removed = rows.where("part < 0").select("doc_id", "data").union(compared).groupBy("doc_id").agg(F.collect_list("data").alias("cuts"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, cuts in zip(batch.doc_id, batch.text, batch.cuts, strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if cuts is None or not len(cuts):
                    out.append((doc_id, len(raw), 0, 0, raw))
                    continue
                pairs = np.frombuffer(b"".join(cuts), "<i8").reshape(-1, 2)
                pairs = pairs[pairs[:, 1] <= len(raw)]
                change = np.bincount(pairs[:, 0], minlength=len(raw) + 1) - np.bincount(pairs[:, 1], minlength=len(raw) + 1)
                gone = np.cumsum(change)[: len(raw)] > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(raw) else 0
                out.append((doc_id, len(raw), int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return docs.join(removed, "doc_id", "left").mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(kept: DataFrame) -> DataFrame:
    """The rows of ``remove_repeats`` with the SHA-256 of what is kept; of an empty table none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="kept").assign(kept_sha256=[sha256(x).hexdigest() for x in batch.kept])

    return kept.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op4_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(remove_repeats(read_table(spark, sf_dir, "documents")))
