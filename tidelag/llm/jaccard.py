"""Exact Jaccard join of documents on word shingles, and its components.

1. Every shingle is counted: tasks send the distinct hashes of a unit of documents to ranges of
   hashes, and what occurs more than once comes back. Only that can be shared, so overlaps need
   no more. A unit sends a shingle once, however many of its documents hold it, and a row holds
   nothing for documents without a shingle in its range, so rows grow in proportion to the text.
2. A document's rarest shingles form its prefix; two documents that reach the threshold share
   one of them. Documents with too many shingles of their own have no partner.
3. A tile holds the documents of neighbouring size bands that share a prefix shingle; of tiles
   with the same members one is kept. In each round, of a few, every document is compared with one pivot,
   drawn anew, outside its component; the tiles that still hold several components after that
   are compared in tasks that join what links at once and send links that span it, never pairs.
4. Pairs are bounded by the bit counts of hashed bitmap signatures, whose length grows with the
   document, before the sorted arrays are intersected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import count
from secrets import token_bytes

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.llm.common import blocks, connected_components, drawn, from_planes, hashed_words, mix64, read_table, release_memory, spent, staged, staged_and_seen, tasks_for, texts
from tidelag.llm.common import planes as byte_planes

WIDTH = 5
PERCENT = 75
BLOCK_CHARS = 500_000
#: Rows of texts, bitmaps or shingles that a task gets at once.
BATCH_ROWS = 1000
#: Shingles that a task gathers before it sends them, and characters of text behind a range of hashes.
UNIT_SHINGLES = 1_500_000
BUCKET_CHARS = 24_000_000
#: The least bits of a signature.
SIGNATURE_BITS = 1024
#: Documents of a tile, and shingles behind their bitmaps, that are compared in one task; larger tiles are dealt as pairs of blocks.
TILE_BLOCK = 8000
TILE_SHINGLES = 4_000_000
#: Pairs with pivots, of all, for each part that the partners of one pivot are dealt to.
STAR = 4096
#: After the first, rounds of pivots go on, up to ``TURNS``, while there are more open pairs than this for each open row, and a
#: fifth of their pairs links; what is open then is compared in tiles, whole.
PAIRS_EACH, TURNS = 2, 3


def shingle_sets(all_texts: list[str], seed: bytes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(distinct 64-bit hashes of shingles, sorted in each text, one text after another; their numbers)."""
    words, lengths = hashed_words(all_texts, seed)
    factor = drawn(seed)[1]
    n = np.where(lengths, np.maximum(1, lengths - width + 1), 0)
    first = np.cumsum(lengths) - lengths
    combined = np.zeros(max(0, len(words) - width + 1), np.uint64) + np.uint64(width)
    for k in range(width if len(combined) else 0):
        combined = combined * factor + words[k : k + len(combined)]
    hashes = np.zeros(int(n.sum()), np.uint64)
    at = np.cumsum(n) - n
    whole = np.repeat(lengths >= width, n)
    starts = np.repeat(first - at, n) + np.arange(len(hashes))
    hashes[whole] = combined[starts[whole]]
    for i in np.flatnonzero((lengths > 0) & (lengths < width)).tolist():
        short = np.full(1, lengths[i], np.uint64)  # an array, which wraps around
        for w in words[first[i] : first[i] + lengths[i]]:
            short = short * factor + w
        hashes[at[i]] = short[0]
    hashes = mix64(hashes)
    for i, j in zip(at.tolist(), (at + n).tolist(), strict=True):
        hashes[i:j].sort()
    owner = np.repeat(np.arange(len(n)), n)
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], np.bincount(owner[fresh], minlength=len(n))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """A partner shares at least ceil(percent / 100 * n) shingles, so one of so many."""
    return n - -(-percent * n // 100) + 1


def signature(keys: np.ndarray) -> np.ndarray:
    """A bitmap in which each key flips one bit; unequal bits never outnumber unequal keys.

    It has at least two bits for each key, a power of two, so that long documents are told apart too.
    """
    bits = max(SIGNATURE_BITS, 1 << (2 * len(keys) - 1).bit_length())
    flips = np.bincount((mix64(keys) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.uint64)


def alike(signatures: list[bytes]) -> np.ndarray:
    """Signatures, one in a row, folded to the shortest of them: the bits that a shorter one would hold."""
    shortest = min(map(len, signatures)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, shortest), axis=0) for s in signatures])


def may_link(n1, n2, own1, own2, sig1, sig2, percent: int = PERCENT):
    """Whether the overlap can be large enough: of ``own`` keys that others have too, so many differ at least."""
    differ = np.bitwise_count(sig1 ^ sig2).sum(axis=-1).astype(np.int64)
    most = np.minimum((own1 + own2 - differ) // 2, np.minimum(own1, own2))
    return 100 * most >= percent * (n1 + n2 - most)


def linked(n1, n2, overlap, percent: int = PERCENT):
    return 100 * overlap >= percent * (n1 + n2 - overlap)


def overlaps(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted array with each of several."""
    sizes = np.array([len(x) for x in others], np.int64)
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    return np.bincount(np.repeat(np.arange(len(others)), sizes), own[at] == flat, len(others)).astype(np.int64)


ROWS = "kind int, bucket int, unit long, slots binary, more binary, low binary, high binary, counts binary"
NAMES = [c.split()[0] for c in ROWS.split(", ")]
LISTED, KEYS = 1, 0


def planes(slots: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending numbers as differences: their low bytes, and the rest, which is mostly zero."""
    steps = np.diff(slots, prepend=0)
    return (steps & 255).astype(np.uint8).tobytes(), (steps >> 8).astype("<u4").tobytes()


def slots_of(low: bytes, more: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(low, np.uint8).astype(np.int64) | np.frombuffer(more, "<u4").astype(np.int64) << 8)


def key_columns(keys: np.ndarray) -> tuple[bytes, bytes]:
    return keys.astype(np.uint32).tobytes(), (keys >> np.uint64(32)).astype(np.uint8).tobytes()


def keys_of(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(high, np.uint8).astype(np.uint64) << np.uint64(32) | np.frombuffer(low, "<u4")


def packed_keys(found: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte, of which the upper bytes are mostly zero."""
    return byte_planes(np.diff(found, prepend=np.uint64(0)), "<u8")


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, "<u8"), dtype=np.uint64)


def units(batches: Iterator[pd.DataFrame], seed: bytes, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, shingles one document after another, their numbers) of units of whole documents."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        for part in blocks(all_texts := batch.text.tolist(), BLOCK_CHARS):
            held.append((batch.doc_id.iloc[part].to_numpy("<i8"), *shingle_sets(all_texts[part], seed, width)))
            if sum(len(h[1]) for h in held) >= UNIT_SHINGLES:
                unit, held = tuple(np.concatenate(x) for x in zip(*held, strict=True)), []
                yield unit
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def starts_of_runs(ordered: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    fresh = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
    return fresh


def sums_of_equal(keys: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each key the weight of all keys that equal it; some 30 bytes a key are held at once."""
    order = np.argsort(keys)
    begin = np.flatnonzero(starts_of_runs(keys[order]))
    sums = np.add.reduceat(weight[order], begin, dtype=np.uint32)
    out = np.empty(len(keys), "<u4")
    out[order] = np.repeat(sums, np.diff(begin, append=len(keys)))
    return out


def unit_rows(unit: int, ids: np.ndarray, flat: np.ndarray, sizes: np.ndarray, buckets: int) -> pd.DataFrame:
    """A unit's list of documents, and its distinct shingles by bucket.

    A shingle has the place of its document, or, if several documents hold it, a place behind
    all documents and their number; which documents they are stays with the list.
    """
    ends = np.cumsum(sizes)
    digests = [blake2b(flat[i:j].tobytes(), digest_size=16).digest() for i, j in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
    first: dict[bytes, int] = {}
    for i in np.argsort(ids, kind="stable").tolist():  # of equal sets the smallest doc_id stands for all
        first.setdefault(digests[i], i)
    stands = np.array([first[d] for d in digests], np.int64)
    sends = stands == np.arange(len(ids))
    flat = flat[np.repeat(sends, sizes)]
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), np.where(sends, sizes, 0))
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    del order
    begin = np.flatnonzero(starts_of_runs(flat))
    counts = np.diff(begin, append=len(flat)).astype(np.int32)
    keys, slot = flat[begin], owner[begin]
    several = np.flatnonzero(counts > 1)
    slot[several] = len(ids) + np.arange(len(several))
    members = owner[np.repeat(counts > 1, counts)]
    del flat, owner, begin
    table = np.stack([ids, ids[stands], sizes]).astype("<i8")
    rows = [(LISTED, unit % buckets, unit, table.tobytes(), b"".join(digests), members.astype("<u4").tobytes(), b"", counts[several].astype("<u4").tobytes())]
    bucket = ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
    by_bucket = np.lexsort((slot, bucket))
    cut = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cut)).tolist():
        own = by_bucket[cut[b] : cut[b + 1]]
        repeated = counts[own][slot[own] >= len(ids)]
        rows.append((KEYS, b, unit, *planes(slot[own]), *key_columns(keys[own]), repeated.astype("<u4").tobytes()))
    return pd.DataFrame(rows, columns=NAMES)


def shared_keys(batch: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket's shingles those that occur more than once, with their counts; lists pass through."""
    out = [tuple(r[1:]) for r in batch[batch.kind == LISTED].itertuples()]
    batch = batch[batch.kind == KEYS]
    if len(batch):
        keys = keys_of(b"".join(batch.low), b"".join(batch.high))
        weight = np.ones(len(keys), np.uint32)
        at = 0
        for r in batch.itertuples():
            at += len(r.high)
            repeated = np.frombuffer(r.counts, "<u4")
            weight[at - len(repeated) : at] = repeated
        df = sums_of_equal(keys, weight)
        at = 0
        for r in batch.itertuples():
            own = slice(at, at := at + len(r.high))
            keep = df[own] > 1
            if keep.any():
                out.append((KEYS, r.bucket, r.unit, *planes(slots_of(r.slots, r.more)[keep]), *key_columns(keys[own][keep]), df[own][keep].tobytes()))
    release_memory()
    return pd.DataFrame(out, columns=NAMES)


SETS = "doc_id long, n long, set_a long, set_b long, stands long, own long, prefix array<long>, shared binary, sig binary"


def unit_sets(batch: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The rows of a unit's documents, from its list and its shared shingles."""
    listed = batch[batch.kind == LISTED].iloc[0]
    ids, stands, sizes = np.frombuffer(listed.slots, "<i8").reshape(3, -1)
    digest = np.frombuffer(listed.more, "<i8").reshape(-1, 2)
    members, group = np.frombuffer(listed.low, "<u4").astype(np.int64), np.frombuffer(listed.counts, "<u4").astype(np.int64)
    parts = batch[batch.kind == KEYS]
    none = [np.zeros(0, np.int64)]
    slot = np.concatenate([slots_of(r.slots, r.more) for r in parts.itertuples()] or none)
    keys = keys_of(b"".join(parts.low), b"".join(parts.high)) | np.repeat(parts.bucket.to_numpy(np.uint64), [len(h) for h in parts.high]) << np.uint64(40)
    df = np.frombuffer(b"".join(parts.counts), "<u4")
    several = np.flatnonzero(slot >= len(ids))
    which = slot[several] - len(ids)
    begin = np.cumsum(group) - group
    run = group[which]
    ends = np.cumsum(run)
    inside = np.arange(int(run.sum())) - np.repeat(ends - run, run) + np.repeat(begin[which], run)
    alone = slot < len(ids)
    owner = np.concatenate([slot[alone], members[inside]])
    keys, df = np.concatenate([keys[alone], np.repeat(keys[several], run)]), np.concatenate([df[alone], np.repeat(df[several], run)])
    order = np.lexsort((keys, df, owner))
    cut = np.searchsorted(owner[order], np.arange(len(ids) + 1))
    rows = []
    for i, n in enumerate(sizes.tolist()):
        own = order[cut[i] : cut[i + 1]]
        left = prefix_length(n, percent) - (n - len(own)) if n else 0
        head = (ids[i], n, digest[i, 0], digest[i, 1], stands[i], len(own))
        if left > 0 and len(own):
            found = np.sort(keys[own])
            rows.append((*head, keys[own[:left]].view(np.int64), packed_keys(found), signature(found).tobytes()))
        else:
            rows.append((*head, None, None, None))
    release_memory()
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SETS.split(", ")])


def shared_shingles(docs: DataFrame, width: int = WIDTH, buckets: int | None = None, seed: bytes | None = None) -> DataFrame:
    """Rows of the units: their lists, and their shingles that occur more than once, with counts. They are
    written, so that the shuffle of all shingles is deleted before what is shared travels back."""
    if buckets is None:
        total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        buckets = max(tasks_for(docs.sparkSession), -(-total // BUCKET_CHARS))

    seed = seed or token_bytes(16)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit = TaskContext.get().partitionId() << 24
        for ids, flat, sizes in units(batches, seed, width):
            yield unit_rows(unit, ids, flat, sizes, buckets)
            unit += 1
            release_memory()

    return staged(docs.mapInPandas(send, ROWS).groupBy("bucket").applyInPandas(shared_keys, ROWS), "jaccard-shared", batch_rows=BATCH_ROWS)


def sets_of(counted: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, set_a, set_b (a digest of the set), stands (the smallest doc_id with this set in
    the unit), and for documents that may have a partner: prefix, shared (sorted keys that occur
    more than once), sig. A key is the number of its range of hashes above 40 bits of its hash.
    """
    return counted.groupBy("unit").applyInPandas(lambda batch: unit_sets(batch, percent), SETS)


def profile(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, buckets: int | None = None, seed: bytes | None = None) -> DataFrame:
    return sets_of(shared_shingles(docs, width, buckets, seed), percent)


def tiles(candidates: DataFrame) -> DataFrame:
    """tile, doc_id, guest, own: a document is at home in its size band and a guest in the next one.

    Of tiles with the same members one is kept: near copies share most of their prefixes.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / PERCENT)))
    placed = candidates.select("doc_id", "own", F.explode("prefix").alias("key"), band.alias("band"))
    both = placed.select("doc_id", "own", "key", F.explode(F.array(F.struct(F.col("band").alias("band"), F.lit(False).alias("guest")), F.struct((F.col("band") + 1).alias("band"), F.lit(True).alias("guest")))).alias("t"))
    members = both.select(F.xxhash64("key", "t.band").alias("tile"), "doc_id", "t.guest", "own")
    sums = members.groupBy("tile").agg(
        F.count("*").alias("size"), F.bool_or(~F.col("guest")).alias("home"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"),
        F.bit_xor(F.xxhash64("doc_id", "guest", "own")).alias("x"), F.bit_xor(F.xxhash64("own", "guest", "doc_id")).alias("y"),
    ).where("size > 1 and home")
    kept = sums.groupBy("size", "lo", "hi", "x", "y").agg(F.min("tile").alias("tile")).select("tile")
    return members.join(kept, "tile")


def compared(dealt: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join all that links among the rows of each task.

    First the bit counts tell which documents may link; what they join is a group, named by its
    members, so that a group which many tasks hold is compared once. Only documents of groups
    bring their shingles, of which their bit counts are made again, and those that have been
    linked are not compared again.
    """
    in_tasks = lambda rows: rows.repartition("task").sortWithinPartitions("task", "doc_id")
    bounded = in_tasks(dealt.join(candidates.select("doc_id", "n", "own", "sig"), "doc_id"))
    groups = bounded.mapInPandas(_by_task(lambda rows: _near(rows, percent), "task", "doc_id", "component", "pivot"), "task long, doc_id long, component long, pivot boolean")
    near = staged(groups.distinct(), "jaccard-near", batch_rows=BATCH_ROWS)
    return in_tasks(near.join(candidates.select("doc_id", "n", "own", "shared"), "doc_id")).mapInPandas(_by_task(lambda rows: _join(rows, percent), "a", "b"), "a long, b long")


def verify(pairs: DataFrame, asked: int, candidates: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) of the ``asked`` pairs that link. A task is a pivot ``a`` and some of its partners, so that a
    pivot which very many pairs name brings its row once for each task, and only pairs with it
    are compared. A pivot's partners lie in as many tasks as ``STAR`` of all pairs fill, or fewer."""
    parts = -(-asked // STAR)
    task = F.xxhash64("a", F.pmod(F.xxhash64("b"), F.lit(max(1, parts)))).alias("task")
    stars = pairs.groupBy("a", task).agg(F.collect_list("b").alias("bs"))
    end = lambda doc_id, pivot: F.struct(doc_id.alias("doc_id"), F.lit(pivot).alias("pivot"))
    ends = stars.select("task", F.inline(F.concat(F.array(end(F.col("a"), True)), F.transform("bs", lambda x: end(x, False)))))
    return compared(ends.select("*", F.lit(False).alias("guest"), F.col("doc_id").alias("component"), F.col("pivot").cast("int").alias("block"), F.lit(False).alias("inner")), candidates, percent)


def open_members(members: DataFrame, components: DataFrame | None, turn: int) -> DataFrame:
    """Members, with component, of the tiles that hold more than one component, and the tile's
    size, shingles, pivot (drawn anew each turn) and number of pairs between components."""
    if components is None:
        known = members.withColumn("component", F.col("doc_id"))
    else:
        known = members.join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    drawn = F.struct(F.xxhash64("doc_id", F.lit(turn)).alias("draw"), "doc_id", "component")
    by_component = known.groupBy("tile", "component").agg(F.count("*").alias("c"), F.sum("own").alias("own"), F.min(drawn).alias("p"))
    info = by_component.groupBy("tile").agg(
        F.count("*").alias("components"), F.sum("c").alias("size"), F.sum("own").alias("shingles"), F.min("p").alias("p"),
        F.sum(F.col("c").cast("double") * F.col("c")).alias("squares"),
    ).where("components > 1")
    pairs = (F.col("size").cast("double") * F.col("size") - F.col("squares")) / 2
    return known.join(info.select("tile", "size", "shingles", F.col("p.doc_id").alias("pivot"), F.col("p.component").alias("pivot_component"), pairs.alias("pairs")), "tile")


def star_pairs(members: DataFrame) -> DataFrame:
    """One pair for each document: with the pivot of one of its tiles that is outside its component."""
    return members.where("component <> pivot_component").groupBy(F.col("doc_id").alias("b")).agg(F.min_by("pivot", F.xxhash64("tile")).alias("a")).where("a <> b")


def tile_links(members: DataFrame, candidates: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links that join all that links in each tile, at most one for each member of a task.

    A tile of many documents or shingles is dealt to tasks as pairs of blocks, which are held one
    at a time.
    """
    blocks_ = F.greatest(F.ceil(F.col("size") / TILE_BLOCK), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks_).cast("int")
    dealt = members.select("tile", "doc_id", "guest", "component", own.alias("block"), F.explode(F.sequence(F.lit(0), blocks_ - 1)).alias("other"))
    dealt = dealt.select("doc_id", "guest", "component", "block", F.lit(False).alias("pivot"), F.xxhash64("tile", F.least("block", "other"), F.greatest("block", "other")).alias("task"), (F.col("block") == F.col("other")).alias("inner"))
    return compared(dealt, candidates, percent)


def _by_task(compare: Callable[[list], Iterator[tuple]], *columns: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Apply ``compare`` to the rows of one task at a time; they come one after another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for batch in batches:
            found = []
            for r in batch.itertuples(index=False):
                if held and held[0].task != r.task:
                    found += compare(held)
                    held = []
                held.append(r)
            if found:
                yield pd.DataFrame(found, columns=list(columns))
        if held and (found := list(compare(held))):
            yield pd.DataFrame(found, columns=list(columns))
        release_memory()

    return run


def _candidates(rows: list, signatures: list[bytes], label: np.ndarray, percent: int, meets: Callable[[int, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(place, later places whose bit counts allow a link); ``label`` tells components apart and may change on the way."""
    n, k = (np.array([getattr(r, c) for r in rows], np.int64) for c in ("n", "own"))
    sig = alike(signatures)
    for i in range(len(rows) - 1):
        j = np.arange(i + 1, len(rows))
        j = j[label[j] != label[i]]
        if meets is not None:
            j = j[meets(i, j)]
        if len(j):
            j = j[may_link(n[i], n[j], k[i], k[j], sig[i], sig[j], percent)]
        if len(j):
            yield i, j


def _labels(rows: list) -> np.ndarray:
    return np.unique([r.component for r in rows], return_inverse=True)[1]


def _near(rows: list, percent: int) -> Iterator[tuple[int, int, int]]:
    """(group, doc_id, component, pivot) of the rows that have a partner by their bit counts."""
    if len(rows) == 1:
        return
    block, guest, inner = np.array([r.block for r in rows]), np.array([r.guest for r in rows], bool), rows[0].inner
    group = np.arange(len(rows))
    # who is in one group already needs no comparison
    for i, j in _candidates(rows, [r.sig for r in rows], _labels(rows), percent, lambda i, j: ~(guest[j] & guest[i]) & (inner | (block[j] != block[i])) & (group[j] != group[i])):
        group[np.isin(group, group[j])] = group[i]
    order = np.argsort(group, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        if len(own) > 1:
            ids = np.array([rows[x].doc_id for x in own.tolist()], "<i8")
            name = int.from_bytes(blake2b(ids.tobytes(), digest_size=8).digest(), "little", signed=True)
            yield from ((name, rows[x].doc_id, rows[x].component, rows[x].pivot) for x in own.tolist())


def _join(rows: list, percent: int) -> Iterator[tuple[int, int]]:
    """Links that join the components of these rows, by exact intersections; with a pivot among them, only its own."""
    label, pivot = _labels(rows), np.array([r.pivot for r in rows], bool)
    shared = [unpacked_keys(r.shared) for r in rows]
    for i, j in _candidates(rows, [signature(keys).tobytes() for keys in shared], label, percent, (lambda i, j: pivot[i] | pivot[j]) if pivot.any() else None):
        n = np.array([rows[x].n for x in j.tolist()], np.int64)
        for x in j[linked(rows[i].n, n, overlaps(shared[i], [shared[x] for x in j.tolist()]), percent)].tolist():
            if label[x] != label[i]:
                label[label == label[x]] = label[i]
                yield rows[i].doc_id, rows[x].doc_id


def components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every document.

    Null and empty texts and texts without words have no shingles and are linked with nothing;
    equal sets of shingles always link; rows of one doc_id with several texts are one document
    that links by each of them; an empty table gives no rows; columns other than doc_id and text
    are not read.
    """
    counted = shared_shingles(texts(docs), width)
    table = staged(sets_of(counted, percent), "jaccard-sets")
    spent(counted)
    sets = ["set_a", "set_b"]
    standing = table.where("n > 0 and doc_id = stands")
    first = standing.groupBy(*sets).agg(F.min("doc_id").alias("first"))
    # within a unit documents know who stands for them, so that a group of copies does not meet in one place
    by_standing = standing.select("stands", *sets).distinct().join(first, sets)
    classes = staged(
        table.select("doc_id", "n", "stands", *sets).join(by_standing, ["stands", *sets], "left").select("doc_id", "n", F.coalesce("first", "doc_id").alias("first")), "jaccard-classes"
    )
    # rows of all standing sets stay where they are; which of equal sets meet others is told by narrow rows
    candidates = standing.where("prefix is not null").select("doc_id", "n", "own", "shared", "sig")
    ones = standing.where("prefix is not null").select("doc_id", *sets).join(first, sets).where("doc_id = first").select("doc_id", *sets).distinct()
    members = staged(tiles(standing.where("prefix is not null").select("doc_id", *sets, "n", "own", "prefix").join(ones, ["doc_id", *sets], "left_semi")), "jaccard-tiles")
    several = classes.where("n > 0").groupBy("doc_id").agg(F.min("first").alias("lo"), F.max("first").alias("hi")).where("lo < hi")
    links = staged(classes.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).where("a <> b").distinct(), "jaccard-links")
    found = connected_components(links) if links.limit(1).count() else None
    for turn in count():
        open_, seen = staged_and_seen(open_members(members, found, turn), "jaccard-open", rows=F.count("*"), pairs=F.sum(F.col("pairs") / F.col("size")))
        rows, pairs = seen.get("rows") or 0, seen.get("pairs") or 0
        if not rows:
            break
        if last := turn >= TURNS or turn > 0 and (pairs <= PAIRS_EACH * rows or 5 * linked_pairs <= asked):
            new = staged(tile_links(open_, candidates, percent), "jaccard-links", batch_rows=BATCH_ROWS)
        else:
            pairs_drawn, seen = staged_and_seen(star_pairs(open_), "jaccard-pairs", n=F.count("*"))
            asked = seen.get("n") or 0
            new, seen = staged_and_seen(verify(pairs_drawn, asked, candidates, percent), "jaccard-links", batch_rows=BATCH_ROWS, n=F.count("*"))
            linked_pairs = seen.get("n") or 0
            spent(pairs_drawn)
        spent(open_)
        links = links.union(new)
        if found is not None:
            spent(found)
        found = connected_components(links)
        if last:
            break
    spent(members, table)
    if found is None:
        return classes.select("doc_id", F.col("n").alias("n_shingles"), F.col("first").alias("component_id"))
    joined = classes.join(found.withColumnRenamed("node", "first"), "first", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "first").alias("component_id"))


def op6_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(read_table(spark, sf_dir, "documents"))
