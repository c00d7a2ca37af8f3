"""Hierarchical Pitman-Yor language model with Chinese-restaurant seating sampled by Gibbs.

Each context, the whole word before, is a restaurant whose customers are the words that follow;
all context restaurants share one parent, whose customers are their tables; its base measure is
uniform over the training words and one unknown word. A word's customers, tables and parent all
lie in the word's own bucket, so seating is sampled bucket by bucket. A pair that occurs once has
one table whatever is drawn, so only pairs that occur more often are kept and seated: a context's
tables are its customers (its word's count) less the customers who joined a table, and these are
summed between sweeps in the context's bucket and sent back to the words' buckets that know it.
Each pair of a chunk of documents travels once, when it is counted; the bucket notes its place in
the counts, and sends counts and tables to the chunk when the sweeps are over. Contexts are told
apart by 64-bit hashes. Predictive probabilities are averaged over the kept samples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.llm.common import Numbers, blocks, from_planes, large, planes, read_table, release_memory, small, spent, staged, tasks_for, texts, words_of
from tidelag.llm.features import hash_of, remainder5

SWEEPS, KEPT = 3, 2
STRENGTH = 1.0
#: Stand for the end of a text and for what is before its first word; words hold no white space.
END, START = "\t", "\n"
#: Rows between buckets and chunks. Kinds: a bucket's counts, what joined tables of its contexts, places of a chunk's words and pairs, sums.
COLUMNS = "kind int, bucket int, chunk long, a binary, b binary, c binary, d binary, e binary"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
COUNTS, TOTALS, ASKED, SUMS = -2, -1, 0, 2
#: A chunk's documents.
DOCUMENTS = "chunk long, ids binary, held binary, lengths binary, tokens binary, words binary, ends binary"
CHUNK_CHARS = 8_000_000
BUCKET_CHARS = 16_000_000


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Sampled tables of each dish: ``weight`` is (strength + discount * tables) * parent probability.

    A customer opens a table with probability weight / (weight + seated - discount * tables).
    Between two openings ``tables`` stands still, and the number of customers who join tables
    before the next one opens is geometric with a chance drawn from
    Beta(weight, seated - discount * tables): one step for each table, exact for any number.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    open_ = np.flatnonzero(customers > 1)
    w, c = np.asarray(weight, np.float64)[open_], customers[open_].astype(np.float64)
    seated, opened = np.ones(len(open_)), np.ones(len(open_), np.int64)
    while len(open_):
        with np.errstate(divide="ignore", over="ignore"):
            join = np.floor(rng.standard_exponential(len(open_)) / -np.log1p(-rng.beta(w, seated - discount * opened)))
        seated = seated + join + 1
        more = seated <= c
        opened += more
        tables[open_[~more]] = opened[~more]
        last = seated == c
        tables[open_[last]] = opened[last]
        left = seated < c
        open_, w, c, seated, opened = open_[left], w[left], c[left], seated[left], opened[left]
    return tables


@dataclass(frozen=True)
class Totals:
    """Sizes over all restaurants: customers, their tables (the parent's customers), the parent's tables."""

    customers: int
    parent_customers: int
    parent_tables: int


@dataclass(frozen=True)
class Model:
    """What holds for the whole corpus: words, and the totals before each sweep and after the last."""

    types: int
    discount: float
    totals: list[Totals]

    @property
    def tokens(self) -> int:
        return self.totals[0].customers

    def sweeps(self, table: "Bucket", joined: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(tables by word and context, the parent's customers and tables by word) after each sweep so far.

        ``joined`` holds the customers at tables that others opened in the bucket's contexts, over
        all words, before each sweep.
        """
        tables = np.ones(len(table.count), np.int64)
        parent = table.parent(tables)
        parent_tables = np.minimum(parent, 1)
        for k, (t, of_context) in enumerate(zip(self.totals[:SWEEPS], joined)):
            rng = np.random.default_rng((table.bucket, k))
            p = self.parent_probability(t, parent, parent_tables)
            tables = seat(table.count, (STRENGTH + self.discount * (table.customers - of_context)[table.local]) * p[table.word], self.discount, rng)
            parent = table.parent(tables)
            parent_tables = seat(parent, np.full(table.n, self.base_weight(t)), self.discount, rng)
            yield tables, parent, parent_tables

    def base_weight(self, t: Totals) -> float:
        return (STRENGTH + self.discount * t.parent_tables) / (self.types + 1)

    def parent_probability(self, t: Totals, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - self.discount * tables + self.base_weight(t)) / (STRENGTH + t.parent_customers)


class Bucket:
    """One bucket's words, sorted, with their numbers of tokens, and the (word, hash of the context, count) that
    occur more than once, sorted. The start of texts counts as a word that nothing comes before."""

    def __init__(self, bucket: int, words: list[bytes], totals: np.ndarray, word: np.ndarray, context: np.ndarray, count: np.ndarray):
        self.bucket, self.words, self.all, self.word, self.context, self.count, self.n = bucket, words, totals, word, context, count, len(words)
        self.contexts, self.local = np.unique(context, return_inverse=True)
        self.totals = np.where([w == START.encode() for w in words], 0, totals) if words else totals
        self.customers = np.zeros(len(self.contexts), np.int64)  # comes from the contexts' buckets

    def parent(self, tables: np.ndarray) -> np.ndarray:
        """Tables of each word over all contexts: those of pairs that occur once are their customers."""
        return self.totals - np.bincount(self.word, self.count - tables, self.n).astype(np.int64)

    def packed(self) -> tuple[bytes, bytes, bytes, bytes, bytes]:
        return b" ".join(self.words), small(self.all), small(np.bincount(self.word, minlength=self.n)), self.context.astype("<u8").tobytes(), small(self.count)


def unpack(bucket: int, words: bytes, totals: bytes, per_word: bytes, context: bytes, count: bytes) -> Bucket:
    spelled = words.split(b" ") if words else []
    word = np.repeat(np.arange(len(spelled)), large(per_word, len(spelled)))
    return Bucket(bucket, spelled, large(totals, len(spelled)), word, np.frombuffer(context, "<u8"), large(count, len(word)))


class Held:
    """A words' bucket as its rows come in: counts, then of its contexts the customers and who joined before each sweep."""

    def __init__(self, bucket: int, buckets: int):
        self.bucket, self.buckets, self.table, self.parts = bucket, buckets, unpack(bucket, *[b""] * 5), {}

    def take(self, r) -> None:
        if r.kind == COUNTS:
            self.table = unpack(r.bucket, r.a, r.b, r.c, r.d, r.e)
        else:
            self.parts.setdefault(r.chunk >> 32, []).append((r.chunk & 0xFFFFFFFF, r.a, r.b))

    def joined(self) -> list[np.ndarray]:
        order, ends = dealt(self.table.contexts, self.buckets)
        out = []
        for k in sorted(self.parts):
            out.append(np.zeros(len(order), np.int64))
            for side, data, customers in self.parts[k]:
                own = order[ends[side] : ends[side + 1]]
                out[-1][own] = large(data, len(own))
                if customers:
                    self.table.customers[own] = large(customers, len(own))
        return out


def dealt(contexts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The contexts in the order of their buckets, and where each bucket ends."""
    side = (contexts % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(side, kind="stable")
    return order, np.searchsorted(side[order], np.arange(buckets + 1))


@dataclass
class Chunk:
    """Tokens of some documents: distinct words, and for each token its document, word and context."""

    words: list[str]
    lengths: np.ndarray
    doc: np.ndarray
    word: np.ndarray
    context: np.ndarray  # place of the word before; len(words) at the start
    hashes: np.ndarray  # of the words and the start
    side: np.ndarray  # bucket of each distinct word

    @classmethod
    def of(cls, all_texts: list[str], buckets: int) -> Chunk:
        known = Numbers()
        rows = [np.fromiter(map(known.__getitem__, [*words_of(t), END]), np.int64) for t in all_texts]
        lengths = np.array([len(r) for r in rows], np.int64)
        words, word = list(known), np.concatenate(rows)
        hashes = hash_of([*words, START])
        context = np.r_[0, word[:-1]]
        context[np.cumsum(lengths) - lengths] = len(words)
        return cls(words, lengths, np.repeat(np.arange(len(rows)), lengths), word, context, hashes, (hashes[:-1] % np.uint64(buckets)).astype(np.int64))

    def by_bucket(self, of_tokens: np.ndarray, buckets: int) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray]]:
        """(bucket, its words, tokens in it among ``of_tokens``, places of their words in the list)."""
        spelled = [w.encode("utf-8", "surrogatepass") for w in self.words]
        used = np.flatnonzero(np.bincount(self.word[of_tokens], minlength=len(self.words)))
        by_word = used[np.argsort(self.side[used], kind="stable")]
        word_ends = np.searchsorted(self.side[by_word], np.arange(buckets + 1))
        side = self.side[self.word[of_tokens]]
        by_token = of_tokens[np.argsort(side, kind="stable")]
        token_ends = np.searchsorted(np.sort(side), np.arange(buckets + 1))
        place = np.empty(len(self.words), np.int64)
        for b in range(buckets):
            own = by_word[word_ends[b] : word_ends[b + 1]]
            if len(own):
                place[own] = np.arange(len(own))
                tokens = by_token[token_ends[b] : token_ends[b + 1]]
                yield b, [spelled[i] for i in own], tokens, place[self.word[tokens]]

    def pairs(self, buckets: int) -> tuple[np.ndarray, list[tuple[int, list[bytes], np.ndarray]]]:
        """For each token its place among the distinct pairs; (bucket, its words, sorted distinct pairs of word and context)."""
        pair_of, asked, n = np.empty(len(self.word), "<u4"), [], 0
        for b, words, tokens, place in self.by_bucket(np.arange(len(self.word)), buckets):
            distinct, index = np.unique(place << 32 | self.context[tokens], return_inverse=True)
            pair_of[tokens] = n + index
            n += len(distinct)
            asked.append((b, words, distinct))
        return pair_of, asked


def chunked(docs: DataFrame, buckets: int) -> DataFrame:
    """Chunks of documents: their tokens as numbers of the distinct words, which lie bucket after bucket; the first number is the start's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for part in blocks(all_texts := batch.text.tolist(), CHUNK_CHARS):
                chunk = Chunk.of(all_texts[part], buckets)
                spelled = [*(w.encode("utf-8", "surrogatepass") for w in chunk.words), START.encode()]
                side = (chunk.hashes % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(side, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                ends = np.searchsorted(side[order], np.arange(1, buckets + 1))
                yield pd.DataFrame([(
                    number, batch.doc_id.iloc[part].to_numpy("<i8").tobytes(), batch.held_out.iloc[part].to_numpy(bool).astype(np.uint8).tobytes(), chunk.lengths.astype("<i8").tobytes(),
                    planes(np.r_[place[-1], place[chunk.word]], "<u4"), b" ".join([spelled[i] for i in order]), ends.astype("<i8").tobytes(),
                )], columns=[c.split()[0] for c in DOCUMENTS.split(", ")])
                number += 1
                release_memory()

    return staged(docs.mapInPandas(run, DOCUMENTS), "lm-chunks")


def pairs_of(tokens: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct pairs of word and context, and each token's place among them."""
    start, *_ = numbers = from_planes(tokens, "<u4").astype(np.int64)
    word = numbers[1:]
    context = numbers[:-1].copy()
    context[np.cumsum(lengths) - lengths] = start
    return np.unique(word << 32 | context, return_inverse=True)


def count_words(chunks: DataFrame, buckets: int) -> DataFrame:
    """For each bucket of words a row of kind COUNTS over the training texts, and for each chunk one of kind ASKED:
    places of its words (0: unknown), and of its pairs (0: in no training text, 1: once, from 2: in the counts)."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                n, words, ends = np.frombuffer(r.lengths, "<i8"), r.words.split(b" "), np.frombuffer(r.ends, "<i8")
                training = np.frombuffer(r.held, np.uint8) == 0
                pairs, pair_of = pairs_of(r.tokens, n)
                learnt = np.repeat(training, n)
                count = np.bincount(pair_of[learnt], minlength=len(pairs))
                word = pairs >> 32
                totals = np.bincount(word, count, len(words)).astype(np.int64)
                totals[int(from_planes(r.tokens, "<u4")[0])] = training.sum()
                hashes = hash_of([w.decode("utf-8", "surrogatepass") for w in words])[pairs & 0xFFFFFFFF]
                per_word = np.bincount(word, minlength=len(words))
                at, out, first = np.searchsorted(word, ends), [], 0
                for b, (i, j, p, q) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), np.r_[0, at[:-1]].tolist(), at.tolist(), strict=True)):
                    if j > i:
                        out.append((COUNTS, b, r.chunk, b" ".join(words[i:j]), small(totals[i:j]), small(per_word[i:j]), hashes[p:q].tobytes(), small(count[p:q])))
                yield pd.DataFrame(out, columns=NAMES)
                release_memory()

    def add(batch: pd.DataFrame) -> pd.DataFrame:
        known, places, totals, word, context, count, sizes = Numbers(), [], [], [], [], [], []
        for r in batch.itertuples():
            words = r.a.split(b" ")
            places.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
            totals.append(large(r.b, len(words)))
            word.append(np.repeat(places[-1], large(r.c, len(words))))
            context.append(np.frombuffer(r.d, "<u8"))
            count.append(large(r.e, len(word[-1])))
            sizes.append(len(word[-1]))
        total = np.bincount(np.concatenate(places), np.concatenate(totals), len(known)).astype(np.int64)
        spelled = list(known)
        kept = sorted(np.flatnonzero(total).tolist(), key=spelled.__getitem__)
        place = np.zeros(len(spelled) + 1, np.int64)
        place[kept] = np.arange(1, len(kept) + 1)
        contexts, local = np.unique(np.concatenate(context), return_inverse=True)
        keys, pair_of = np.unique(place[np.concatenate(word)] << 32 | local, return_inverse=True)
        counts = np.bincount(pair_of, np.concatenate(count), len(keys)).astype(np.int64)
        several = np.flatnonzero(counts > 1)
        table = Bucket(0, [spelled[i] for i in kept], total[kept], (keys[several] >> 32) - 1, contexts[keys[several] & 0xFFFFFFFF], counts[several])
        noted = np.minimum(counts, 1)
        noted[several] = np.arange(2, 2 + len(several))
        bucket, at = batch.bucket.iloc[0], np.cumsum(sizes)
        out = [(COUNTS, bucket, 0, *table.packed())]
        for r, own, i, j in zip(batch.itertuples(), places, np.r_[0, at[:-1]].tolist(), at.tolist(), strict=True):
            out.append((ASKED, bucket, r.chunk, planes(place[own], "<u4"), planes(noted[pair_of[i:j]], "<u4"), b"", b"", b""))
        release_memory()
        return pd.DataFrame(out, columns=NAMES)

    return staged(chunks.mapInPandas(send, COLUMNS).groupBy("bucket").applyInPandas(add, COLUMNS), "lm-counts")


def met(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows of one bucket one after another, its counts and totals first."""
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "chunk")


def fit(counts: DataFrame, buckets: int) -> tuple[Model, DataFrame]:
    """Sample the seating in sweeps; (model, what joined tables of contexts): for buckets of words (numbers below
    ``buckets``) before each sweep, for buckets of contexts (above) after the kept ones."""
    table = counts.where(F.col("kind") == COUNTS)

    def add(batch: pd.DataFrame) -> pd.DataFrame:
        """Sum a bucket of contexts, and send the sums back to each bucket of words that named them."""
        out = [r[1:] for r in batch[batch.kind == SUMS].itertuples()]
        own, batch = batch[batch.kind == COUNTS], batch[batch.kind == TOTALS]
        if len(batch):
            contexts, index = np.unique(np.frombuffer(b"".join(batch.a), "<u8"), return_inverse=True)
            sums = np.bincount(index, np.frombuffer(b"".join(batch.b), "<i8"), len(contexts)).astype(np.int64)
            side, k, customers = int(batch.bucket.iloc[0]), int(batch.c.iloc[0]), None
            if len(own):  # before the first sweep
                hashes = np.frombuffer(own.a.iloc[0], "<u8")
                order = np.argsort(hashes)
                customers = np.frombuffer(own.b.iloc[0], "<i8")[order][np.searchsorted(hashes[order], contexts)]
            out.append((TOTALS, buckets + side, k, contexts.tobytes(), small(sums), b"", b"", b""))
            at = 0
            for r in batch.itertuples():
                i = index[at : at + len(r.a) // 8]
                out.append((TOTALS, r.chunk, k << 32 | side, small(sums[i]), b"" if customers is None else small(customers[i]), b"", b"", b""))
                at += len(i)
        release_memory()
        return pd.DataFrame(out, columns=NAMES)

    def pass_over(model: Model | None, rows: DataFrame, k: int) -> DataFrame:
        def seated(held: Held) -> pd.DataFrame:
            table, out = held.table, []
            if model is None:
                tables, parent_tables = np.ones(len(table.count), np.int64), int((table.totals > 0).sum())
                hashes = hash_of([w.decode("utf-8", "surrogatepass") for w in table.words])
                out.append((COUNTS, held.bucket, 0, hashes.astype("<u8").tobytes(), table.all.astype("<i8").tobytes(), b"", b"", b""))
            else:
                *_, (tables, _, last) = model.sweeps(table, held.joined())
                parent_tables = int(last.sum())
            joined = table.count - tables
            customers = table.totals.sum()
            numbers = np.array([customers, customers - joined.sum(), parent_tables, (table.totals > 0).sum(), customers - table.count.sum(), (table.count == 2).sum()], "<i8")
            out.append((SUMS, held.bucket, 0, numbers.tobytes(), b"", b"", b"", b""))
            by_context = np.bincount(table.local, joined, len(table.contexts)).astype("<i8")
            order, ends = dealt(table.contexts, buckets)
            for b in np.flatnonzero(np.diff(ends)).tolist():
                own = order[ends[b] : ends[b + 1]]
                out.append((TOTALS, b, held.bucket, table.contexts[own].tobytes(), by_context[own].tobytes(), str(k).encode(), b"", b""))
            return pd.DataFrame(out, columns=NAMES)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = None
            for batch in batches:
                for r in batch.itertuples():
                    if held is None or held.bucket != r.bucket:
                        if held is not None:
                            yield seated(held)
                            release_memory()
                        held = Held(r.bucket, buckets)
                    held.take(r)
            if held is not None:
                yield seated(held)
                release_memory()

        return staged(rows.mapInPandas(run, COLUMNS).groupBy("bucket").applyInPandas(add, COLUMNS), "lm-totals")

    def summed(rows: DataFrame) -> np.ndarray:
        return sum((np.frombuffer(r.a, "<i8") for r in rows.where(F.col("kind") == SUMS).select("a").toLocalIterator()), np.zeros(6, np.int64))

    done = pass_over(None, table, 0)
    first = [int(v) for v in summed(done)]
    types, once, twice = first[3:]
    model = Model(types, min(0.95, max(0.1, once / max(1.0, once + 2.0 * twice))), [Totals(*first[:3])])
    totals = done.where(F.col("kind") == TOTALS)
    for k in range(SWEEPS):
        done = pass_over(model, met(table.union(totals.where(F.col("bucket") < buckets)), buckets), k + 1)
        model = Model(types, model.discount, [*model.totals, Totals(*(int(v) for v in summed(done)[:3]))])
        totals = totals.union(done.where(F.col("kind") == TOTALS))
    return model, totals.where(F.when(F.col("bucket") < buckets, F.shiftright("chunk", 32) < SWEEPS).otherwise(F.col("chunk") > SWEEPS - KEPT))


def score(chunks: DataFrame, counts: DataFrame, totals: DataFrame, model: Model, buckets: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    floor = model.tokens + 0.5 * (model.types + 1)

    def numbers(held: Held, own: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """By word, after an unknown one: tokens, then for each kept sample the parent's customers and tables and who
        joined tables where it is the context. By pair, after none and a single one: customers, then tables."""
        table = held.table
        hashes = hash_of([w.decode("utf-8", "surrogatepass") for w in table.words])
        words, pairs = [table.all], [np.r_[0, 1, table.count]]
        joined = {k: (contexts, sums) for k, contexts, sums in own}
        for k, (tables, parent, parent_tables) in enumerate(model.sweeps(table, held.joined()), 1):
            if k > SWEEPS - KEPT:
                of_context = np.zeros(table.n, np.int64)
                if k in joined:
                    contexts, sums = joined[k]
                    at = np.minimum(np.searchsorted(contexts, hashes), len(contexts) - 1)
                    of_context = np.where(contexts[at] == hashes, sums[at], 0)
                words += [parent, parent_tables, of_context]
                pairs.append(np.r_[0, 1, tables])
        return np.pad(np.stack(words), ((0, 0), (1, 0))), np.stack(pairs)

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Row by row, a bucket's counts and totals first: what a chunk asks for is never gathered with that of others."""
        held, ready, own = None, None, []
        for batch in batches:
            for r in batch.itertuples():
                if held is None or held.bucket != r.bucket:
                    held, ready, own = Held(r.bucket, buckets), None, []
                if r.kind < ASKED and r.e == b"own":
                    contexts = np.frombuffer(r.a, "<u8")
                    own.append((r.chunk, contexts, large(r.b, len(contexts))))
                elif r.kind < ASKED:
                    held.take(r)
                else:
                    ready = ready or numbers(held, own)
                    words, pairs = (x[:, from_planes(data, "<u4")] for x, data in zip(ready, (r.a, r.b), strict=True))
                    sizes = np.array([words.shape[1], pairs.shape[1]], "<i8")
                    yield pd.DataFrame([(ASKED, r.bucket, r.chunk, small(words.ravel()), small(pairs.ravel()), sizes.tobytes(), b"", b"")], columns=NAMES)
        release_memory()

    def chunk_rows(batch: pd.DataFrame) -> pd.DataFrame:
        parts = batch[batch.kind == ASKED].sort_values("bucket")
        listed = batch[batch.kind == SUMS].iloc[0]
        ids, held, n = np.frombuffer(listed.a, "<i8"), np.frombuffer(listed.b, np.uint8) > 0, np.frombuffer(listed.c, "<i8")
        sizes = [np.frombuffer(c, "<i8") for c in parts.c]
        by_word = np.concatenate([large(a, size[0] * (1 + 3 * KEPT)).reshape(-1, size[0]) for a, size in zip(parts.a, sizes, strict=True)], axis=1)
        by_pair = np.concatenate([large(b, size[1] * (1 + KEPT)).reshape(-1, size[1]) for b, size in zip(parts.b, sizes, strict=True)], axis=1)
        pairs, pair_of = pairs_of(listed.d, n)
        word, context = pairs >> 32, pairs & 0xFFFFFFFF
        tokens, own = by_word[0], np.zeros(len(pairs))
        for k, t in enumerate(model.totals[-KEPT:]):
            parent, parent_tables, joined = by_word[1 + 3 * k : 4 + 3 * k]
            p = model.parent_probability(t, parent, parent_tables)
            own += by_pair[0] - model.discount * by_pair[1 + k] + (STRENGTH + model.discount * (tokens - joined))[context] * p[word]
        own = np.log10(own / (KEPT * (STRENGTH + tokens[context])))
        base, known = np.log10((tokens + 0.5) / floor)[word], (tokens > 0)[word]
        doc = np.repeat(np.arange(len(ids)), n)
        own, base, known = (np.bincount(doc, x[pair_of], len(ids)) for x in (own, base, known))
        release_memory()
        return pd.DataFrame({"doc_id": ids, "held_out": held, "n_tokens": n, "n_known": np.round(known).astype(np.int64), "train_tokens": model.tokens, "base_score": base, "score": own})

    of_words, of_contexts = totals.where(F.col("bucket") < buckets), totals.where(F.col("bucket") >= buckets)
    of_contexts = of_contexts.withColumn("bucket", F.col("bucket") - buckets).withColumn("e", F.lit(b"own"))
    answers = staged(met(counts.union(of_words).union(of_contexts), buckets).mapInPandas(answer, COLUMNS), "lm-answers")
    spent(counts)
    listed = chunks.select(F.lit(SUMS).alias("kind"), F.lit(0).alias("bucket"), "chunk", F.col("ids").alias("a"), F.col("held").alias("b"), F.col("lengths").alias("c"), F.col("tokens").alias("d"), F.lit(b"").alias("e"))
    return answers.union(listed).groupBy("chunk").applyInPandas(chunk_rows, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame) -> DataFrame:
    """Every document scored by the model of those whose crc32(doc_id) mod 5 is not 1.

    Null and empty texts are one end of text; repeated rows are scored each; without training
    texts all words are unknown; an empty table gives no rows; columns other than doc_id and
    text are not read.
    """
    docs = texts(docs).withColumn("held_out", remainder5() == 1)
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(tasks_for(docs.sparkSession), -(-total // BUCKET_CHARS))
    chunks = chunked(docs, buckets)
    counts = count_words(chunks, buckets)
    model, totals = fit(counts, buckets)
    return score(chunks, counts, totals, model, buckets)


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document has at least its end as a token, so its perplexity is defined."""
    scored = score_documents(read_table(spark, sf_dir, "documents"))
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
