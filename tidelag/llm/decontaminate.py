"""Benchmark decontamination: BM25 over an inverted index of test items with block-max WAND.

Every passage of every training document is a query. Impacts are divided by the score an item
needs (``MATCH`` of the score it gives itself), so one threshold, 1, holds for all items. A
retrieved pair counts as a leak when the passage holds enough of both the question and the
answer part of the item, as word trigrams.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.llm.common import Numbers, blocks, read_table, staged, texts

K1, B = 1.2, 0.75
MATCH = 0.8
OVERLAP = 0.6
#: Words of items in one index; bytes of its bounds, and of all bounds that one pass over the documents searches by.
INDEX_WORDS = 20_000
INDEX_BYTES, PASS_BYTES = 16_000_000, 64_000_000
POSTING_BLOCK = 4
#: Share of the items above which a term counts as common.
COMMON = 0.05
WORDS = re.compile(r"[^\W_]+")
#: Characters of text, and cells of passages by blocks of items, that are held at once.
BLOCK_CHARS = 1_000_000
CELLS = 4_000_000
SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def item_words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def trigrams(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence is the answer if it leaves a question, else the last third of the words."""
    words = item_words(text)
    tail = item_words(re.split(r"(?<=[.?!])\s+", text.strip())[-1])
    cut = len(words) - len(tail)
    if not (2 < cut and 2 < len(tail)):
        cut = max(1, len(words) * 2 // 3)
    return words[:cut], words[cut:]


@dataclass
class Index:
    """Postings by term: item places ascending, impacts, and the largest impact of each block."""

    items: list[tuple[int, str]]
    places: list[list[int]]
    impacts: list[list[float]]
    block_max: list[list[float]]
    upper: list[float]
    terms: dict[str, int]
    window: int
    parts: list[tuple[set, set]]
    common: np.ndarray  # terms of many items
    bounds: np.ndarray  # by term and block of items, the largest impact
    common_most: np.ndarray  # by block, the most that common terms give one of its items

    def search(self, query: list[int]) -> list[tuple[int, float]]:
        """Items that reach the threshold for the distinct terms of ``query``, by block-max WAND."""
        cursors = [[self.places[t][0], 0, t] for t in query]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += self.upper[t]
                if bound >= 1.0 - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            place = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == place:
                pivot += 1
            tight, nearest = 0.0, len(self.items)
            for _, i, t in cursors[: pivot + 1]:
                postings = self.places[t]
                at = bisect_left(postings, place, i)
                if at < len(postings):
                    block = at // POSTING_BLOCK
                    tight += self.block_max[t][block]
                    nearest = min(nearest, postings[min(len(postings), (block + 1) * POSTING_BLOCK) - 1] + 1)
            if tight < 1.0 - 1e-9:  # no item up to the end of the nearest block can do
                goal = max(place + 1, nearest)
                if pivot + 1 < len(cursors):
                    goal = max(place + 1, min(goal, cursors[pivot + 1][0]))
                self._advance(cursors, pivot + 1, goal)
            elif cursors[0][0] == place:
                score = 0.0
                for _, i, t in cursors[: pivot + 1]:
                    score += self.impacts[t][i]
                if score >= 1.0 - 1e-9:
                    found.append((place, float(score)))
                self._advance(cursors, pivot + 1, place + 1)
            else:
                self._advance(cursors, pivot, place)
        return found

    def _advance(self, cursors: list[list[int]], n: int, goal: int) -> None:
        """Move the first ``n`` cursors to ``goal`` or beyond; drop those that end."""
        for c in cursors[:n]:
            if c[0] < goal:
                postings = self.places[c[2]]
                c[1] = bisect_left(postings, goal, c[1])
                c[0] = postings[c[1]] if c[1] < len(postings) else -1
        cursors[:] = [c for c in cursors if c[0] >= 0]


def window_of(n_words: int) -> int:
    """Half the length of the passages that an item is looked for in: the next power of two."""
    return 1 << max(0, n_words - 1).bit_length()


def build_index(items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean_words: float) -> Index:
    """Index of some items of one window, with document frequencies over all items."""
    terms: dict[str, int] = {}
    lists: list[list[tuple[int, float]]] = []
    parts = []
    longest = 1
    for place, (_, text) in enumerate(items):
        words = item_words(text)
        longest = max(longest, window_of(len(words)))
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        norm = K1 * (1 - B + B * len(words) / mean_words)
        impact = {w: math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in counts.items()}
        need = MATCH * sum(impact.values())
        for w, x in impact.items():
            at = terms.setdefault(w, len(terms))
            if at == len(lists):
                lists.append([])
            lists[at].append((place, x / need))
        question, answer = question_and_answer(text)
        parts.append((trigrams(question), trigrams(answer)))
    places = [np.array([p for p, _ in x], np.int64) for x in lists]
    impacts = [np.array([v for _, v in x]) for x in lists]
    block_max = [np.maximum.reduceat(v, np.arange(0, len(v), POSTING_BLOCK)) for v in impacts]
    upper = np.array([v.max() for v in impacts] or [0.0])
    common = np.array([len(p) > COMMON * len(items) for p in places] or [True])
    n_blocks = -(-len(items) // POSTING_BLOCK)
    bounds, common_sum = np.zeros((len(common), max(1, n_blocks)), np.float32), np.zeros(max(1, n_blocks) * POSTING_BLOCK)
    for t, (p, v) in enumerate(zip(places, impacts, strict=True)):
        if common[t]:
            common_sum[p] += v
        else:
            np.maximum.at(bounds[t], p // POSTING_BLOCK, v)
    common_most = common_sum.reshape(-1, POSTING_BLOCK).max(axis=1)
    return Index(items, [p.tolist() for p in places], [v.tolist() for v in impacts], [m.tolist() for m in block_max], upper.tolist(), terms, longest, parts, common, bounds, common_most)


def numbered_words(all_texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, the number of every word in order, how many words each text has).

    A long text is read about ``BLOCK_CHARS`` characters at a time, so that its words are never
    all there as strings.
    """
    known, rows, lengths = Numbers(), [np.zeros(0, np.int32)], []
    for text in all_texts:
        at = count = 0
        while at < len(text):
            stop = at + BLOCK_CHARS
            while stop < len(text) and not text[stop].isspace():
                stop += 1
            rows.append(np.fromiter(map(known.__getitem__, item_words(text[at:stop])), np.int32))
            at, count = stop, count + len(rows[-1])
        lengths.append(count)
    return list(known), np.concatenate(rows), np.array(lengths, np.int64)


def find_leaks(index: Index, ids: list[int], distinct: list[str], words: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, float, float, float]]:
    """The best passage of each (document, item) pair that is retrieved and verified.

    Passages are two windows long and one window apart, so one of them holds any item whole.
    They are bounded first, many at once, by the block maxima of their rarer terms plus the most
    that common terms give an item of the block; only passages that may reach the threshold in
    some block are searched.
    """
    window = index.window
    first = np.cumsum(lengths) - lengths
    starts = [np.arange(f, max(f + 1, f + n - window), window) if n else np.zeros(0, np.int64) for f, n in zip(first.tolist(), lengths.tolist(), strict=True)]
    doc = np.repeat(np.arange(len(ids)), [len(s) for s in starts])
    begin = np.concatenate([np.zeros(0, np.int64), *starts]).astype(np.int64)
    end = np.minimum(begin + 2 * window, (first + lengths)[doc])
    terms = np.fromiter(map(index.terms.get, distinct, repeat(-1)), np.int32, len(distinct))[words] if len(words) else words
    kept = np.flatnonzero((terms >= 0) & ~index.common[terms])
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    most = max(1, CELLS // index.bounds.shape[1])
    at = 0
    while at < len(begin):
        upto = max(at + 1, int(np.searchsorted(end, begin[at] + most, side="right")))
        own = slice(at, upto)
        low, high = np.searchsorted(kept, (begin[at], end[upto - 1]))
        sums = np.zeros((high - low + 1, index.bounds.shape[1]), np.float64)
        np.cumsum(index.bounds[terms[kept[low:high]]], axis=0, out=sums[1:])
        bound = sums[np.searchsorted(kept, end[own]) - low] - sums[np.searchsorted(kept, begin[own]) - low] + index.common_most
        for k in (at + np.flatnonzero((bound >= 1.0 - 1e-6).any(axis=1))).tolist():
            s, e = int(begin[k]), int(end[k])
            query = np.unique(terms[s:e])
            held = None
            for place, score in index.search(query[query >= 0].tolist()):
                held = held or trigrams([distinct[w] for w in words[s:e].tolist()])
                question, answer = index.parts[place]
                q = len(question & held) / max(1, len(question))
                a = len(answer & held) / len(answer) if answer else q
                if q >= OVERLAP and a >= OVERLAP and (score, q, a) > best.get((int(doc[k]), place), (0.0,)):
                    best[int(doc[k]), place] = (score, q, a)
        at = upto
    return [(ids[k], index.items[p][0], *x) for (k, p), x in sorted(best.items())]


def _item_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words = [item_words(t) for t in batch.text]
        yield batch.assign(n=[len(w) for w in words], half=[window_of(len(w)) for w in words], words=[sorted(set(w)) for w in words])


def leaks(docs: DataFrame, benchmark: DataFrame, index_words: int = INDEX_WORDS) -> DataFrame:
    """(doc_id, item_id, score, overlaps): documents that hold a test item; score 1 is the threshold.

    Statistics are those of all items, and the length of passages is that of the item, whatever
    other items there are and however many indices they fill. Null and empty texts hold nothing;
    items without words match nothing; an item without item_id is reported under NULL; repeated
    documents each give their rows; an empty benchmark gives no rows.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = staged(items.mapInPandas(_item_rows, "item_id long, text string, n long, half long, words array<string>").where("n > 0"), "benchmark")
    whole = items.agg(F.count("*").alias("n"), F.avg("n").alias("mean")).first()
    if not whole.n:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    df = staged(items.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df")), "benchmark-words")
    sizes = items.groupBy("half").agg(F.sum("n").alias("words"), F.count("*").alias("items")).orderBy("half").collect()
    shards = [(r.half, n, k) for r in sizes for n in [shards_of(r.words, r.items, index_words)] for k in range(n)]
    out, at = None, 0
    while at < len(shards):
        indices, held = [], 0
        while at < len(shards) and (not indices or held + INDEX_BYTES <= PASS_BYTES):
            indices.append(_index_of(items, df, *shards[at], whole.n, whole.mean))
            held, at = held + indices[-1].bounds.nbytes, at + 1
        found = _search_all(docs, indices)
        out = found if out is None else out.unionByName(found)
    return out


def shards_of(words: int, items: int, index_words: int) -> int:
    """Indices for items of one window: each has about ``index_words`` words at most, and bounds, one
    number of 4 bytes for each term and block of items, of about ``INDEX_BYTES`` at most."""
    return max(-(-words // index_words), math.ceil(math.sqrt(4 * words * -(-items // POSTING_BLOCK) / INDEX_BYTES)))


def _index_of(items: DataFrame, df: DataFrame, half: int, shards: int, shard: int, n_items: int, mean: float) -> Index:
    """The index of one shard; about ``INDEX_WORDS`` words come to the driver."""
    own = items.where((F.col("half") == half) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard))
    counts = own.select(F.explode("words").alias("w")).distinct().join(df, "w").collect()
    rows = sorted(((r.item_id, r.text) for r in own.select("item_id", "text").collect()), key=lambda r: (r[1], r[0] is None, r[0]))
    return build_index(rows, {r.w: r.df for r in counts}, n_items, mean)


def _search_all(docs: DataFrame, indices: list[Index]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, all_texts = batch.doc_id.tolist(), batch.text.tolist()
            for part in blocks(all_texts, BLOCK_CHARS):
                numbered = numbered_words(all_texts[part])
                rows = [r for index in indices for r in find_leaks(index, ids[part], *numbered)]
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"item_id": "Int64"})

    return texts(docs).mapInPandas(run, SCHEMA)


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
