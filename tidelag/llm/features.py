"""Sparse text features and their counts over labelled documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.llm.common import Numbers, blocks, mix64

#: Characters of text that a task holds features of at once.
BLOCK_CHARS = 2_000_000
LETTERS = re.compile(r"[^\W\d_]+")
TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def remainder5(doc_id: str = "doc_id") -> F.Column:
    """crc32(doc_id as text) mod 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def labelled(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """Texts of at most ``most`` labelled documents whose label may be learnt from: crc32(doc_id) mod 5 is not 0.

    They are those with the smallest hashed doc_id, chosen from the labels alone, so that their
    bounded list is broadcast and no text is shuffled. Repeated labels of one document count
    once, as the highest; null labels are left out.
    """
    wanted = labels.where(F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("label"))
    chosen = wanted.where(remainder5() != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.join(F.broadcast(chosen), "doc_id")


def first_of(rows: DataFrame, most: int) -> DataFrame:
    """Of labelled rows those that ``labelled`` chooses for a smaller number."""
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return rows.join(F.broadcast(chosen), "doc_id", "left_semi")


def numbered(texts: list[str], pattern: re.Pattern) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct tokens, the number of each token in order, and how many tokens each text has."""
    known = Numbers()
    number, rows = known.__getitem__, []
    for text in texts:
        rows.append(np.fromiter(map(number, pattern.findall(text)), np.int64))
    lengths = np.array([len(r) for r in rows], np.int64)
    return list(known), np.concatenate(rows) if rows else np.zeros(0, np.int64), lengths


def hash_of(tokens: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in tokens), np.uint64, len(tokens))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document index, word hash) of every lower-cased run of letters."""
    tokens, ids, lengths = numbered([t.lower() for t in texts], LETTERS)
    return np.repeat(np.arange(len(texts)), lengths), hash_of(tokens)[ids] if len(tokens) else np.zeros(0, np.uint64)


def shape_of(token: str) -> str:
    """Case or kind of a token; runs of signs stand for themselves, by sign and length up to 3."""
    if token[0].isalpha():
        return "X" if token.isupper() and len(token) > 1 else "Xx" if token[0].isupper() else "x"
    if token[0].isdigit():
        return "9"
    return token[0] + str(min(len(token), 3))


def ngram_indicators(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, feature) pairs, each once: word unigrams and bigrams, shape bigrams and trigrams."""
    tokens, ids, lengths = numbered(texts, TOKENS)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    if not len(ids):
        return doc, ids
    word = hash_of([t.lower() for t in tokens])[ids]
    shape = hash_of([shape_of(t) for t in tokens])[ids] + np.uint64(0x51)
    mask = np.uint64((1 << bits) - 1)
    two, three = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    k = np.uint64(0x9E3779B97F4A7C15)
    features = np.concatenate((
        mix64(word) & mask,
        (mix64(word[:-1] * k + word[1:]) & mask)[two],
        (mix64(shape[:-1] * k + shape[1:]) & mask)[two],
        (mix64((shape[:-2] * k + shape[1:-1]) * k + shape[2:]) & mask)[three],
    )).astype(np.int64)
    docs = np.concatenate((doc, doc[:-1][two], doc[:-1][two], doc[:-2][three]))
    both = np.unique(docs << bits | features)
    return both >> bits, both & ((1 << bits) - 1)


def class_counts(rows: DataFrame, bits: int, parts: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """For both labels the number of documents with each feature; 2**bits numbers, whatever the input.

    Each task sums its own documents, then one task sums each of ``parts`` ranges of features.
    """
    size = (1 << bits) // parts

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for part in blocks(all_texts := batch.text.tolist(), BLOCK_CHARS):
                doc, feature = ngram_indicators(all_texts[part], bits)
                label = batch.label.to_numpy()[part][doc] > 0
                for y in (0, 1):
                    sums[y] += np.bincount(feature[label == y], minlength=1 << bits)
        if sums.any():
            yield pd.DataFrame({"part": range(parts), "sums": [sums[:, p * size : (p + 1) * size].astype("<i8").tobytes() for p in range(parts)]})

    def add(batch: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<i8") for x in batch.sums)
        return pd.DataFrame({"part": [batch.part.iloc[0]], "sums": [total.tobytes()]})

    both = np.zeros((2, 1 << bits), np.int64)
    for part, sums in rows.mapInPandas(count, "part int, sums binary").groupBy("part").applyInPandas(add, "part int, sums binary").collect():
        both[:, part * size : (part + 1) * size] = np.frombuffer(sums, "<i8").reshape(2, size)
    return both[0], both[1]


def word_counts(rows: DataFrame, parts: int) -> DataFrame:
    """word long (a 64-bit hash), positive long, negative long: labelled documents that have the word."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in blocks(all_texts := batch.text.tolist(), BLOCK_CHARS):
                doc, word = word_hashes(all_texts[part])
                words, index = np.unique(word, return_inverse=True)
                once = np.unique(index.astype(np.int64) * len(all_texts[part]) + doc)
                index, doc = once // max(1, len(all_texts[part])), once % max(1, len(all_texts[part]))
                label = batch.label.to_numpy()[part][doc] > 0
                positive = np.bincount(index[label], minlength=len(words)).astype("<i8")
                negative = np.bincount(index[~label], minlength=len(words)).astype("<i8")
                at = (words % np.uint64(parts)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                ends = np.searchsorted(at[order], np.arange(parts + 1))
                sides = [order[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
                yield pd.DataFrame({"part": range(parts), "words": [words[s].tobytes() for s in sides], "positive": [positive[s].tobytes() for s in sides], "negative": [negative[s].tobytes() for s in sides]})

    def add(batch: pd.DataFrame) -> pd.DataFrame:
        words, index = np.unique(np.frombuffer(b"".join(batch.words), np.uint64), return_inverse=True)
        sums = [np.bincount(index, np.frombuffer(b"".join(batch[c]), "<i8"), len(words)).astype(np.int64) for c in ("positive", "negative")]
        keep = sums[0] > 0
        return pd.DataFrame({"word": words.view(np.int64)[keep], "positive": sums[0][keep], "negative": sums[1][keep]})

    packed = rows.mapInPandas(count, "part int, words binary, positive binary, negative binary")
    return packed.groupBy("part").applyInPandas(add, "word long, positive long, negative long")
