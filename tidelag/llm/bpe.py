"""Byte-pair encoding and decoding with a pair occurrence index.

The distinct pieces of a partition are encoded together: every pair of neighbouring symbols
is listed under its merge rank with all its positions, ranks are applied in ascending order,
and the pairs that a merge creates are listed under theirs. A new pair contains the symbol
just made, so its rank is always higher and one sweep is enough.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.llm.common import Numbers, blocks, ragged, read_table, release_memory, texts

#: Characters of text that are encoded together; bounds the memory of a task.
BLOCK_CHARS = 2_000_000
#: Positions whose pairs are looked up at once when a block begins.
NOTED = 1 << 18

# The pre-tokenisation pattern of the vocabulary.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# The same for texts of common Latin letters, where each class is a plain range.
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{_L}]*")
PLAIN_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\t\n\r {_L}0-9]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")


def pieces(text: str) -> list[str]:
    """The pieces of a text, none of which a merge crosses."""
    return PLAIN_PIECES.findall(text) if PLAIN.fullmatch(text) else PIECES.findall(text)


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins that the vocabulary file has for the 256 bytes."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges as sorted arrays, and the bytes of every id."""

    def __init__(self, content: str):
        data = json.loads(content)
        symbols = _byte_symbols()
        vocab = data["model"]["vocab"]
        added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        size = max([*vocab.values(), *added.values()]) + 1
        of = [b""] * size
        for token, i in vocab.items():
            of[i] = bytes(symbols[c] for c in token)
        for token, i in added.items():
            of[i] = token.encode()
        self.size, self.added = size, added
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.byte_id = np.zeros(256, np.int64)
        for i, token in enumerate(of[: len(vocab)]):
            if len(token) == 1:
                self.byte_id[token[0]] = i
        left, right, made = [], [], []
        for merge in data["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left.append(vocab[a])
            right.append(vocab[b])
            made.append(vocab[a + b])
        self.left, self.right, self.made = (np.array(x, np.int64) for x in (left, right, made))
        keys = self.left * size + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.flat = np.frombuffer(b"".join(of), np.uint8)
        self.lengths = np.array([len(x) for x in of], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 for none."""
        wanted = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.order[at], -1)

    def encode_pieces(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each piece has."""
        lengths = np.array([len(p) for p in parts], np.int64)
        symbol = self.byte_id[np.frombuffer(b"".join(parts), np.uint8)].astype(np.int32)
        n = len(symbol)
        if not n:
            return symbol, lengths
        piece = np.repeat(np.arange(len(parts), dtype=np.int32), lengths)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        last = np.cumsum(lengths)[lengths > 0] - 1
        after[last] = n  # n: no neighbour
        before[last[:-1] + 1] = n
        before[0] = n
        alive = np.ones(n + 1, bool)
        merged = np.zeros(n + 1, bool)
        merged[n] = True
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            at = at[after[at] < n]
            rank = self.ranks(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(np.diff(rank)) + 1
            bounds = [0, *cut.tolist(), len(rank)]
            for r, i, j in zip(rank[bounds[:-1]].tolist(), bounds[:-1], bounds[1:], strict=True):
                if r in index:
                    index[r].append(at[i:j])
                else:
                    index[r] = [at[i:j]]
                    heapq.heappush(heap, r)

        for start in range(0, n, NOTED):
            note(np.arange(start, min(n, start + NOTED), dtype=np.int32))
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = self.left[rank], self.right[rank]
            if a == b:
                at = np.sort(at)
            at = at[alive[at] & (symbol[at] == a)]
            nxt = after[at]
            keep = nxt < n
            keep[keep] = symbol[nxt[keep]] == b
            at = at[keep]
            if a == b and len(at) > 1:  # in a run of one symbol every second pair goes
                fresh = np.r_[True, after[at[:-1]] != at[1:]]
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbol[at] = self.made[rank]
            alive[gone] = False
            further = after[gone]
            after[at] = further
            inside = further < n
            before[further[inside]] = at[inside]
            prior = before[at]
            merged[at] = True
            prior = prior[~merged[prior]]
            note(np.concatenate((at, prior)))
            merged[at] = False
        kept = np.flatnonzero(alive[:n])
        return symbol[kept], np.bincount(piece[kept], minlength=len(parts))

    def encode(self, documents: list[str]) -> list[np.ndarray]:
        """The ids of each document; special tokens in a text are kept whole."""
        known = Numbers()
        number = known.__getitem__
        spelled: list[np.ndarray] = []
        for text in documents:
            if self.special and any(t in text for t in self.added):
                row = []
                for part in self.special.split(text):
                    if part in self.added:
                        row.append(-1 - self.added[part])
                    else:
                        row += map(number, pieces(part))
            else:
                row = list(map(number, pieces(text)))
            spelled.append(np.array(row, np.int32))
        ids, counts = self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in known])
        starts = np.cumsum(counts) - counts
        special = np.sort(np.fromiter(self.added.values(), np.int64, len(self.added)))
        ids, starts = np.concatenate((ids, special)), np.concatenate((starts, len(ids) + np.arange(len(special))))
        counts = np.concatenate((counts, np.ones(len(special), np.int64)))
        out = []
        for row in spelled:
            if len(row) and row.min() < 0:
                row = np.where(row < 0, len(known) + np.searchsorted(special, -1 - row), row)
            out.append(ids[ragged(starts[row], counts[row])] if len(row) else np.zeros(0, np.int64))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.flat[ragged(self.starts[ids], self.lengths[ids])].tobytes().decode("utf-8", "replace")


_LOADED: dict[str, Vocabulary] = {}


def load(path: str) -> Vocabulary:
    """Once for each worker process."""
    if path not in _LOADED:
        with open(path, encoding="utf-8") as f:
            _LOADED[path] = Vocabulary(f.read())
    return _LOADED[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def encode_column(docs: DataFrame, path: str | None = None, block_chars: int = BLOCK_CHARS, digest: bool = False) -> DataFrame:
    """doc_id, ids array<int>, decoded: every whole text encoded and decoded again; with ``digest``
    the SHA-256 of the decoded text in its place, made where it is decoded.

    Null and empty texts give no ids and an empty text; equal texts give equal rows; rows without
    doc_id are encoded too; an empty table gives no rows; columns other than doc_id and text are
    not read.
    """
    path = path or default_vocabulary()
    decoded = (lambda ids: sha256(load(path).decode(ids).encode()).hexdigest()) if digest else (lambda ids: load(path).decode(ids))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = load(path)
        for batch in batches:
            for part in blocks(all_texts := batch.text.tolist(), block_chars):
                ids = vocabulary.encode(all_texts[part])
                yield pd.DataFrame({"doc_id": batch.doc_id.iloc[part].to_numpy(), "named": batch.named.iloc[part].to_numpy(), "ids": [x.astype(np.int32) for x in ids], "decoded": [decoded(x) for x in ids]})
                release_memory()

    # a long with nulls would come as doubles, so nulls travel as a flag
    coded = named.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), "text").mapInPandas(run, "doc_id long, named boolean, ids array<int>, decoded string")
    return coded.select(F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "ids", "decoded")


def encoding_digest(docs: DataFrame, path: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Digests of ids and decoded texts, made where they are encoded.

    Null and empty texts have no ids; equal texts give equal values; repeated rows stay; an empty
    table gives no rows; columns other than doc_id and text are not read.
    """
    path = path or default_vocabulary()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = load(path)
        for batch in batches:
            for part in blocks(all_texts := batch.text.tolist(), block_chars):
                ids = vocabulary.encode(all_texts[part])
                yield pd.DataFrame({
                    "doc_id": batch.doc_id.iloc[part],
                    "n_tokens": [len(x) for x in ids],
                    "ids_sha256": [sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids],
                    "decoded_sha256": [sha256(vocabulary.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids],
                })
                release_memory()

    return texts(docs).mapInPandas(run, schema)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digest(read_table(spark, sf_dir, "documents"))
