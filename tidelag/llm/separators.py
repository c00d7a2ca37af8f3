"""Token counts by a separator scan over flat token files.

A token file is a run of unsigned integers with an end-of-document identifier after each
document and no index. It is cut into blocks of equal size wherever documents end. Each block
is searched by itself; a prefix scan over the blocks' counts and last separators then stitches
the documents that cross block boundaries.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelag.llm.common import blocks, read_table, staged, texts

END_OF_DOCUMENT = 50256
BLOCK_TOKENS = 1 << 18
ENCODE_CHARS = 4_000_000


def blocks_of_files(spark: SparkSession, path: str, itemsize: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file string, block long, tokens binary: the blocks of flat token files on any store that pyarrow opens.

    Files are listed by Spark, without their content; each task reads only its own ranges.
    """
    step = itemsize * block_tokens
    files = spark.read.format("binaryFile").load(path).select("path", "length").where(F.col("length") > 0)
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("length") - 1).cast("long"), F.lit(step).cast("long"))).alias("start"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.itertuples():
                store, name = fs.FileSystem.from_uri(row.path)
                with store.open_input_file(name) as f:
                    f.seek(row.start)
                    yield pd.DataFrame({"file": [row.path], "block": [row.start // step], "tokens": [f.read(min(step, row.length - row.start))]})

    return ranges.repartition(F.col("path"), F.col("start")).mapInPandas(read, "file string, block long, tokens binary")


def scan(parts: DataFrame, end: int = END_OF_DOCUMENT, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, ordinal, start, n_tokens of every document in blocks (file, block, tokens).

    ``n_tokens`` leaves out the separator. Tokens after the last separator of a file are its
    last document; two separators in a row hold an empty one; empty files hold none.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, block, raw in zip(batch.file, batch.block, batch.tokens, strict=True):
                tokens = np.frombuffer(raw, dtype)
                at = np.flatnonzero(tokens == end) + block * block_tokens
                rows.append((file, block, len(tokens), len(at), int(at[-1]) if len(at) else -1, at.astype("<i8").tobytes()))
            yield pd.DataFrame(rows, columns=["file", "block", "n", "n_ends", "last_end", "ends"])

    found = parts.mapInPandas(search, "file string, block long, n long, n_ends long, last_end long, ends binary")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.select(
        "file", "block", "n", "ends",
        F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("ordinal"),
        F.coalesce(F.max("last_end").over(before), F.lit(-1)).alias("previous"),
        F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull().alias("is_last"),
    )

    def stitch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ends = np.frombuffer(row.ends, "<i8")
                size = row.block * block_tokens + row.n
                if row.is_last and size > (ends[-1] if len(ends) else row.previous) + 1:
                    ends = np.r_[ends, size]
                starts = np.r_[row.previous, ends[:-1]] + 1 if len(ends) else ends
                if len(ends):
                    yield pd.DataFrame({"file": row.file, "ordinal": row.ordinal + np.arange(len(ends)), "start": starts, "n_tokens": ends - starts})

    return scanned.mapInPandas(stitch, "file string, ordinal long, start long, n_tokens long")


def tokenizer(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_table(docs: DataFrame, path: str | None = None, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Flat token streams of all documents, one for each task, and the order their documents came in."""
    import public_tokenizers

    path = path or str(public_tokenizers.path("byte_bpe_50k.tiktoken"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, file = tokenizer(path), f"tokens-{TaskContext.get().partitionId():06d}"
        rest, block, ordinal = np.zeros(0, "<u2"), 0, 0
        for batch in batches:
            for part in blocks(all_texts := batch.text.tolist(), ENCODE_CHARS):
                flat = [rest]
                for text in all_texts[part]:
                    flat.append(np.array([*coder.encode_ordinary(text), END_OF_DOCUMENT], "<u2"))
                rest = np.concatenate(flat)
                whole = len(rest) // block_tokens
                ids = batch.doc_id.iloc[part].to_numpy("<i8")
                rows = [("order", file, ordinal, ids.tobytes())]
                rows += [("tokens", file, block + i, rest[i * block_tokens : (i + 1) * block_tokens].tobytes()) for i in range(whole)]
                rest, block, ordinal = rest[whole * block_tokens :], block + whole, ordinal + len(ids)
                yield pd.DataFrame(rows, columns=["kind", "file", "at", "data"])
        if len(rest):
            yield pd.DataFrame([("tokens", file, block, rest.tobytes())], columns=["kind", "file", "at", "data"])

    both = staged(texts(docs).mapInPandas(encode, "kind string, file string, at long, data binary"), "tokens", "kind")
    tokens = both.where("kind = 'tokens'").select("file", F.col("at").alias("block"), F.col("data").alias("tokens"))

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids = np.frombuffer(row.data, "<i8")
                yield pd.DataFrame({"file": row.file, "ordinal": row.at + np.arange(len(ids)), "doc_id": ids})

    return tokens, both.where("kind = 'order'").mapInPandas(unpack, "file string, ordinal long, doc_id long")


def count_tokens(docs: DataFrame, path: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_tokens and place of every document, counted in its flat token file.

    Null and empty texts have no tokens; repeated rows are counted each; an empty table gives
    no rows; columns other than doc_id and text are not read.
    """
    tokens, order = write_token_table(docs, path, block_tokens)
    return scan(tokens, block_tokens=block_tokens).join(order, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))
