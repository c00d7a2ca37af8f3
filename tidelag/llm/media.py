"""Media columns: texts as payload of MPEG audio, read back with durations and seek offsets."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.llm.common import blocks, read_table, release_memory, texts
from tidelag.llm.mpeg import read_stream, write_stream

#: Characters of text whose streams a task holds at once; a longer text is held alone.
BLOCK_CHARS = 1_000_000
MEDIA_SCHEMA = (
    "doc_id long, n_bytes long, payload binary, media binary, frames long, seconds double, "
    "seek_offsets array<long>, bad_crc long, skipped_bytes long"
)


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 if data else 64)


def media_columns(docs: DataFrame) -> DataFrame:
    """One stream for each document, with what a reader finds in it.

    Null and empty texts give 64 zero bytes; repeated rows give equal rows; an empty table
    gives no rows; columns other than doc_id and text are not read.
    """

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in streams(batches):
            columns = [(doc_id, n, x.payload, media, len(x.offsets), x.seconds, x.offsets, x.bad_crc, x.skipped) for doc_id, n, media, x in rows]
            yield pd.DataFrame(columns, columns=[c.split()[0] for c in MEDIA_SCHEMA.split(", ")])

    return texts(docs).mapInPandas(convert, MEDIA_SCHEMA)


def streams(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple[int, int, bytes, Stream]]]:
    """(doc_id, bytes of text, stored stream, what a reader finds in it) of about ``BLOCK_CHARS`` characters at a time."""
    for batch in batches:
        for part in blocks(all_texts := batch.text.tolist(), BLOCK_CHARS):
            rows = []
            for doc_id, text in zip(batch.doc_id.iloc[part].tolist(), all_texts[part], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                media = write_stream(pad(raw))
                rows.append((doc_id, len(raw), media, read_stream(media)))
            yield rows
            release_memory()


def media_digest(docs: DataFrame) -> DataFrame:
    """Digests and features of every document's stored stream, made where it is stored and read back.

    Null and empty texts give 64 zero bytes; equal texts give equal values; repeated rows stay;
    an empty table gives no rows; columns other than doc_id and text are not read.
    """
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string"
    )

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in streams(batches):
            out = [
                (doc_id, n, len(x.payload), sha256(x.payload).hexdigest(), zlib.crc32(x.payload[-64:]), len(media), sha256(media).hexdigest(), feature(x))
                for doc_id, n, media, x in rows
            ]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return texts(docs).mapInPandas(digest, schema)


def feature(found: Stream) -> str:
    """Frames, exact duration, a checksum of the seek offsets, and the entropy of the payload's bytes."""
    seek = zlib.crc32(np.asarray(found.offsets, "<i8").tobytes())
    counts = np.bincount(np.frombuffer(found.payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(found.payload)
    entropy = float(-(share * np.log2(share)).sum()) + 0.0
    return f"frames={len(found.offsets)};seconds={found.seconds:.3f};seek={seek:08x};entropy={entropy:.4f}"


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", F.col("tail_crc32"), "media_bytes", "media_sha256", "feature"
    )
