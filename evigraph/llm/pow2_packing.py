"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded."""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, text_or_empty
from .tokens import CACHE_LIMIT, default_path, worker_encoder

PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint"


def binary_lengths(n: int, longest: int) -> list[int]:
    """The piece lengths of n tokens: as many of the longest as fit, then the binary digits of the rest."""
    out = [longest] * (n // longest)
    rest = n % longest
    out += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return out


def decompose(docs: DataFrame, tokenizer_path: str | None = None, max_length: int = 2048, end_id: int | None = 1, cache_limit: int = CACHE_LIMIT) -> DataFrame:
    """Cut each document into pieces whose lengths are powers of two, at most ``max_length``.

    Null and empty texts have the end id alone (no piece if ``end_id`` is None). Null and repeated doc_ids are kept as
    they are, each row on its own. Other columns of ``docs`` are not read. Runs in one pass without a shuffle. ``cache_limit`` bounds a worker's cache of
    pre-tokens; it changes no result.
    """
    if max_length & (max_length - 1) or max_length < 1:
        raise ValueError("max_length must be a power of two")
    path = tokenizer_path or default_path()

    def run(batches):
        encoder = worker_encoder(path, cache_limit)
        end = array("I", [end_id]).tobytes() if end_id is not None else b""
        for batch in batches:
            out = [[], [], [], [], []]
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.ids(text) + end
                n, at = len(ids) // 4, 0
                for length in binary_lengths(n, max_length):
                    for col, value in zip(out, (doc_id, at, length, ids[4 * at : 4 * (at + length)], n), strict=True):
                        col.append(value)
                    at += length
                size += len(ids)
                if size > 16_000_000:
                    yield _batch(out)
                    out, size = [[], [], [], [], []], 0
            yield _batch(out)
        give_back()

    return docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text")).mapInArrow(run, PIECES)


def _batch(cols) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens"])


def pack(docs: DataFrame, tokenizer_path: str | None = None, max_length: int = 2048, end_id: int | None = 1, cache_limit: int = CACHE_LIMIT) -> DataFrame:
    """One row for each piece, each a sequence of its own: ``sequence_id`` is unique, ``offset`` is 0.

    ``bucket`` is the binary logarithm of the length: sequences of a bucket have one shape, so batches of a bucket need
    no padding and no attention mask. The ids follow scan order, so a lost task gives the same ids again.
    """
    pieces = decompose(docs, tokenizer_path, max_length, end_id, cache_limit)
    return pieces.withColumn("bucket", F.round(F.log2("length")).cast("int")).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write the sequences in one folder for each length."""
    packed.write.partitionBy("bucket").parquet(path)
