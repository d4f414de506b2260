"""Token-id output: best-fit-decreasing packing with a segment tree over the free capacities."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .tokens import default_path, worker_encoder

SEQUENCES = "input_ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<bigint>, starts array<bigint>"


class CapacityTree:
    """Free bins by capacity; the least capacity that holds a piece is found by descent through a segment tree."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: dict[int, list[int]] = {}

    def add(self, capacity: int, bin_: int) -> None:
        self.bins.setdefault(capacity, []).append(bin_)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, bin) with the least capacity of at least ``need``."""
        node, count = need + self.size, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.size
        bin_ = self.bins[capacity].pop()
        self._change(capacity, -1)
        return capacity, bin_


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of indices; longest pieces first, equal lengths in input order."""
    tree, bins = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            bins.append([i])
            free, b = capacity - lengths[i], len(bins) - 1
        else:
            free, b = found[0] - lengths[i], found[1]
            bins[b].append(i)
        if free:
            tree.add(free, b)
    return bins


def pack(docs: DataFrame, tokenizer_path: str | None = None, max_length: int = 2048, end_id: int = 50256, pad_id: int = 50256, window_tokens: int = 4_000_000) -> DataFrame:
    """Pack documents into rows of ``max_length`` ids, without loss.

    A document is its ids and ``end_id``; one of more than ``max_length`` ids is cut into full rows and a rest. Pieces are
    packed within windows of ``window_tokens`` tokens of a task, so memory is bounded whatever the input. A row has the
    id matrix row (little-endian uint16, or uint32 for larger vocabularies, padded with ``pad_id``), the cumulative
    segment lengths from 0, the offsets where positions start again at 0, and each segment's document and first token.
    Null texts count as empty (the end id alone); null and repeated doc_ids stay; an empty table gives no rows.
    """
    path = tokenizer_path or default_path()

    def flush(pieces):
        bins = best_fit_decreasing([len(p[2]) // 4 for p in pieces], max_length)
        rows = [[], [], [], [], [], []]
        for members in bins:
            segs = [pieces[i] for i in members]
            ids = np.frombuffer(b"".join(s[2] for s in segs), "<u4")
            cu = np.concatenate([[0], np.cumsum([len(s[2]) // 4 for s in segs])]).astype(int).tolist()
            row = np.full(max_length, pad_id, dtype="<u4" if wide else "<u2")
            row[: len(ids)] = ids
            for col, v in zip(rows, (row.tobytes(), len(ids), cu, cu[:-1], [s[0] for s in segs], [s[1] for s in segs]), strict=True):
                col.append(v)
            if len(rows[0]) >= 2000:
                yield _batch(rows)
                rows = [[], [], [], [], [], []]
        yield _batch(rows)

    wide = False

    def run(batches):
        nonlocal wide
        encoder = worker_encoder(path)
        wide = max(encoder.tokenizer.get_vocab_size(), end_id, pad_id) > 65535
        end = array("I", [end_id]).tobytes()
        pieces, tokens = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.ids(text) + end
                for at in range(0, len(ids), 4 * max_length):
                    pieces.append((doc_id, at // 4, ids[at : at + 4 * max_length]))
                tokens += len(ids) // 4
                if tokens >= window_tokens:
                    yield from flush(pieces)
                    pieces, tokens = [], 0
        if pieces:
            yield from flush(pieces)

    rows = docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text")).mapInArrow(run, SEQUENCES)
    return rows.withColumn("sequence_id", F.monotonically_increasing_id())


def _batch(cols) -> pa.RecordBatch:
    types = (pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = ["input_ids", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "starts"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def position_ids(cu_seqlens: list[int], max_length: int = 2048) -> np.ndarray:
    """Positions of a row: they start again at 0 with each segment; the padding counts as one more segment."""
    out = np.arange(max_length)
    for a, b in zip(cu_seqlens, [*cu_seqlens[1:], max_length], strict=True):
        out[a:b] = np.arange(b - a)
    return out
