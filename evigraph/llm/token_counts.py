"""Token counts by a two-tier lookup in the map task: frequent pre-tokens from a broadcast table, the rest from caches."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, worker_state
from .tokens import CACHE_LIMIT, LONGEST_KEPT, Cache, Encoder, default_path

def frequent_lengths(tokenizer_path: str | None = None, entries: int = 65_536) -> dict[str, int]:
    """Token lengths of the frequent pre-tokens: those that the vocabulary itself holds, at most ``entries``.

    A byte-pair vocabulary is the list of strings that were frequent, so no pass over the texts is needed and the table has
    the vocabulary's size, whatever the input. Each length is what the library gives. The table only saves work: a
    pre-token it lacks is encoded by the worker, with the same result.
    """
    encoder = Encoder(tokenizer_path or default_path())
    out: dict[str, int] = {}
    for i in range(encoder.tokenizer.get_vocab_size()):
        if len(out) >= entries:
            break
        piece = encoder.tokenizer.decode([i], skip_special_tokens=False)
        if piece and len(piece) <= LONGEST_KEPT and encoder.split(piece) == [piece] and piece not in encoder.special:
            out[piece] = len(encoder.tokenizer.encode(piece, add_special_tokens=False).ids)
    return out


class _Lengths(Cache):
    """Second tier: lengths of what this worker has met; its seed is the first tier."""

    made = staticmethod(len)


def token_counts(docs: DataFrame, tokenizer_path: str | None = None, limit: int = 512, entries: int = 65_536) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row; one map pass, no shuffle.

    Null texts count as empty: no bytes, no tokens. Null and repeated doc_ids stay, each row on its own; other columns
    are not read; an empty table gives no rows. Special strings in a text count as one token each. A very long text is
    counted as a whole.
    """
    path = tokenizer_path or default_path()
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(path, entries))
    key = uuid.uuid4().hex

    def _tiers():
        encoder = Encoder(path)
        return encoder, _Lengths(encoder.tokenizer, frequent.value, CACHE_LIMIT)

    def run(batches):
        encoder, tier = worker_state(("lengths", key), _tiers)
        get, split = tier.__getitem__, encoder.split
        for batch in batches:
            counts = []
            for text in batch.column(2).to_pylist():
                counts.append(sum(1 if part is None else sum(map(get, split(part))) for part, _ in encoder.pieces(text)))
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=["doc_id", "n_bytes", "n_tokens"])

    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("bigint"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
