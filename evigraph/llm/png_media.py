"""Media columns: texts as PNG images in binary columns, read back with checksum tests, and cosine-transform hashes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}

ROW_BYTES = 192  # 64 pixels of 3 samples
BLANK = b" "


def payload(data: bytes, multiple: int = ROW_BYTES) -> bytes:
    """The bytes with blanks appended up to a positive multiple."""
    return data.ljust(max(1, -(-len(data) // multiple)) * multiple, BLANK)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(data: bytes, width: int = 64, channels: int = 3, level: int = 3) -> bytes:
    """8-bit samples, row by row; each row takes the filter (none, sub or up) of least absolute sum, ties in this order."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, width * channels)
    sub, up = rows.copy(), rows.copy()
    sub[:, channels:] -= rows[:, :-channels]
    up[1:] -= rows[:-1]
    choices = np.stack([rows, sub, up])
    cost = np.abs(choices.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    out = np.empty((len(rows), width * channels + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = choices[best, np.arange(len(rows))]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(out.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(png: bytes) -> tuple[np.ndarray, int]:
    """Samples (rows x bytes of a row) and channels of an 8-bit PNG without interlacing; ValueError where a test fails."""
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, body, ended = 8, None, [], False
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("a chunk is cut off")
        n, kind = struct.unpack_from(">I4s", png, at)
        part = png[at + 8 : at + 8 + n]
        if len(part) != n or at + 12 + n > len(png) or struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(kind + part):
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            ended = True
        at += 12 + n
    if head is None or not ended or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("not an 8-bit PNG without interlacing")
    channels = CHANNELS[head[3]]
    stride = head[0] * channels
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if raw.size != head[1] * (stride + 1):
        raise ValueError("the image data has another size")
    return unfilter(raw.reshape(head[1], stride + 1), channels), channels


def unfilter(raw: np.ndarray, channels: int) -> np.ndarray:
    kinds, out = raw[:, 0], raw[:, 1:].copy()
    zero = np.zeros(out.shape[1], np.uint8)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *edges], [*edges, len(kinds)], strict=True):  # runs of one filter
        if a == b:
            continue
        kind, above = kinds[a], out[a - 1] if a else zero
        if kind == SUB:
            part = out[a:b].reshape(b - a, -1, channels)
            out[a:b] = np.cumsum(part, axis=1, dtype=np.uint8).reshape(b - a, -1)
        elif kind == UP:
            out[a] += above
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif kind in (AVERAGE, PAETH):
            for i in range(a, b):
                _sequential(out[i], out[i - 1] if i else zero, channels, kind)
        elif kind != NONE:
            raise ValueError(f"filter {kind}")
    return out


def _sequential(row: np.ndarray, above: np.ndarray, channels: int, kind: int) -> None:
    left = np.zeros(channels, np.int16)
    corner = np.zeros(channels, np.int16)
    for x in range(0, len(row), channels):
        up = above[x : x + channels].astype(np.int16)
        if kind == AVERAGE:
            guess = (left + up) >> 1
        else:
            p = left + up - corner
            a, b, c = abs(p - left), abs(p - up), abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        row[x : x + channels] += guess.astype(np.uint8)
        left, corner = row[x : x + channels].astype(np.int16), up


def _cosines(n: int = 32, k: int = 8) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5)[None, :] * np.arange(k)[:, None])


COSINES = _cosines()


def _shrunk(grey: np.ndarray, n: int) -> np.ndarray:
    """Means over n bands of the first axis; bands of an axis shorter than n repeat its entries."""
    h = grey.shape[0]
    if h <= n:
        return grey[np.arange(n) * h // n]
    at = np.arange(n) * h // n
    return np.add.reduceat(grey, at, axis=0) / np.diff([*at, h])[:, None]


def cosine_hash(samples: np.ndarray, channels: int) -> str:
    """16 hexadecimal digits: which of the 8 x 8 lowest cosine frequencies of the 32 x 32 grey image exceed their median."""
    grey = samples.reshape(len(samples), -1, channels).mean(axis=2)
    small = _shrunk(_shrunk(grey, 32).T, 32).T
    low = np.round(COSINES @ small @ COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def to_media(docs: DataFrame, level: int = 3) -> DataFrame:
    """doc_id, n_bytes and ``media``, the PNG of the text's padded UTF-8 bytes. Null texts count as empty (one blank row).

    Null and repeated doc_ids stay, each row on its own; other columns are not read; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                data = part.column(1).cast(pa.binary()).to_pylist()
                media = pa.array([encode_png(payload(d), level=level) for d in data], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(d) for d in data], pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text")).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Read the stored images back: adds payload and feature (null with ``error`` set where a stored image fails its tests)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                payloads, features, errors = [], [], []
                for png in part.column(2).to_pylist():
                    try:
                        samples, channels = decode_png(png or b"")
                        row = samples.tobytes(), cosine_hash(samples, channels), None
                    except (ValueError, zlib.error) as e:
                        row = None, None, str(e)
                    for col, v in zip((payloads, features, errors), row, strict=True):
                        col.append(v)
                cols = [*part.columns, pa.array(payloads, pa.binary()), pa.array(features, pa.string()), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "media", "payload", "feature", "error"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary, payload binary, feature string, error string")
