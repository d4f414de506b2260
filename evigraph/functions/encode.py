"""Vector codes that depend on the vector before, 16-bit floats, and segments of rows with a dictionary and short numbers."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F


def predictive_codes(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(codes, decoded, exceptions): 8-bit residuals against the vector decoded before, those out of range kept exactly."""
    values = block.astype(np.float64)
    raw = np.abs(np.diff(values, axis=0, prepend=np.zeros((1, values.shape[1]))))
    scale = float(np.float32(max(np.quantile(raw, 0.99) / 127, 1e-30)))
    before, codes, decoded = np.zeros(values.shape[1]), np.zeros(values.shape, np.int16), np.zeros_like(values)
    for k, v in enumerate(values):
        q = np.rint((v - before) / scale)
        wide = np.abs(q) > 127
        before = np.where(wide, v, (before + scale * q).astype(np.float32))
        codes[k], decoded[k] = np.where(wide, -128, q), before
    return codes, decoded, int((codes == -128).sum())


def half(x):
    """A number as the nearest 16-bit float, ties to even: eleven significant bits, steps of 2^-24 near zero."""
    size = F.abs(x)
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)), F.lit(-14)) - 10)
    near = F.rint(size / step) * step
    return F.when(size == 0, x * 1.0).when(F.isnan(x), x).otherwise(F.signum(x) * F.when(near >= 65520, F.lit(float("inf"))).otherwise(near))


def varint(out: bytearray, value: int) -> None:
    """Seven bits a byte, low ones first; the top bit says that more follow."""
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)


def signed(value: int) -> int:
    """Numbers of small size as small ones: 0, -1, 1, -2 ... as 0, 1, 2, 3 ..."""
    return 2 * value if value >= 0 else -2 * value - 1


def unsigned(value: int) -> int:
    return value // 2 if value % 2 == 0 else -(value // 2) - 1


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self) -> int:
        value = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    def text(self) -> str:
        n = self.number()
        self.at += n
        return self.data[self.at - n : self.at].decode()


def pack_segment(rows: list[tuple[int, int, str, dict[str, str]]]) -> bytes:
    """Rows (id, signature, content, metadata) in order of id as one segment: a sorted dictionary of the metadata's keys and
    values, then each row with the difference of its id; length and checksum in front."""
    words = sorted({w for _, _, _, m in rows for pair in m.items() for w in pair})
    place = {w: i for i, w in enumerate(words)}
    out, last = bytearray(), 0
    varint(out, len(words))
    for w in words:
        raw = w.encode()
        varint(out, len(raw))
        out += raw
    varint(out, len(rows))
    for i, signature, content, m in rows:
        varint(out, signed(i - last))
        varint(out, signature & 0xFFFFFFFFFFFFFFFF)
        raw = content.encode()
        varint(out, len(raw))
        out += raw
        varint(out, len(m))
        for k in sorted(m):
            varint(out, place[k])
            varint(out, place[m[k]])
        last = i
    return len(out).to_bytes(8, "little") + zlib.crc32(out).to_bytes(4, "little") + bytes(out)


def unpack_segment(data: bytes) -> list[tuple[int, int, str, dict[str, str]]]:
    """The rows of a segment; one that was cut or changed raises."""
    body = data[12:]
    if len(body) != int.from_bytes(data[:8], "little") or zlib.crc32(body) != int.from_bytes(data[8:12], "little"):
        raise ValueError("segment is damaged")
    r, out, last = Reader(body), [], 0
    words = [r.text() for _ in range(r.number())]
    for _ in range(r.number()):
        last += unsigned(r.number())
        signature = r.number()
        content = r.text()
        m = {words[r.number()]: words[r.number()] for _ in range(r.number())}
        out.append((last, signature - (1 << 64) if signature >> 63 else signature, content, m))
    return out
