"""Hashed vectors of texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evigraph.functions.scalar import HASH_START, entity_name, fnv1a

#: Fixed value: the multiplier of the 64-bit FNV hash.
PRIME = 1099511628211
MASK = (1 << 64) - 1


def running_hash_vector(text: str, dim: int) -> list[float]:
    """Each byte's running hash picks a slot and, by its ninth bit, a sign; then unit length in 32-bit floats."""
    v, h = np.zeros(dim, np.float32), HASH_START
    for b in text.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * PRIME) & MASK
        v[h % dim] += 1 if h >> 8 & 1 else -1
    norm = np.sqrt(np.sum(v * v, dtype=np.float32))
    return (v / norm if norm > 0 else v).tolist()


def embed_bytes(text: Column, dim: int) -> Column:
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: running_hash_vector(t or "", dim))

    return run(text)


def unsigned_mod(h: Column, m: int) -> Column:
    """Remainder of a 64-bit number read as unsigned."""
    high, low = F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(4294967295))
    return (high % m * (2**32 % m) + low % m) % m


def embed_words(text: Column, dim: int) -> Column:
    """Each word's hash picks a slot and, by its low bit, a sign; then unit length."""
    words = F.filter(F.split(entity_name(text), " "), lambda w: w != "")
    marks = F.transform(words, lambda w: F.struct(unsigned_mod(fnv1a(w), dim).alias("slot"), F.when(fnv1a(w).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0).alias("sign")))

    def vector(marks):
        slots = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(marks, lambda m: m["slot"] == i), F.lit(0.0), lambda s, m: s + m["sign"]))
        unit = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return F.get(F.transform(F.array(slots), lambda v: F.transform(v, lambda x: F.when(unit(v) > 0, x / unit(v)).otherwise(0.0))), F.lit(0))

    # A lambda's argument is evaluated once, where a plain expression would be once a slot.
    return F.get(F.transform(F.array(marks), vector), F.lit(0))
