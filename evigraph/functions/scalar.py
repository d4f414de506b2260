"""Scalar functions of the data model as column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.schema import RELATIONS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values of the 64-bit string hash: its start as a signed number; the multiplier is 2^40 + 435.
HASH_START = 1469598103934665603
RFC3339 = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,9})?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$"


def clamp(x):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def bytes_of(text):
    """Byte values of a string, by its hexadecimal digits."""
    h = F.hex(F.encode(text, "UTF-8"))
    places = F.when(F.length(h) > 0, F.sequence(F.lit(0), F.shiftright(F.length(h), 1) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))


def fnv1a(text):
    """The 64-bit hash of a string's bytes as a signed number; no step overflows."""
    low = F.lit(4294967295)

    def step(h, b):
        x = h.bitwiseXOR(b)
        part = x.bitwiseAND(low) * 435
        high = (F.shiftrightunsigned(x, 32) * 435 + F.shiftrightunsigned(part, 32) + F.shiftleft(x.bitwiseAND(F.lit(16777215)), 8)).bitwiseAND(low)
        return F.shiftleft(high, 32).bitwiseOR(part.bitwiseAND(low))

    return F.aggregate(bytes_of(text), F.lit(HASH_START).cast("bigint"), step)


def normalised(text, gap: str):
    """ASCII letters and digits in lower case, runs of anything else as one gap, none at the ends."""
    x = F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", gap)
    return F.regexp_replace(x, f"^{gap}|{gap}$", "")


def entity_name(text):
    return normalised(text, " ")


def relation_name(text):
    return normalised(text, "_")


def tokens(text):
    return F.array_distinct(F.filter(F.split(entity_name(text), " "), lambda w: w != ""))


def jaccard(a, b):
    """Overlap of two token sets; 0 where both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(0.0)


def canonical_relation(name):
    """The core relation of a predicate or alias, else null."""
    pairs = [(alias, rel) for rel, (aliases, _, _) in RELATIONS.items() for alias in (rel, *aliases)]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return table[relation_name(name)]


def rfc3339(text):
    """Microsecond instant of a strict timestamp text, else null; finer digits are cut off."""
    fit = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    return F.when(text.rlike(RFC3339) & ~text.startswith("0000"), F.try_to_timestamp(fit))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b):
    """-1 where sizes differ or a norm is 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(-1.0)


def hex_spiral(i):
    """(q, r) of place i on the walk ring by ring: ring k has 6k cells from (k, 0) on."""
    ring = F.when(i == 0, 0).otherwise(F.ceil((F.sqrt(12.0 * i + 9) - 3) / 6)).cast("bigint")
    off = i - 1 - 3 * ring * (ring - 1)
    side = F.when(i == 0, F.lit(0)).otherwise(F.floor(off / F.greatest(ring, F.lit(1)))).cast("bigint")
    step = off - side * ring
    # Corners where each side starts and the direction it walks.
    starts = [(1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)]
    moves = [(0, -1), (-1, 0), (-1, 1), (0, 1), (1, 0), (1, -1)]
    at = lambda values, s: F.element_at(F.array(*map(F.lit, values)), (F.least(s, F.lit(5)) + 1).cast("int"))
    q = at([x[0] for x in starts], side) * ring + at([x[0] for x in moves], side) * step
    r = at([x[1] for x in starts], side) * ring + at([x[1] for x in moves], side) * step
    zero = F.lit(0).cast("bigint")
    return F.when(i == 0, zero).otherwise(q), F.when(i == 0, zero).otherwise(r)


def hex_distance(q1, r1, q2, r2):
    dq, dr = q1 - q2, r1 - r2
    return F.greatest(F.abs(dq), F.abs(dr), F.abs(dq + dr))


def disk_ordinal(q, r, radius: int):
    """Row-major place of a cell in the disk of a radius, null outside: rows by r, then q; row r has 2R + 1 - |r| cells."""
    rad = F.lit(radius)
    inside = F.greatest(F.abs(q), F.abs(r), F.abs(q + r)) <= rad
    k = r + rad  # rows above
    up = F.least(k, rad)
    above = up * (rad + 1) + F.floor(up * (up - 1) / 2) + F.when(k > rad, (k - rad) * (2 * rad + 1) - F.floor((k - rad) * (k - rad - 1) / 2)).otherwise(0)
    return F.when(inside, (above + q - F.greatest(-rad, -rad - r)).cast("bigint"))


def matches_plane(signature, query):
    """At least all but one of the query's bits; an empty query matches nothing."""
    need = F.greatest(F.lit(1), F.bit_count(query) - 1)
    return F.bit_count(signature.bitwiseAND(query)) >= need


def matches_signature(signature, query):
    """The same, but an empty query or signature matches all."""
    return (query == 0) | (signature == 0) | matches_plane(signature, query)


def mode_core(origin, role, mode: str):
    if mode == "empirical":
        return origin.isin("observed", "discovered") & (role != "analogical")
    return origin != "hypothetical" if mode == "balanced" else F.lit(True)


def mode_expand(origin, role, derivation, mode: str):
    core = mode_core(origin, role, mode)
    return core & ((role != "compressed") | (F.coalesce(derivation, F.lit("")) != "")) if mode == "empirical" else core


def mode_http(origin, mode: str):
    if mode == "empirical":
        return origin.isin("observed", "discovered")
    return F.lit(True) if mode in ("exploratory", "theoretical") else origin != "hypothetical"


def search_allowed(origin, role, derivation, lifecycle, mode: str):
    return lifecycle.isin("active", "refuted") & mode_expand(origin, role, derivation, mode)


def lower_deficit(target, actual):
    return F.when(target > 0, F.greatest(F.lit(0.0), (target - actual) / target)).otherwise(0.0)


def upper_excess(actual, most):
    return F.when(most < 1, F.greatest(F.lit(0.0), (actual - most) / (1 - most))).otherwise(0.0)
