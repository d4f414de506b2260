"""Exact substring removal by sorted suffixes.

Every string of ``least`` bytes has one anchor: the leftmost place of least hash among the ``GRAM``-byte strings in it. It
depends on the string alone, so equal strings have equal anchors at equal offsets, and only suffixes that start at anchors
need sorting (about two in ``least - GRAM`` bytes). Suffixes whose first GRAM bytes occur once drop out in a count; equal
neighbourhoods collapse to one. The others are range-partitioned by their leading bytes at sampled splitters, sorted in
their bucket by multikey quicksort, and common lengths to the right and, in the same way, to the left of the anchors give
the strings that occur elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, grouped, materialize, slices, text_or_empty
from .parity_join import MIX2, ODD, mix

LEAST = 400
#: Bytes of the strings that a second, finer look judges (passages of fifty words have some 250), and of anchor strings.
SHORT, GRAM = 240, 32
#: Neighbourhoods of one anchor string that are compared in memory (some 50 MB); beyond, hashes of their strings are counted instead.
MOST_IN_MEMORY = 50_000
#: Groups up to this size are compared by a matrix of common lengths.
SMALL_GROUP = 48
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as long as the longest text met."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            size = 1 << n.bit_length()
            self.up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, BASE)])
            self.down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, inverse)])
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = POWERS(len(data) + 1)
    return np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)]


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], by content."""
    _, down = POWERS(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * ODD)


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """The leftmost place of the least value in each window, from running minima of blocks, once for each place."""
    n = len(h)
    # Ties: the high 32 bits of the hash decide, then the place.
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    size = -(-n // width) * width
    padded = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    block = padded.reshape(-1, width)
    left = np.minimum.accumulate(block, axis=1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    best = np.minimum(right[:m], left[width - 1 : width - 1 + m])
    at = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at[np.r_[True, at[1:] != at[:-1]]]


def anchors(data: bytes, levels: tuple[int, ...] = (LEAST,), gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes of the gram there, and hashes of the whole neighbourhood (up to least bytes right, least - 1 left, of
    the longest level); every string of the shortest level has an anchor."""
    least, short = max(levels), min(levels)
    raw = np.frombuffer(data, np.uint8)
    if len(raw) < short:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sums = prefix_sums(raw)
    m = len(raw) - gram + 1
    _, down = POWERS(len(sums))
    h = mix((sums[gram:] - sums[:-gram]) * down[:m])
    at = sliding_argmin(h, short - gram + 1)
    a, b = np.maximum(at - (least - 1), 0), np.minimum(at + least, len(raw))
    around = mix(span_hashes(sums, a, b) + mix((at - a).astype(np.uint64) ^ MIX2))
    return at, h[at], around


def multikey_quicksort(rows: list[bytes]) -> list[int]:
    """The order of byte strings; a shorter one comes before those it begins. Characters are runs of 8 bytes."""
    order: list[int] = []
    stack = [(list(range(len(rows))), 0)]
    while stack:
        part, depth = stack.pop()
        if len(part) <= 1:
            order += part
            continue
        char = {i: rows[i][depth : depth + 8] for i in part}
        pivot = char[part[len(part) // 2]]
        less = [i for i in part if char[i] < pivot]
        same = [i for i in part if char[i] == pivot]
        more = [i for i in part if char[i] > pivot]
        if more:
            stack.append((more, depth))
        if len(pivot) < 8:  # ended: equal strings
            stack += [([i], depth) for i in reversed(same)]
        else:
            stack.append((same, depth + 8))
        if less:
            stack.append((less, depth))
    return order


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = int.from_bytes(a[:n], "big"), int.from_bytes(b[:n], "big")
    return n - ((x ^ y).bit_length() + 7) // 8


def neighbours_common(rows: list[bytes], order: list[int]) -> np.ndarray:
    """Common prefix lengths of neighbours in sorted order."""
    return np.array([common_prefix(rows[a], rows[b]) for a, b in zip(order[:-1], order[1:], strict=True)], np.int32)


def pairwise_common(rows: list[bytes]) -> np.ndarray:
    """Common prefix lengths of all rows: minima of those of neighbours in sorted order."""
    order = multikey_quicksort(rows)
    g = len(rows)
    next_ = neighbours_common(rows, order)
    out = np.zeros((g, g), np.int32)
    for i in range(g - 1):
        out[i, i + 1 :] = np.minimum.accumulate(next_[i:])
    out = np.maximum(out, out.T)
    back = np.empty(g, np.int64)
    back[order] = np.arange(g)
    return out[np.ix_(back, back)]


class RangeMinimum:
    """Minima of spans of an array, from minima of spans whose lengths are powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minima of values[a:b], b > a."""
        k = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int32)
        for level in np.unique(k):
            at, v = np.flatnonzero(k == level), self.levels[level]
            out[at] = np.minimum(v[a[at]], v[b[at] - (1 << level)])
        return out


def extents(left: list[bytes], right: list[bytes], levels: tuple[int, ...] = (LEAST,)) -> np.ndarray:
    """For each neighbourhood and each length of ``levels``, how far bytes left and right of its anchor lie in strings of
    that length that another neighbourhood has too: columns lo, hi for each level.

    ``left`` is reversed. Strings of ``least`` bytes around two anchors are equal where l + r >= least of their common
    lengths; all of them hold the anchor, so the farthest ends bound what they cover.
    """
    g = len(left)
    out = np.zeros((g, 2 * len(levels)), np.int32)
    if g == 1:
        return out
    if g == 2:
        l, r = common_prefix(left[0], left[1]), common_prefix(right[0], right[1])
        for k, least in enumerate(levels):
            if l + r >= least:
                out[:, 2 * k : 2 * k + 2] = l, r
        return out
    if g <= SMALL_GROUP:
        l, r = pairwise_common(left), pairwise_common(right)
        for k, least in enumerate(levels):
            hit = l + r >= least
            np.fill_diagonal(hit, False)
            out[:, 2 * k], out[:, 2 * k + 1] = np.where(hit, l, 0).max(axis=1), np.where(hit, r, 0).max(axis=1)
        return out
    # Suffixes with at least r bytes in common are runs of the sorted order. Within a run, the longest common length to
    # the left is that of neighbours in the left order. Each length r that occurs is tried once.
    order, by_left = multikey_quicksort(right), multikey_quicksort(left)
    r_next, l_least = neighbours_common(right, order), RangeMinimum(neighbours_common(left, by_left))
    rank = np.empty(g, np.int64)
    rank[by_left] = np.arange(g)
    rank = rank[order]
    far = np.zeros((g, 2 * len(levels)), np.int32)
    for r in np.unique(r_next):
        run = np.r_[0, np.cumsum(r_next < r)]
        at = np.lexsort((rank, run))
        same = run[at[1:]] == run[at[:-1]]
        one, two = at[:-1][same], at[1:][same]
        if not len(one):
            continue
        l = l_least(rank[one], rank[two])
        for k, least in enumerate(levels):
            hit = l + r >= least
            for x in (one[hit], two[hit]):
                np.maximum.at(far[:, 2 * k], x, l[hit])
                far[x, 2 * k + 1] = np.maximum(far[x, 2 * k + 1], r)
    out[order] = far
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts with the key of their content; equal texts are one in what follows."""
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tk"), F.xxhash64(text, F.lit(1)).alias("tk2"))


def _anchor_rows(keyed: DataFrame, levels: tuple[int, ...], gram: int) -> DataFrame:
    """(kh, ch, tk, tk2, doc_id, pos, cnt, size): anchors; cnt counts equal texts that a batch holds, size is theirs."""

    def run(batches):
        for batch in slices(batches):
            met: dict[tuple, list] = {}
            for i, key in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                met.setdefault(key, []).append(i)
            texts, ids = batch.column(1).cast(pa.binary()), batch.column(0).to_pylist()
            out, size = [], 0
            for key, rows in met.items():
                data = texts[rows[0]].as_py()
                at, kh, ch = anchors(data, levels, gram)
                if not len(at):
                    continue
                doc = min((ids[i] for i in rows if ids[i] is not None), default=None)
                out.append((kh, ch, key, doc, at, len(rows), len(data)))
                size += len(at)
                if size > 100_000:
                    yield _anchor_batch(out)
                    out, size = [], 0
            if out:
                yield _anchor_batch(out)

    return keyed.select("doc_id", "text", "tk", "tk2").mapInArrow(run, "kh bigint, ch bigint, tk bigint, tk2 bigint, doc_id bigint, pos int, cnt bigint, size bigint")


def _anchor_batch(out) -> pa.RecordBatch:
    n = [len(x[4]) for x in out]
    wide = lambda values, t: pa.array(np.repeat(np.array(values, np.int64), n), t)
    doc = pa.array(np.repeat(np.array([x[3] or 0 for x in out], np.int64), n), pa.int64(), mask=np.repeat(np.array([x[3] is None for x in out]), n))
    cols = [
        pa.array(np.concatenate([x[0] for x in out]).view(np.int64)),
        pa.array(np.concatenate([x[1] for x in out]).view(np.int64)),
        wide([x[2][0] for x in out], pa.int64()),
        wide([x[2][1] for x in out], pa.int64()),
        doc,
        pa.array(np.concatenate([x[4] for x in out]).astype(np.int32)),
        wide([x[5] for x in out], pa.int64()),
        wide([x[6] for x in out], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["kh", "ch", "tk", "tk2", "doc_id", "pos", "cnt", "size"])


def _contexts(reps: DataFrame, keyed: DataFrame, least: int) -> DataFrame:
    """(kh, ch, g, lft reversed, rgt) of the chosen places; each is read from one text."""
    wanted = reps.groupBy("tk", "tk2", "doc_id").agg(F.collect_list(F.struct("kh", "ch", "g", "pos")).alias("at"))  # within one text
    k = keyed.alias("k")
    joined = wanted.alias("w").join(k, (F.col("w.tk") == F.col("k.tk")) & (F.col("w.tk2") == F.col("k.tk2")) & F.col("w.doc_id").eqNullSafe(F.col("k.doc_id"))).select("k.text", "w.at")

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            texts = batch.column(0).cast(pa.binary())
            for i, at in enumerate(batch.column(1).to_pylist()):
                data = texts[i].as_py()
                for x in at:
                    p = x["pos"]
                    rows.append((x["kh"], x["ch"], x["g"], data[max(0, p - least + 1) : p][::-1], data[p : p + least]))
                size += len(at)
                if size > 10_000:
                    yield _context_batch(rows)
                    rows, size = [], 0
            if rows:
                yield _context_batch(rows)

    return joined.mapInArrow(run, "kh bigint, ch bigint, g bigint, lft binary, rgt binary").dropDuplicates(["kh", "ch"])


def _context_batch(rows) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["kh", "ch", "g", "lft", "rgt"])


def _extent_columns(levels: tuple[int, ...]) -> list[str]:
    return [f"{side}{k}" for k in range(len(levels)) for side in ("lo", "hi")]


def _extent_schema(levels: tuple[int, ...]) -> str:
    return "kh bigint, ch bigint, " + ", ".join(f"{c} int" for c in _extent_columns(levels))


def _sorted_extents(contexts: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """Extents of the neighbourhoods that share an anchor string, bucket by bucket of the suffix order.

    Splitters are sampled from the leading bytes; suffixes that begin alike never part, so nothing crosses a boundary.
    """
    n = max(1, int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The leading bytes of a suffix are its anchor string; kh is that string's hash and keeps strings apart in the bucket.
    parts = contexts.repartitionByRange(n, F.substring("rgt", 1, 16), F.col("kh")).sortWithinPartitions("kh")
    names = ["kh", "ch", *_extent_columns(levels)]

    def run(batches):
        def rows():
            far = np.concatenate([o[2] for o in out])
            cols = [pa.array(np.concatenate([o[k] for o in out])) for k in (0, 1)] + [pa.array(far[:, k]) for k in range(far.shape[1])]
            return pa.RecordBatch.from_arrays(cols, names=names)

        out, size = [], 0
        for (kh,), t in grouped(batches, ["kh"]):
            far = extents(t.column("lft").to_pylist(), t.column("rgt").to_pylist(), levels)
            out.append((np.full(t.num_rows, kh, np.int64), t.column("ch").to_numpy(), far))
            size += t.num_rows
            if size > 20_000:
                yield rows()
                out, size = [], 0
        if out:
            yield rows()

    return parts.mapInArrow(run, _extent_schema(levels))


def _counted_extents(contexts: DataFrame, levels: tuple[int, ...], gram: int) -> DataFrame:
    """The same for anchor strings with very many neighbourhoods: count the hashes of all their strings of each length."""

    def run(batches):
        for batch in batches:
            kh, ch = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, (left, right) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                data = np.frombuffer(left[::-1] + right, np.uint8)
                sums = prefix_sums(data)
                for level, least in enumerate(levels):
                    off = np.arange(max(0, least - len(right)), min(len(left), least - gram) + 1)
                    if not len(off):
                        continue
                    start = len(left) - off
                    h = mix(span_hashes(sums, start, start + least) + off.astype(np.uint64) * MIX2)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(off), kh[i])), pa.array(np.full(len(off), ch[i])), pa.array(off.astype(np.int32)), pa.array(np.full(len(off), level, np.int32))], names=["h", "kh", "ch", "off", "level"])

    rows = contexts.mapInArrow(run, "h bigint, kh bigint, ch bigint, off int, level int")
    twice = rows.groupBy("h", "level").agg(F.min("ch").alias("c1"), F.max("ch").alias("c2")).filter("c1 <> c2").select("h", "level")
    at = lambda k, v: F.when(F.col("level") == k, v)
    ends = [f for k, least in enumerate(levels) for f in (F.coalesce(F.max(at(k, F.col("off"))), F.lit(0)).alias(f"lo{k}"), F.coalesce(F.lit(least) - F.min(at(k, F.col("off"))), F.lit(0)).cast("int").alias(f"hi{k}"))]
    return rows.join(twice, ["h", "level"]).groupBy("kh", "ch").agg(*ends)


def repeated_spans(docs: DataFrame, levels: tuple[int, ...] = (LEAST,), gram: int = GRAM, most_in_memory: int = MOST_IN_MEMORY) -> DataFrame:
    """(tk, tk2, spans): for each distinct text with any, the places (start0, end0, ...) of bytes in repeated strings of each
    level, in order; one that is empty has end 0.

    tk, tk2 name a text by its content: xxhash64(text), xxhash64(text, 1).
    """
    keyed = _keyed(docs)
    least = max(levels)
    found = materialize(_anchor_rows(keyed, levels, gram))
    # Counts in a table of their own, so that the join below may split a string that very many texts share.
    often = materialize(found.groupBy("kh").agg(F.sum("cnt").alias("all_cnt")).filter("all_cnt > 1").select("kh"))
    everything, found = found, materialize(found.join(often, "kh", "left_semi"))
    discard(everything, often)
    classes = found.groupBy("kh", "ch").agg(F.sum("cnt").alias("cnt"), F.max("size").alias("size"), F.min(F.struct("tk", "tk2", "pos", "doc_id")).alias("rep"))
    classes = materialize(classes)
    groups = materialize(classes.groupBy("kh").agg(F.count("*").alias("g")).filter("g > 1"))
    reps = classes.join(groups, "kh").select("kh", "ch", "g", "rep.*")
    contexts = materialize(_contexts(reps, keyed, least))
    discard(groups)
    spans = _sorted_extents(contexts.filter(F.col("g") <= most_in_memory).select("kh", "ch", "lft", "rgt"), levels)
    if not contexts.filter(F.col("g") > most_in_memory).isEmpty():
        spans = spans.unionByName(_counted_extents(contexts.filter(F.col("g") > most_in_memory).select("kh", "ch", "lft", "rgt"), levels, gram))
    last = len(levels) - 1
    spans = materialize(spans.filter(" OR ".join(f"hi{k} > 0" for k in range(len(levels)))))
    discard(contexts)
    # A neighbourhood that occurs twice is repeated as a whole, as far as the text goes, if the text holds such a string.
    whole = classes.filter("cnt > 1").select("kh", "ch", "size")
    both = spans.join(whole, ["kh", "ch"], "full")
    ends = []
    for k, n in enumerate(levels):
        fits = F.coalesce(F.col("size") >= n, F.lit(False))
        ends += [F.when(fits, least - 1).otherwise(F.coalesce(f"lo{k}", F.lit(0))).alias(f"lo{k}"), F.when(fits, least).otherwise(F.coalesce(f"hi{k}", F.lit(0))).alias(f"hi{k}")]
    decided = materialize(both.select("kh", "ch", *ends).filter(f"hi{last} > 0"))
    places = found.groupBy("tk", "tk2", "pos", "kh", "ch").agg(F.count("*").alias("n")).join(decided, ["kh", "ch"])
    pieces = []
    for k in range(len(levels)):
        there = F.col(f"hi{k}") > 0
        pieces += [F.when(there, F.greatest(F.col("pos") - F.col(f"lo{k}"), F.lit(0))).otherwise(0).alias(f"start{k}"), F.when(there, F.col("pos") + F.col(f"hi{k}")).otherwise(0).alias(f"end{k}")]
    # All pieces of one text, in order; bounded by its length. Pieces that touch or overlap become one.
    merged = places.select("tk", "tk2", "pos", *pieces).groupBy("tk", "tk2").agg(F.array_sort(F.collect_list(F.struct("pos", *[f"{side}{k}" for k in range(len(levels)) for side in ("start", "end")]))).alias("spans"))
    merged = materialize(merged)
    discard(found, classes, spans, decided)
    return merged


def _merge(spans, length: int, level: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s[f"start{level}"], min(s[f"end{level}"], length)) for s in spans or ()):
        if b <= a:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, most_in_memory: int = MOST_IN_MEMORY, short: int | None = None) -> DataFrame:
    """All columns of ``docs`` with ``__kept`` (the bytes left), ``__spans`` (maximal removed runs), where there are any
    ``__left`` (the bytes left as text, without parts of characters), and with ``short`` also ``__shared``: the maximal runs
    of bytes in repeated strings of that many bytes, which are reported and stay.

    Bytes are those of the UTF-8 text; null counts as empty. Texts shorter than ``least`` bytes stay whole; very long ones
    are read as one. Repeated rows are repeats of each other. Null and repeated doc_ids stay, each row on its own; an empty
    table gives no rows; other columns are handed on.
    """
    levels = (least,) if short is None else (least, short)
    if least < max(levels) or min(levels) < gram:
        raise ValueError("short must not be over least, nor either under gram")
    merged = repeated_spans(docs, levels, gram, most_in_memory)
    text = text_or_empty()
    rows = docs.withColumns({"__tk": F.xxhash64(text), "__tk2": F.xxhash64(text, F.lit(1)), "__text": text})
    rows = rows.join(merged.select(F.col("tk").alias("__tk"), F.col("tk2").alias("__tk2"), F.col("spans").alias("__found")), ["__tk", "__tk2"], "left").drop("__tk", "__tk2")
    names = docs.columns
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    more = ["__shared"] if short is not None else []

    def run(batches):
        listed = lambda cut: [{"start": a, "end": b} for a, b in cut]
        for batch in slices(batches):
            kept, spans, left, shared = [], [], [], []
            for data, found in zip(batch.column(len(names)).cast(pa.binary()).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                cut = _merge(found, len(data), 0)
                at, parts = 0, []
                for a, b in cut:
                    parts.append(data[at:a])
                    at = b
                kept.append(b"".join([*parts, data[at:]]))
                spans.append(listed(cut))
                left.append(kept[-1].decode("utf-8", "ignore") if cut else None)
                if more:
                    shared.append(listed(_merge(found, len(data), 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(kept, pa.binary()), pa.array(spans, span), pa.array(left, pa.string()), *([pa.array(shared, span)] if more else [])], names=[*names, "__kept", "__spans", "__left", *more])
        give_back()

    runs = F.lit(None).cast("array<struct<start:bigint,end:bigint>>")
    schema = docs.withColumns({"__kept": F.lit(None).cast("binary"), "__spans": runs, "__left": F.lit(None).cast("string")} | dict.fromkeys(more, runs)).schema
    return rows.select(*names, "__text", "__found").mapInArrow(run, schema)


def cleaned(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with the bytes left as text, and n_chars to match where there is one.

    A cut may part a character; its remaining bytes are dropped. Null texts stay null.
    """
    out = remove_repeats(docs, **options).withColumn("__cut", F.size("__spans") > 0)
    values = {"text": F.when(F.col("__cut"), F.col("__left")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(F.col("__cut"), F.char_length("__left").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(values).select(*docs.columns)
