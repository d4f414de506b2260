"""N-gram Jaccard join by parity sketches.

A document is its set of distinct word shingles. Shingles are dealt by hash into the cells of a size band; a cell's value
is the exclusive or of its shingles' hashes, so one differing shingle changes one cell at most and the number of differing
cells bounds the symmetric difference from below. Sets of Jaccard similarity t with sizes a <= b differ in at most
(1 - t) / (1 + t) * (a + b) shingles, so of K cells all but d are equal, and the first d + 1 cells of both documents, in
any common order, share one (pigeonhole). Cells with the most shingles come first: they are the most selective. Documents
that share a cell are compared by the Hamming distance of bit sketches (again a lower bound) and then exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, discard, give_back, grouped, materialize, slices, text_or_empty, worker_state
from .components import components

WORDS = 5
#: Similarity as a fraction of integers: links have DEN * intersection >= NUM * union.
NUM, DEN = 80, 100
MIX1, MIX2, ODD = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
#: Members of a shared cell that one comparison block holds.
BLOCK = 256
#: Rows (two numbers each) up to which the list of sets to read again is broadcast; a longer one is joined by shuffle.
MOST_BROADCAST = 100_000
#: Rounds that compare each cell's members with one of them, and first members that differ between cells in a round.
ROUNDS, LEADS = 3, 8


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * MIX1
    x = (x ^ (x >> np.uint64(33))) * MIX2
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, words: int = WORDS, limit: int = 100_000):
        from xxhash import xxh3_64_intdigest

        class Cache(dict):
            def __missing__(self, word):
                if len(self) >= limit:
                    self.clear()
                value = self[word] = xxh3_64_intdigest(word)
                return value

        self.cache, self.words = Cache(), words
        self.factor = [mix(np.array([k + 1], np.uint64))[0] | np.uint64(1) for k in range(words)]

    def __call__(self, data: bytes) -> np.ndarray:
        """bytes.lower() lowers A-Z alone and bytes.split() splits at ASCII white space alone."""
        words = data.lower().split()
        h = np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        n = max(1, len(h) - self.words + 1)
        out = np.full(n, min(len(h), self.words), np.uint64) * ODD
        for k in range(min(self.words, len(h))):
            out += mix(h[k : k + n] * self.factor[k] + ODD)
        return np.unique(mix(out))


def shingler(words: int) -> Shingler:
    return worker_state(("shingler", words), lambda: Shingler(words))


def fingerprint(s: np.ndarray) -> int:
    """A signed 64-bit name of a set; 0 for the empty one."""
    if not len(s):
        return 0
    return int(np.bitwise_xor.reduce(mix(s + ODD)).astype(np.int64)) or 1


def sketch(s: np.ndarray) -> bytes:
    """Parity bits, at least eight times as many as shingles, in a power of two; longer ones fold to shorter by halves."""
    bits = max(64, 1 << (8 * len(s) - 1).bit_length()) if len(s) else 64
    at = (mix(s ^ ODD) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(x: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words, folded to ``words`` words: positions are the low bits of one hash, so halves add up."""
    while x.shape[-1] > words:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def most_different(a, b, num: int = NUM, den: int = DEN):
    """Most shingles in which linked sets of sizes a and b differ."""
    return (den - num) * (a + b) // (den + num)


def largest_partner(n: int, num: int = NUM, den: int = DEN) -> int:
    return n * den // num


def bands(n: int, num: int = NUM, den: int = DEN) -> list[tuple[int, int, int]]:
    """(band, cells, cells to emit) for a set of n shingles.

    Band k holds pairs whose smaller size is in [2^k, 2^(k+1)); a set takes part in its own band and, as the larger one,
    in the band below where a partner can be that small. Sets that allow no difference need no band: equal sets are one.
    """
    out = []
    k = n.bit_length() - 1
    for band in (k, k - 1):
        low, high = 1 << max(band, 0), (2 << max(band, 0)) - 1
        if band < 0 or (band < k and largest_partner(high, num, den) < n):
            continue
        differ = most_different(n, largest_partner(n, num, den), num, den) if band == k else most_different(n, high, num, den)
        cells = 3 * most_different(high, largest_partner(high, num, den), num, den) // 2 + 2
        if differ:
            out.append((band, cells, differ + 1))
    return out


def cell_keys(s: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """The keys of a set's first cells in the common order: most shingles first, then by key."""
    keys = []
    for band, cells, emit in bands(len(s), num, den):
        at = ((mix(s + np.uint64(band + 1)) >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        at, values = at[order], s[order]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        count = np.diff(np.r_[starts, len(at)])
        value = np.bitwise_xor.reduceat(mix(values ^ MIX2), starts)
        place = at[starts]
        if len(starts) < emit:  # empty cells come last, and are equal in all sets that lack them
            empty = np.setdiff1d(np.arange(cells), place)[: emit - len(starts)]
            place, value, count = np.r_[place, empty], np.r_[value, np.zeros(len(empty), np.uint64)], np.r_[count, np.zeros(len(empty), np.int64)]
        key = mix(value + mix((place.astype(np.uint64) << np.uint64(8)) + np.uint64(band + 1)))
        keys.append(key[np.lexsort((key, -count))[:emit]])
    return np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)


MARK = pa.struct([("doc_id", pa.int64()), ("n", pa.int64()), ("tk", pa.int64()), ("tk2", pa.int64()), ("sk", pa.binary())])
ROWS = "key bigint, f bigint, mark struct<doc_id:bigint,n:bigint,tk:bigint,tk2:bigint,sk:binary>"


def text_keys() -> list:
    """Two names of a row's text by its content."""
    return [F.xxhash64(text_or_empty()), F.xxhash64(text_or_empty(), F.lit(1))]


def _texts(docs: DataFrame) -> DataFrame:
    tk, tk2 = text_keys()
    return docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text"), tk.alias("tk"), tk2.alias("tk2"))


def _rows(key, f, mark) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(f, pa.int64()), mark], names=["key", "f", "mark"])


def marks_and_cells(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """One pass over the texts: a row with ``mark`` for every document (f names its set, n is its size; a set's sketch comes
    with one of its rows a task at least) and rows (key, f) of every set's cells to emit, once a task.

    A marked row's key is that of its text and doc_id, so that marks of copies part.
    """

    def run(batches):
        make, met = shingler(words), set()
        for batch in slices(batches):
            keys, names, size, f_out, n_out, sk_out = [], [], 0, [], [], []
            for data in batch.column(1).cast(pa.binary()).to_pylist():
                s = make(data)
                f = fingerprint(s)
                f_out.append(f)
                n_out.append(len(s))
                if not f or f in met:
                    sk_out.append(None)
                    continue
                if len(met) >= 100_000:
                    met.clear()
                met.add(f)
                sk_out.append(sketch(s))
                k = cell_keys(s, num, den)
                keys.append(k)
                names.append(np.full(len(k), f, np.int64))
                size += len(k)
                if size > 50_000:
                    yield _rows(np.concatenate(keys), np.concatenate(names), pa.nulls(size, MARK))
                    keys, names, size = [], [], 0
            if size:
                yield _rows(np.concatenate(keys), np.concatenate(names), pa.nulls(size, MARK))
            ids = batch.column(0)
            mark = pa.StructArray.from_arrays([ids, pa.array(n_out, pa.int64()), batch.column(2), batch.column(3), pa.array(sk_out, pa.binary())], fields=list(MARK))
            own = mix(batch.column(2).to_numpy().view(np.uint64) + mix(ids.fill_null(0).to_numpy().view(np.uint64) ^ ODD))
            yield _rows(own.view(np.int64), f_out, mark)
        give_back()

    return _texts(docs).mapInArrow(run, ROWS)


def shared_cells(rows: DataFrame) -> DataFrame:
    """Marked rows as they are, and of the others those whose key several sets have, each once.

    Rows meet by key and pass in order, so a cell of any size takes one row of memory.
    """

    def run(batches):
        last, told = None, False  # the last cell row met and whether it was handed on
        for batch in batches:
            plain = batch.column(2).is_null()
            if plain.false_count:
                yield batch.filter(pa.compute.invert(plain))
            if not plain.true_count:
                continue
            cells_ = batch.filter(plain)
            key, f = cells_.column(0).to_numpy(), cells_.column(1).to_numpy()
            if last is not None:
                key, f = np.r_[last[0], key], np.r_[last[1], f]
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (f[1:] != f[:-1])])
            key, f = key[new], f[new]
            same = key[1:] == key[:-1]
            member = np.r_[False, same] | np.r_[same, False]
            out = member.copy()
            if last is not None and told:
                out[0] = False
            at = np.flatnonzero(out)
            told = bool(member[-1]) or (told and len(key) == 1)
            last = (key[-1], f[-1])
            if len(at):
                yield _rows(key[at], f[at], pa.nulls(len(at), MARK))

    return rows.repartition("key").sortWithinPartitions("key", "f").mapInArrow(run, ROWS)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def near_by_sketch(pairs: DataFrame, nodes: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """Of the pairs (a, b), those that sizes and the Hamming distance of the sketches don't rule out."""
    one = nodes.select(F.col("f").alias("a"), F.col("n").alias("na"), F.col("sk").alias("sa"))
    two = nodes.select(F.col("f").alias("b"), F.col("n").alias("nb"), F.col("sk").alias("sb"))
    fits = (F.lit(den) * F.least("na", "nb") >= F.lit(num) * F.greatest("na", "nb")).alias("fits")

    def run(batches):
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            most, keep = most_different(na, nb, num, den), []
            for i, (x, y) in enumerate(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                w = min(len(x), len(y))
                keep.append(int(_popcount(fold(x, w) ^ fold(y, w))) <= most[i])
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").filter(fits).select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """Of the pairs (a, b), those whose sets reach the similarity, from the sets themselves."""
    wanted = pairs.select(F.col("a").alias("f")).union(pairs.select(F.col("b").alias("f"))).distinct()
    first = asked = materialize(nodes.join(wanted, "f").select("doc", "f"))
    if first.count() <= MOST_BROADCAST:
        first = F.broadcast(first)

    def sets(batches):
        make = shingler(words)
        for batch in slices(batches):
            out_f, out_s = [], []
            for data, f in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = make(data)
                if fingerprint(s) == f:  # other rows may have the same doc_id
                    out_f.append(f)
                    out_s.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out_f, pa.int64()), pa.array(out_s, pa.binary())], names=["f", "s"])

    texts = _texts(docs).select("doc_id", "text")
    rows = texts.join(first, texts["doc_id"].eqNullSafe(first["doc"])).select("text", "f").mapInArrow(sets, "f bigint, s binary")
    rows = table = materialize(rows.groupBy("f").agg(F.first("s").alias("s")))  # in a table, so that a join may split a hot set

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = rows.select(F.col("f").alias("a"), F.col("s").alias("x")), rows.select(F.col("f").alias("b"), F.col("s").alias("y"))
    out = materialize(pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint"))
    discard(table, asked)
    return out


def _label(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    found = components(edges).withColumnRenamed("node", "f")
    return nodes.join(found, "f", "left").select("f", F.coalesce("component", "f").alias("c"))


def _open(members: DataFrame, label: DataFrame) -> DataFrame:
    """Members (key, f, c, m) of cells that hold m > 2 sets of more than one component."""
    rows = members.join(label, "f")
    cells_ = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).filter("lo < hi AND m > 2")
    return rows.join(cells_.select("key", "m"), "key")


def _stars(rows: DataFrame, seed: int) -> DataFrame:
    """Pairs (a, b) of each cell's members with the one of them that comes first in one of LEADS orders."""
    order = F.xxhash64(F.col("f"), F.pmod(F.col("key"), F.lit(LEADS)), F.lit(seed))
    lead = rows.groupBy("key").agg(F.min(F.struct(order.alias("h"), F.col("f").alias("lead"), *([F.col("c").alias("lead_c")] if "c" in rows.columns else []))).alias("x")).select("key", "x.*")
    pairs = rows.join(lead, "key").filter("f <> lead" + (" AND c <> lead_c" if "c" in rows.columns else ""))
    return pairs.select(F.least("lead", "f").alias("a"), F.greatest("lead", "f").alias("b")).distinct()


def _exhaustive(open_: DataFrame, nodes: DataFrame, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """Pairs within a cell whose sets are in different components so far and pass the sketch test.

    A large cell is dealt into pairs of blocks, so a task holds two blocks at a time and nothing is left out.
    """
    rows = open_.withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    own = F.pmod(F.xxhash64("f"), F.col("blocks").cast("bigint")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "f", "c").join(nodes.select("f", "n", "sk"), "f")
    parts = rows.select("key", "i", "j", "own", "f", "c", "n", "sk").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        met: set[tuple[int, int]] = set()
        for (_, i, j), t in grouped(batches, ["key", "i", "j"]):
            own, f, c, n = (t.column(k).to_numpy() for k in ("own", "f", "c", "n"))
            sk = [np.frombuffer(x, np.uint64) for x in t.column("sk").to_pylist()]
            order = np.argsort(n, kind="stable")
            a_out, b_out = [], []
            for at, x in enumerate(order):
                rest = order[at + 1 :]
                rest = rest[: np.searchsorted(n[rest], n[x] * den // num, side="right")]
                rest = rest[(c[rest] != c[x]) & ((own[rest] != own[x]) if i != j else True)]
                if not len(rest):
                    continue
                w = len(sk[x])  # the smaller set has the shorter sketch
                apart = _popcount(np.stack([fold(sk[r], w) for r in rest]) ^ sk[x])
                for r in rest[apart <= most_different(n[x], n[rest], num, den)]:
                    pair = (min(f[x], f[r]), max(f[x], f[r]))
                    if pair not in met:
                        if len(met) > 500_000:
                            met.clear()
                        met.add(pair)
                        a_out.append(pair[0])
                        b_out.append(pair[1])
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return parts.mapInArrow(run, "a bigint, b bigint").distinct()


def link_components(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, f, n_shingles, tk, tk2, component_id of every row.

    ``f`` names the row's shingle set, tk and tk2 its text; rows of one set are linked. Null and empty texts have no shingles, f 0, and stand
    alone with their own doc_id. component_id is the least doc_id reached (null only where no row reached has one).
    Repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    met = materialize(shared_cells(marks_and_cells(docs, words, num, den)))
    marks = met.filter("mark IS NOT NULL").select("mark.*", "f")
    nodes = materialize(marks.filter("f <> 0").groupBy("f").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sk", ignorenulls=True).alias("sk")))
    members = met.filter("mark IS NULL").select("key", "f")
    # First each member with one of its cell; then, of cells still in several components, with others; then all the rest.
    tried = edges = label = open_ = None
    used = []
    for k in range(ROUNDS + 1):
        before = open_
        open_ = members if label is None else materialize(_open(members if before is members else before.select("key", "f"), label))
        if before is not None and before is not members:
            discard(before)
        if label is not None and open_.isEmpty():
            break
        # In a table, so that few pairs are known to be few and the sets' sketches needn't move.
        pairs = materialize(_stars(open_, k) if k < ROUNDS else _exhaustive(open_, nodes, num, den))
        near = near_by_sketch(pairs, nodes, num, den) if k < ROUNDS else pairs
        near = materialize(near if tried is None else near.join(tried, ["a", "b"], "left_anti"))
        discard(pairs)
        used.append(near)
        tried = near if tried is None else tried.unionByName(near)
        if near.isEmpty() and label is not None:
            continue
        new = verified(near, nodes, docs, words, num, den)
        used.append(new)
        if label is not None and new.isEmpty():
            continue
        edges = new if edges is None else edges.unionByName(new)
        old, label = label, materialize(_label(nodes, edges))
        if old is not None:
            discard(old)
    named = nodes.select("f", "doc").join(label, "f")
    least = named.groupBy("c").agg(F.min("doc").alias("component_id"))
    named = materialize(named.join(least, "c").select("f", "component_id"))
    marks = materialize(marks.select("doc_id", "f", "n", "tk", "tk2"))
    discard(met, nodes, label, *used)
    return marks.select("doc_id", "f", F.col("n").alias("n_shingles"), "tk", "tk2").join(named, "f", "left").withColumn("component_id", F.when(F.col("f") == 0, F.col("doc_id")).otherwise(F.col("component_id")))


def keep_one(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row of each component, that of the least doc_id (then the least set and text names); rows without words all stay.

    Returns the columns of ``docs``; of rows that repeat both doc_id and text one stays.
    """
    found = materialize(link_components(docs, words, num, den).select("doc_id", "f", "tk", "tk2", "component_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("i"), "f", "tk", "tk2"))
    kept = found.filter("f <> 0").groupBy("component_id").agg(first.alias("k")).select("k.i", "k.no", "k.tk", "k.tk2")
    kept = kept.unionByName(found.filter("f = 0").select(F.col("doc_id").alias("i"), F.col("doc_id").isNull().alias("no"), "tk", "tk2").distinct())
    mine = {"__i": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), "__no": F.col("doc_id").isNull()} | dict(zip(("__tk", "__tk2"), text_keys(), strict=True))
    own = list(mine)
    kept = kept.select(F.coalesce("i", F.lit(0)).alias("__i"), F.col("no").alias("__no"), F.col("tk").alias("__tk"), F.col("tk2").alias("__tk2"))
    words_ = F.length(F.regexp_replace(text_or_empty(), f"^[{SPACE_CLASS}]+", "")) > 0
    rows = docs.withColumns(mine).join(kept, own, "left_semi")
    bare = rows.filter(~words_).select(*docs.columns)
    return rows.filter(words_).dropDuplicates(own).select(*docs.columns).unionByName(bare)
