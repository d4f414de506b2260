"""Language-model scoring by logistic mixing of hashed-context bit predictors.

Each byte is eight binary decisions. Three predictors (the two bytes before, the four bytes before, the word so far) keep
counts of the bytes after each context; their log-odds are added with weights gated by the bit's place and refined, text by
text, by gradient steps after each block. Counts come from all training texts. They stay in a partitioned table with a cell
for each context and next byte seen, contexts named by 32 bits of their hash, so the model grows with the corpus. Each chunk
of texts asks for the cells of its own bytes and gets eight log-odds for each, so an answer's size depends on the chunk
alone, and no task holds the whole model.

With ``adapt`` the predictors are online: what they learned in training moves by the text's own bits as they come, and the
mixed log-odds get a correction by bit place and range that the text's earlier blocks taught.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mixer
from .common import discard, give_back, materialize, slices, text_or_empty, worker_state
from .parity_join import ODD
from .suffix_dedup import POWERS, prefix_sums, span_hashes

PREDICTORS = 3
BLOCK_BITS = 8  # leading bits of the contexts' names by which a predictor's counts are summed apart
CELL_BITS = 40  # a context's name and the byte after it
WITHIN = np.uint64(CELL_BITS - BLOCK_BITS)
#: Cells that a task holds before it hands its counts on, and bytes of text until then.
MOST_CELLS, MOST_BYTES = 2_000_000, 1 << 27
#: Bytes of text that are scored with cells asked for together.
CHUNK = 8_000_000
#: Asked cells of a block that are looked up together.
MOST_ASKED = 100_000
SMOOTH = (0.3, 0.2, 0.1)
SCALE = 12.0  # log-odds are kept as signed bytes of this resolution
START_WEIGHTS = (0.3, 0.4, 0.3)
RATE = 0.8
FIRST_BLOCK = 192
#: Bytes of a piece up to which its texts are scored by compiled code; a longer text is scored by arrays, to the same result.
MOST_PACKED = 2_000_000
#: How many observations a trained predictor's state counts for against the text's own bits, for each predictor.
HISTORY = (12.0, 4.0, 4.0)
#: Ranges of the mixed log-odds, one wide each, with a correction of their own; the doubt that holds a correction back.
RANGES, DOUBT = 21, 6.0
#: Words whose counts are broadcast; the others' are joined.
FREQUENT = 1 << 18
END = b"\x00"
#: Words are named by 63 bits of their hash, as negative numbers; places in the list of frequent words are not negative.
SIGN = np.uint64(1 << 63)
END_NAME = -(1 << 63)
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def cells_of(data: np.ndarray, starts: np.ndarray, sums: np.ndarray) -> list[np.ndarray]:
    """Each predictor's cell for each byte of texts laid end to end; ``starts`` marks where each begins.

    ``sums`` are the prefix sums of the bytes' hash.
    """
    n = len(data)
    first = np.flatnonzero(starts)
    end = np.r_[first[1:], n]
    wide = data.astype(np.uint32)
    back = []
    for k in range(4):
        b = np.zeros(n, np.uint32)
        b[k + 1 :] = wide[: max(0, n - k - 1)]
        for j in range(k + 1):  # nothing of the text before
            at = first + j
            b[at[at < end]] = 0
        back.append(b)
    two = back[0] | back[1] << np.uint32(8)
    four = two | back[2] << np.uint32(16) | back[3] << np.uint32(24)
    marks = starts.copy()
    marks[1:] |= WHITE[data[:-1]]
    word = np.maximum.accumulate(np.where(marks, np.arange(n), 0))
    _, down = POWERS(n + 1)
    so_far = (((sums[:-1] - sums[word]) * down[word] * ODD) >> np.uint64(32)).astype(np.uint32)
    return [(x * np.uint32(0x9E3779B1)).astype(np.uint64) << np.uint64(8) | data for x in (two, four, so_far)]


def words_of(data: np.ndarray, at: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of each text's words with its end as the last, text by text, and how many each text has."""
    white = WHITE[data]
    white[at[1:] - 1] = True
    first = np.flatnonzero(~white & np.r_[True, white[:-1]])
    names = (span_hashes(sums, first, np.flatnonzero(~white[:-1] & white[1:]) + 1) | SIGN).view(np.int64)
    ends = np.searchsorted(first, at[1:])
    return np.insert(names, ends, END_NAME), np.diff(ends, prepend=0) + 1


def laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes end to end with an end byte each, marks of first bytes, and where each text starts (and the last ends)."""
    at = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    data = np.frombuffer(END.join(texts) + END, np.uint8)
    starts = np.zeros(len(data), bool)
    starts[at[:-1]] = True
    return data, starts, at


def _news(x: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted values."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of cells with counts as one, each cell once."""
    cell = np.concatenate([c for c, _ in runs])
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    first = _news(cell)
    return cell[first], np.add.reduceat(np.concatenate([n for _, n in runs])[order], first)


def _unique(runs: list[np.ndarray]) -> np.ndarray:
    x = np.sort(np.concatenate(runs))
    return x[_news(x)]


def _edges(cell: np.ndarray) -> np.ndarray:
    """Where each block begins among sorted cells, and where the last ends."""
    return np.r_[np.searchsorted(cell, np.arange(1 << BLOCK_BITS, dtype=np.uint64) << WITHIN), len(cell)]


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often each is there."""
    x = np.sort(x)
    first = _news(x)
    return x[first], np.diff(first, append=len(x)).astype(np.uint64)


def _push(runs: list, run: tuple[np.ndarray, np.ndarray]) -> None:
    """Add a run and keep the runs' lengths falling by half at least."""
    runs.append(run)
    while len(runs) > 1 and 2 * len(runs[-1][0]) > len(runs[-2][0]):
        runs[-2:] = [_merged(runs[-2:])]


class Counts:
    """Counts of words and of bytes after contexts: sorted names and cells, as many as there are."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.words, self.runs, self.seen = [], [[] for _ in range(PREDICTORS)], 0

    def add(self, texts: list[bytes]) -> None:
        if not texts:
            return
        data, starts, at = laid(texts)
        sums = prefix_sums(data)
        self.seen += len(data)
        _push(self.words, _counted(words_of(data, at, sums)[0]))
        for runs, cell in zip(self.runs, cells_of(data, starts, sums), strict=True):
            _push(runs, _counted(cell))

    def full(self) -> bool:
        return self.seen > MOST_BYTES or sum(len(c) for runs in (self.words, *self.runs) for c, _ in runs) > MOST_CELLS

    def cells(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sorted cells and their counts, one pair a predictor."""
        return [_merged(runs) if runs else (np.zeros(0, np.uint64),) * 2 for runs in self.runs]

    def parts(self):
        """(predictor and leading bits of the contexts' names, packed counts)."""
        for m, (cell, n) in enumerate(self.cells()):
            edge = _edges(cell)
            for b in np.flatnonzero(np.diff(edge)).tolist():
                yield m << BLOCK_BITS | b, _packed(cell[edge[b] : edge[b + 1]], n[edge[b] : edge[b + 1]])


def odds_of(c: np.ndarray, smooth: float) -> np.ndarray:
    """Log-odds of a one at each node of the trees of bits over rows of 16 counts, as signed bytes."""
    c = c.reshape(-1, 16).astype(np.float32)
    odds = np.zeros(c.shape, np.int8)
    level = c
    for j in range(3, -1, -1):  # level holds the sums of the prefixes of j + 1 bits
        zero, one = level[:, 0::2], level[:, 1::2]
        value = np.log((one + smooth) / (zero + smooth)) * SCALE
        odds[:, 1 << j : 2 << j] = np.clip(np.rint(value), -127, 127)
        level = zero + one
    return odds


def odds_toward(cell: np.ndarray, n: np.ndarray, asked: np.ndarray, smooth: float) -> np.ndarray:
    """For each sorted asked cell, the eight log-odds in favour of its byte's bits, by the counts of its context.

    A context that was never seen has no odds: zeros.
    """
    out = np.zeros((len(asked), 8), np.int8)
    for half, shift in enumerate((8, 4)):  # high halves after contexts, low halves after contexts and high halves
        wide, low = np.uint64(shift), np.uint64(shift - 4)
        row = asked >> wide
        first = _news(row)
        name = row[first]
        lo, hi = np.searchsorted(cell, name << wide), np.searchsorted(cell, (name + np.uint64(1)) << wide)
        first = np.r_[first, len(asked)]
        there = np.flatnonzero(hi > lo)
        for at in range(0, len(there), 20_000):
            r = there[at : at + 20_000]
            size = hi[r] - lo[r]
            of = np.repeat(np.arange(len(r)), size)
            where = np.repeat(lo[r] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            c = np.bincount(of << 4 | (cell[where] >> low & np.uint64(15)).astype(np.int64), n[where], 16 * len(r))
            odds = odds_of(c, smooth)
            size = first[r + 1] - first[r]
            of = np.repeat(np.arange(len(r)), size)
            where = np.repeat(first[r] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            value = (asked[where] >> low & np.uint64(15)).astype(np.int64)
            for j in range(4):
                x = odds[of, (16 | value) >> (4 - j)]
                out[where, 4 * half + j] = np.where(value >> (3 - j) & 1, x, -x)
    return out


class Chunk:
    """Texts that are scored together: the cells that they need, then log10 probabilities by those cells' log-odds.

    Each text starts from the same weights, so results don't depend on the others.
    """

    def __init__(self):
        self.pieces = []

    def add(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Take a piece; returns its words' names and each text's number of words."""
        data, starts, at = laid(texts)
        sums = prefix_sums(data)
        self.pieces.append((data, at, [_places(cell) for cell in cells_of(data, starts, sums)]))
        return words_of(data, at, sums)

    def needs(self) -> list[np.ndarray]:
        """Sorted distinct cells, for each predictor."""
        return [_unique([places[m][0] for _, _, places in self.pieces]) for m in range(PREDICTORS)]

    def scores(self, needs: list[np.ndarray], odds: list[np.ndarray], adapt: bool = False, most_packed: int = -1):
        """The scores of each piece's texts; of pieces up to most_packed bytes, what Mixer.java needs for them."""
        odds = [np.ascontiguousarray(o).view(np.uint64).ravel() for o in odds]
        states = [_states(m) for m in range(PREDICTORS)] if adapt else None
        for data, at, places in self.pieces:
            if len(data) <= most_packed:
                yield _laid_out(data, at, places, [o[np.searchsorted(need, cell)] for need, o, (cell, _) in zip(needs, odds, places, strict=True)])
                continue
            mine = [o[np.searchsorted(need, cell)][place] for need, o, (cell, place) in zip(needs, odds, places, strict=True)]
            if adapt:
                text = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
                for m, (o, (cell, place)) in enumerate(zip(mine, places, strict=True)):
                    _adapt(o, data, text, (cell >> np.uint64(8))[place], m, states[m])
            yield _scores(data, at, mine, adapt)


def _laid_out(data: np.ndarray, at: np.ndarray, places: list, odds: list[np.ndarray]) -> bytes:
    """A piece as Mixer.java reads it. Numbers of 32 bits: how many texts, bytes and cells of each predictor, where texts
    start, the bytes' cells, the cells' contexts (numbered); then the cells' log-odds and the bytes."""
    head = np.r_[len(at) - 1, len(data), [len(cell) for cell, _ in places], at].astype("<i4")
    names = [cell >> np.uint64(8) for cell, _ in places]
    context = [np.cumsum(np.r_[False, x[1:] != x[:-1]]).astype("<i4") for x in names]
    return b"".join((head, *(place.astype("<i4", copy=False) for _, place in places), *context, *odds, data))


#: The probability that a signed byte of log-odds stands for; no log-odds are -128, which stands for an unseen context.
CHANCE = 1 / (1 + np.exp(-np.r_[0:128, 0, -127:0] / SCALE))
NOT_SEEN = np.uint64(0x8080808080808080)
#: The leading bits that a byte has in common with another, by the exclusive or of both.
COMMON = np.array([8 - x.bit_length() for x in range(256)])
#: Bytes that are looked at together, so that they stay in cache.
PART = 60_000
FIRST_BYTE = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)
#: A one in each of the bytes from a place to before another.
ONES = np.array([[sum(1 << 8 * k for k in range(lo, hi)) for hi in range(9)] for lo in range(10)], np.uint64)


def _states(m: int) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of predictor m's state for and against a bit, by the number of the text's own bits and trained log-odds."""
    strength = np.full(256, HISTORY[m])
    strength[128] = 2 * SMOOTH[m]
    own = np.arange(256)[:, None]
    return tuple((np.log(strength * p + own) * SCALE).astype(np.float32).ravel() for p in (CHANCE, 1 - CHANCE))


def _adapt(odds: np.ndarray, data: np.ndarray, text: np.ndarray, context: np.ndarray, m: int, states) -> None:
    """Move predictor m's log-odds (eight signed bytes in one number a byte) by the text's own bits, bit after bit.

    Its state at a bit is what it learned in training, taken for HISTORY observations (two of SMOOTH where the context was
    not seen), and all bits that the text had before at the same node: after the same context and leading bits.
    """
    n = len(data)
    if n >> 24:
        order = np.argsort(context, kind="stable")
    else:
        order = (np.sort(context << np.uint64(24) | np.arange(n, dtype=np.uint64)) & np.uint64((1 << 24) - 1)).astype(np.int64)
    c, t = context[order], text[order]
    first = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (t[1:] != t[:-1])][:n])
    size = np.diff(first, append=n)
    odds[odds == 0] = NOT_SEEN
    large = size > 256
    if large.any():
        _move_large(odds.view(np.int8), data, order[np.repeat(large, size)], size[large], m)
    small = (size > 1) & ~large
    toward, against = _own_bits(data, order[np.repeat(small, size)], size[small])
    there = np.flatnonzero(toward | against)
    pro, contra = states
    for at in range(0, len(there), 16_000):
        rows = there[at : at + 16_000]
        wide = lambda x: x[rows].view(np.uint8).astype(np.int64)
        old = wide(odds)
        value = pro[wide(toward) << 8 | old] - contra[wide(against) << 8 | old]
        odds[rows] = np.clip(np.rint(value, out=value), -127, 127, out=value).astype(np.int8).view(np.uint64)
    odds[odds == NOT_SEEN] = 0


def _own_bits(data: np.ndarray, order: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many earlier bits at the same node were as a byte's bit and how many were not, eight bytes in one number each.

    ``order`` holds the bytes of each context of a text, one after the other, 256 at most.
    """
    toward, against = np.zeros(len(data), np.uint64), np.zeros(len(data), np.uint64)
    ends = np.cumsum(size)
    cuts = np.r_[0, np.searchsorted(ends, np.arange(PART, len(order), PART)), len(size)]
    ends = np.r_[0, ends][cuts]
    for g, h, lo, hi in zip(cuts[:-1], cuts[1:], ends[:-1], ends[1:], strict=True):
        _part(data, order[lo:hi], size[g:h], toward, against)
    return toward, against


def _part(data, order, size, toward, against) -> None:
    byte, low = data[order], np.zeros(len(size), np.int64)
    while len(order):  # groups of bytes at one node; each goes on to the bit where its bytes part
        first = np.cumsum(size) - size
        g = np.repeat(np.arange(len(size)), size)
        rank = np.arange(len(order)) - first[g]
        parts = COMMON[np.bitwise_or.reduceat(byte ^ byte[first][g], first)]
        toward[order] += rank.view(np.uint64) * ONES[low, parts][g]
        wide = np.flatnonzero((parts < 8)[g])
        if not len(wide):
            break
        order, byte, rank, g = order[wide], byte[wide], rank[wide], g[wide]
        bit = (byte >> (7 - parts).astype(np.uint8)[g] & 1).view(bool)
        ones = np.cumsum(bit)
        go = np.flatnonzero(parts < 8)
        size, parts = size[go], parts[go]
        end = np.cumsum(size)
        first = end - size
        before = ones[first] - bit[first]
        high = ones[end - 1] - before
        g = np.repeat(np.arange(len(size)), size)
        ones -= before[g] + bit
        same = np.where(bit, ones, rank - ones)
        one = FIRST_BYTE[parts][g]
        toward[order] += same.view(np.uint64) * one
        against[order] += (rank - same).view(np.uint64) * one
        to = same + first[g] + bit * (size - high)[g]
        order, byte = _put(order, to), _put(byte, to)
        size = np.column_stack([size - high, high]).ravel()
        low = np.repeat(parts + 1, 2)
        more = size > 1
        keep = np.flatnonzero(np.repeat(more, size))
        order, byte, size, low = order[keep], byte[keep], size[more], low[more]


def _move_large(flat: np.ndarray, data: np.ndarray, order: np.ndarray, size: np.ndarray, m: int) -> None:
    """The same for contexts that a text has more often, bit by bit with whole counts."""
    byte = data[order]
    for j in range(8):
        first = np.cumsum(size) - size
        rank = np.arange(len(order)) - np.repeat(first, size)
        bit = (byte >> (7 - j) & 1).astype(bool)
        ones = np.cumsum(bit) - bit
        ones -= np.repeat(ones[first], size)
        same = np.where(bit, ones, rank - ones)
        at = (order << 3) + j
        old = flat[at].view(np.uint8)
        p, strength = CHANCE[old], np.where(old == 128, 2 * SMOOTH[m], HISTORY[m])
        value = SCALE * np.log((strength * p + same) / (strength * (1 - p) + rank - same))
        flat[at] = np.clip(np.rint(value), -127, 127)  # what has no bits before stays as it was; of unseen contexts, 0
        high = np.add.reduceat(bit, first, dtype=np.int64)
        to = np.repeat(first, size) + same + np.where(bit, np.repeat(size - high, size), 0)
        order, byte = _put(order, to), _put(byte, to)
        size = np.column_stack([size - high, high]).ravel()
        size = size[size > 0]


def _put(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    out[to] = x
    return out


def _places(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells, and each byte's place among them."""
    n = len(cell)
    if n >> (64 - CELL_BITS):
        order = np.argsort(cell, kind="stable")
        x = cell[order]
    else:
        x = np.sort(cell << np.uint64(64 - CELL_BITS) | np.arange(n, dtype=np.uint64))
        order = x & np.uint64((1 << (64 - CELL_BITS)) - 1)
        x >>= np.uint64(64 - CELL_BITS)
    first = _news(x)
    place = np.empty(n, np.int32)
    place[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(first, append=n))
    return x[first], place


def _scores(data: np.ndarray, at: np.ndarray, odds: list[np.ndarray], refine: bool = False) -> np.ndarray:
    """log10 probabilities of texts laid end to end; ``odds`` has eight signed bytes a byte and predictor, in one number.

    ``refine``: the mixed log-odds get a correction that the text's earlier blocks taught for their bit place and range.
    """
    n = len(at) - 1
    length = np.diff(at)
    total = np.zeros(n)
    weight = np.broadcast_to(np.array(START_WEIGHTS, np.float32) / np.float32(SCALE), (8, n, PREDICTORS)).copy()
    bias = np.zeros((8, n), np.float32)
    # Each range's correction and the doubt resolved about it so far.
    ranges = np.zeros((2, 8, n * RANGES), np.float32) if refine else None
    lo, size = 0, FIRST_BLOCK
    while (length > lo).any():
        # A text's last block changes no weight that is used again.
        for active, goes_on in ((np.flatnonzero(length > lo + size), True), (np.flatnonzero((length > lo) & (length <= lo + size)), False)):
            if len(active):
                rate = RATE / math.sqrt(1 + lo / FIRST_BLOCK) if goes_on else 0.0
                total[active] -= _block(data, odds, at[active] + lo, np.minimum(length[active] - lo, size), active, weight, bias, rate, ranges)
        lo += size
        if lo >= 2 * FIRST_BLOCK:
            size = lo  # blocks double
    return total / math.log(10)


def _block(data, odds, start, count, active, weight, bias, rate: float, ranges=None) -> np.ndarray:
    """Natural logarithms of 1 / p of a block of each active text; changes their weights and, if there are any, the
    corrections of ranges where rate is not 0."""
    first = np.r_[0, np.cumsum(count)[:-1]]
    where = np.repeat(start - first, count) + np.arange(count.sum())
    byte = data[where]
    mine = [o[where].view(np.int8).reshape(-1, 8) for o in odds]
    against = np.ones(len(where), np.float32)
    if ranges is not None:
        row = np.repeat(active * RANGES + RANGES // 2, count)
    for j in range(8):
        toward = [o[:, j].astype(np.float32) for o in mine]
        sign = (byte >> (7 - j) & 1).astype(np.float32) * 2 - 1
        w = weight[j, active]
        z = np.repeat(bias[j, active], count) * sign
        for k in range(PREDICTORS):
            z += np.repeat(w[:, k], count) * toward[k]
        # 1 / p(bit) is 1 + exp(-z), z in favour of the bit; z stays within 10, so eight factors fit a float.
        np.clip(z, -10, 10, out=z)
        if ranges is not None:
            against *= _refined(z, sign, row, ranges[:, j], rate)
            if not rate:
                continue
        e = np.exp(np.negative(z, out=z), out=z)
        one = 1 + e
        if ranges is None:
            against *= one
        if rate:
            miss = np.divide(e, one, out=e)  # 1 - p(bit)
            speed = rate / count
            bias[j, active] += np.add.reduceat(miss * sign, first) * (0.3 * speed)
            for k in range(PREDICTORS):
                weight[j, active, k] += np.add.reduceat(miss * toward[k], first) * (speed * 0.02 / SCALE)
    return np.add.reduceat(np.log(against).astype(np.float64), first)


def _refined(z, sign, row, ranges, rate: float) -> np.ndarray:
    """1 / p of the bits by corrected log-odds; where rate is not 0 each range learns from its bits, a Newton step a block."""
    change, mass = ranges
    of = row + np.rint(z * sign).astype(np.int64)
    e = np.exp(-np.clip(z + change[of] * sign, -10, 10))
    one = 1 + e
    if rate:
        miss = e / one
        mass += np.bincount(of, miss * (1 - miss), len(mass))
        change += np.bincount(of, miss * sign, len(mass)) / (mass + DOUBT)
    return one


def scores_by(model: list[tuple[np.ndarray, np.ndarray]], texts: list[bytes], adapt: bool = False) -> np.ndarray:
    """Scores of texts by the whole counts of a small model."""
    chunk = Chunk()
    chunk.add(texts)
    needs = chunk.needs()
    return next(chunk.scores(needs, [odds_toward(*counts, need, smooth) for counts, need, smooth in zip(model, needs, SMOOTH, strict=True)], adapt))


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def _train(docs: DataFrame) -> DataFrame:
    """(kind, k, n, blob): word counts (kind 0) and parts of the predictors' counts (kind 1) of each task's texts."""
    kind = "kind int, k bigint, n bigint, blob binary"

    def run(batches):
        counts = Counts()

        def found():
            h, n = _merged(counts.words) if counts.words else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(h), np.int32)), pa.array(h), pa.array(n.astype(np.int64)), pa.nulls(len(h), pa.binary())], names=["kind", "k", "n", "blob"])
            yield from slices([rows], 20_000)
            for part, blob in counts.parts():
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([part], pa.int64()), pa.array([0], pa.int64()), pa.array([blob], pa.binary())], names=["kind", "k", "n", "blob"])
            counts.clear()

        for batch in slices(batches):
            texts, held = [], 0
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                texts.append(t.lower())  # bytes: A-Z alone
                held += len(t)
                if held > 400_000:
                    counts.add(texts)
                    texts, held = [], 0
                    if counts.full():
                        yield from found()
            counts.add(texts)
        yield from found()
        give_back()

    return docs.filter(~held_out(F.col("doc_id"))).select(text_or_empty().alias("text")).mapInArrow(run, kind)


def _packed(cell: np.ndarray, n: np.ndarray | None = None) -> bytes:
    """The cells of a block, each as the difference to the one before, and their counts, if any; by planes of bytes."""
    x = np.r_[cell[:1] & np.uint64((1 << int(WITHIN)) - 1), np.diff(cell)].astype("<u4")
    raw = x.view(np.uint8).reshape(-1, 4).T.tobytes()
    if n is not None:
        raw += n.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(cell).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, k: int, counts: bool = True):
    """The cells of block k, with their counts if they have any."""
    size = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], (12 if counts else 4) * size, codec="zstd", asbytes=True), np.uint8)
    plane = lambda a, wide, kind: np.ascontiguousarray(a.reshape(wide, size).T).view(kind).ravel()
    cell = np.cumsum(plane(raw[: 4 * size], 4, "<u4").astype(np.uint64)) + (np.uint64(k & ((1 << BLOCK_BITS) - 1)) << WITHIN)
    return (cell, plane(raw[4 * size :], 8, "<u8").astype(np.uint64)) if counts else cell


def _summed(parts: DataFrame) -> DataFrame:
    """(k, blob): the summed counts of each block."""

    def run(batches):
        last, held, size = None, [], 0
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != last:
                    if last is not None:
                        yield done(last, held)
                    last, held, size = k, [], 0
                held.append(_unpacked(blob, k))
                size += len(held[-1][0])
                if size > MOST_CELLS and size > 2 * len(held[0][0]):
                    held = [_merged(held)]
                    size = len(held[0][0])
        if last is not None:
            yield done(last, held)

    def done(k, held):
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([_packed(*_merged(held))], pa.binary())], names=["k", "blob"])

    return parts.repartition("k").sortWithinPartitions("k").mapInArrow(run, "k bigint, blob binary")


ASKED = "chunk bigint, kind int, k bigint, blob binary"


def _asking(docs: DataFrame) -> DataFrame:
    """Packed texts (kind 1), lower-cased, in chunks, and the cells that each chunk needs of each block (kind 0)."""

    def run(batches):
        from pyspark import TaskContext

        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        chunk = TaskContext.get().partitionId() << 32
        texts, needs, seen, held = [], [[] for _ in range(PREDICTORS)], 0, 0

        def gather():
            data, starts, _ = laid(texts)
            for runs, cell in zip(needs, cells_of(data, starts, prefix_sums(data)), strict=True):
                runs.append(_unique([cell]))
                while len(runs) > 1 and 2 * len(runs[-1]) > len(runs[-2]):
                    runs[-2:] = [_unique(runs[-2:])]
            texts.clear()

        def requests():
            if texts:
                gather()
            ks, blobs = [], []
            for m, runs in enumerate(needs):
                cell = _unique(runs)
                runs.clear()
                edge = _edges(cell)
                for b in np.flatnonzero(np.diff(edge)).tolist():
                    ks.append(m << BLOCK_BITS | b)
                    blobs.append(_packed(cell[edge[b] : edge[b + 1]]))
            return rows(0, ks, blobs)

        def rows(kind, ks, blobs):
            n = len(ks)
            return pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array(ks, pa.int64()), pa.array(blobs, pa.binary())], names=["chunk", "kind", "k", "blob"])

        for batch in batches:
            for part in _slices(batch):
                lower = [t.lower() for t in part.column(2).cast(pa.binary()).to_pylist()]
                piece = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lower, pa.binary())], names=["doc_id", "held_out", "text"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema, options=options) as w:
                    w.write_batch(piece)
                yield rows(1, [0], [sink.getvalue().to_pybytes()])
                texts.extend(lower)
                size = sum(map(len, lower)) + len(lower)
                held, seen = held + size, seen + size
                if held > 400_000:
                    gather()
                    held = 0
                if seen > CHUNK:
                    yield requests()
                    chunk, seen, held = chunk + 1, 0, 0
        if seen:
            yield requests()
        give_back()

    return docs.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"), text_or_empty().alias("text")).mapInArrow(run, ASKED)


def _answered(asked: DataFrame, model: DataFrame) -> DataFrame:
    """To each request for cells of a block (kind 0), their log-odds in the cells' order, eight bytes a cell."""

    def run(batches):
        pack = pa.Codec("zstd", compression_level=3)
        last, cell, n, asked, held = None, None, None, [], 0

        def found():
            """The answers to some requests for one block; cells that several ask for are looked up once."""
            need = _unique([x for _, x in asked])
            odds = odds_toward(cell, n, need, SMOOTH[last >> BLOCK_BITS])
            out = [pack.compress(odds[np.searchsorted(need, x)].tobytes(), asbytes=True) for _, x in asked]
            size = len(asked)
            return pa.RecordBatch.from_arrays([pa.array([last] * size, pa.int64()), pa.array([c for c, _ in asked], pa.int64()), pa.array(out, pa.binary())], names=["k", "chunk", "blob"])

        for batch in batches:
            for k, chunk, blob in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                if asked and (chunk < 0 or k != last or held > MOST_ASKED):
                    yield found()
                    asked, held = [], 0
                if chunk < 0:  # the model's block comes before the requests
                    last, (cell, n) = k, _unpacked(blob, k)
                elif k == last:  # a block without counts gives no answer
                    asked.append((chunk, _unpacked(blob, k, False)))
                    held += len(asked[-1][1])
        if asked:
            yield found()

    rows = model.select("k", F.lit(-1).cast("bigint").alias("chunk"), "blob").unionByName(asked.filter("kind = 0").select("k", "chunk", "blob"))
    return rows.repartition("k").sortWithinPartitions("k", "chunk").mapInArrow(run, "k bigint, chunk bigint, blob binary")


def _odds_of_answers(needs: list[np.ndarray], answers: dict[int, bytes]) -> list[np.ndarray]:
    """The answers laid beside the cells that a chunk needs; zeros where a block has no answer."""
    out = []
    for m, need in enumerate(needs):
        odds = np.zeros((len(need), 8), np.int8)
        edge = _edges(need).tolist()
        for b, (lo, hi) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            blob = answers.get(m << BLOCK_BITS | b)
            if blob is not None:
                odds[lo:hi] = np.frombuffer(pa.decompress(blob, 8 * (hi - lo), codec="zstd", asbytes=True), np.int8).reshape(-1, 8)
        out.append(odds)
    return out


def score(docs: DataFrame, adapt: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every row.

    Texts whose crc32(doc_id as text) mod 5 is 1 are held out; all others train, copies as often as they stand. Null texts
    count as empty: their end is scored. A null doc_id counts as the empty text. Repeated rows stay, each on its own; an
    empty table gives no rows; other columns are not read. ``score`` is the log10 probability of
    the text's bytes, with A-Z lower-cased, and its end. ``adapt``: the predictors take in the text's bits as they come and
    the mixed probability is refined; without it they stay as trained, and only the weights change.
    """
    spark = docs.sparkSession
    trained = materialize(_train(docs))
    words = materialize(trained.filter("kind = 0").groupBy("k").agg(F.sum("n").alias("c")))
    n_all, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    denominator = n_all + 0.5 * (v + 1)
    top = words.orderBy(F.desc("c"), "k").limit(FREQUENT)
    top = top.toPandas().sort_values("k")  # FREQUENT rows of two numbers at most
    log = lambda c: np.log10((c + 0.5) / denominator)
    model = spark.sparkContext.broadcast((top["k"].to_numpy(np.int64), top["c"].to_numpy(np.int64)))
    key = uuid.uuid4().hex
    fields = "doc_id:bigint,held_out:boolean,n_bytes:bigint,n_tokens:bigint,known:bigint,part:double,rare:array<struct<k:bigint,n:int>>"
    schema = f"docs array<struct<{fields}>>, scores array<double>, piece binary"
    constants = [PREDICTORS, RANGES, FIRST_BLOCK, SCALE, RATE, DOUBT, *START_WEIGHTS, *SMOOTH, *HISTORY]
    most_packed = MOST_PACKED if adapt else -1

    def _state():
        k, c = model.value
        return k, log(c.astype(np.float64))

    def run(batches):
        frequent = worker_state(("scorer", key), _state)
        last, answers, parts, chunk = None, {}, [], Chunk()

        def done():
            needs = chunk.needs()
            odds = _odds_of_answers(needs, answers)
            for part, found in zip(parts, chunk.scores(needs, odds, adapt, most_packed), strict=True):
                docs = described(*part, *frequent)
                packed = isinstance(found, bytes)
                scores = pa.nulls(1, pa.list_(pa.float64())) if packed else pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))
                whole = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
                yield pa.RecordBatch.from_arrays([whole, scores, pa.array([found if packed else None], pa.binary())], names=["docs", "scores", "piece"])
            give_back()

        for batch in batches:
            for of, kind, k, blob in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
                if of != last:
                    if parts:
                        yield from done()
                    last, answers, parts, chunk = of, {}, [], Chunk()
                if kind == 0:  # a chunk's answers come before its texts
                    answers[k] = blob
                else:
                    for part in pa.ipc.open_stream(blob):
                        texts = part.column(2).to_pylist()
                        length = pa.array([len(t) for t in texts], pa.int64())
                        parts.append((part.column(0), part.column(1), length, *chunk.add(texts)))
        if parts:
            yield from done()

    def described(doc_id, held, length, names, size, k, value):
        order = np.argsort(names)
        x = names[order]
        new = _news(x)
        word, times = x[new], np.diff(new, append=len(x))
        place = np.searchsorted(k, word)
        there = np.flatnonzero(place < len(k))
        there = there[k[place[there]] == word[there]]
        known, part = np.zeros(len(word), bool), np.zeros(len(word))
        known[there], part[there] = True, value[place[there]]
        hit, base = np.empty(len(x), bool), np.empty(len(x))
        hit[order], base[order] = np.repeat(known, times), np.repeat(part, times)
        first = np.r_[0, np.cumsum(size)[:-1]]
        miss = names[~hit]
        miss_n = np.add.reduceat(~hit, first, dtype=np.int64)
        rare = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(miss_n)].astype(np.int32)), pa.StructArray.from_arrays([pa.array(miss), pa.array(np.ones(len(miss), np.int32))], names=["k", "n"]))
        cols = [doc_id, held, length, pa.array(size), pa.array(np.add.reduceat(hit, first, dtype=np.int64)), pa.array(np.add.reduceat(base, first)), rare]
        return pa.StructArray.from_arrays(cols, names=["doc_id", "held_out", "n_bytes", "n_tokens", "known", "part", "rare"])

    summed = materialize(_summed(trained.filter("kind = 1").select("k", "blob")))
    discard(trained)
    asked = materialize(_asking(docs))
    answers = _answered(asked, summed)
    rows = answers.select("chunk", F.lit(0).alias("kind"), "k", "blob").unionByName(asked.filter("kind = 1"))
    rows = rows.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(run, schema)
    if adapt:
        rows = rows.select("docs", F.coalesce("scores", F.call_function(mixer.registered(spark, constants), "piece")).alias("scores"))
    rows = rows.select(F.inline(F.arrays_zip("docs", "scores"))).select("docs.*", F.col("scores").alias("score"))
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()))
    discard(summed, asked)
    rare = rows.select("uid", F.inline("rare")).join(words, "k", "left").groupBy("uid").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"), F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(denominator))).alias("rare_part"))
    out = rows.drop("rare").join(rare, "uid", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(n_all)).cast("bigint").alias("train_tokens"),
        (F.col("part") + F.coalesce("rare_part", F.lit(0.0))).alias("base_score"),
        "score",
        "n_bytes",
        (-F.col("score") * F.lit(math.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def _slices(batch, most_bytes: int = 400_000, most_rows: int = 120):
    """Parts of a batch of limited size, so arrays stay in cache; a long text is a part of its own."""
    size = np.diff(np.frombuffer(batch.column(2).buffers()[1], np.int32)[batch.column(2).offset :][: batch.num_rows + 1])
    at = total = 0
    for i, s in enumerate(size):
        if i > at and (total + s > most_bytes or i - at >= most_rows):
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += s
    if at < batch.num_rows:
        yield batch.slice(at)
