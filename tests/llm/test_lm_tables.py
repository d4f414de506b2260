"""The model has a cell for each context and next byte that the training texts hold; scores equal those of a plain loop."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from evigraph.llm import lm_scoring


def random_texts(n):
    rng = np.random.default_rng(5)
    return [bytes(rng.integers(97, 123, 500, dtype=np.uint8)) for _ in range(n)]


def trains(k):
    return zlib.crc32(str(k).encode()) % 5 != 1


def before(text, i):
    """The contexts of byte i, as they are: two bytes, four bytes (0 before the text), the word so far."""
    word = i
    while word and text[word - 1 : word] not in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"):
        word -= 1
    pad = bytes(4) + text[max(0, i - 4) : i]
    return pad[-2:], pad[-4:], text[word:i]


def plain_scores(train, texts):
    """Contexts by dictionary, bits one by one, weights after each block: no hashes, no arrays of cells."""
    counts = [defaultdict(Counter) for _ in range(3)]
    for t in train:
        t += b"\0"
        for i in range(len(t)):
            for c, ctx in zip(counts, before(t, i), strict=True):
                c[ctx][t[i]] += 1
    out = []
    for t in texts:
        t += b"\0"
        w = [[x / lm_scoring.SCALE for x in lm_scoring.START_WEIGHTS] for _ in range(8)]
        bias, total, lo, size = [0.0] * 8, 0.0, 0, lm_scoring.FIRST_BLOCK
        while lo < len(t):
            hi = min(lo + size, len(t))
            step, tilt = np.zeros((8, 3)), np.zeros(8)
            for i in range(lo, hi):
                seen = [c.get(ctx, {}) for c, ctx in zip(counts, before(t, i), strict=True)]
                for j in range(8):
                    bit = t[i] >> (7 - j) & 1
                    odds = []
                    for s, smooth in zip(seen, lm_scoring.SMOOTH, strict=True):
                        n = [smooth, smooth]
                        for b, k in s.items():
                            if b >> (8 - j) == t[i] >> (8 - j):
                                n[b >> (7 - j) & 1] += k
                        odds.append(max(-127, min(127, round(lm_scoring.SCALE * math.log(n[1] / n[0])))))
                    p = 1 / (1 + math.exp(-max(-10.0, min(10.0, bias[j] + sum(a * o for a, o in zip(w[j], odds, strict=True))))))
                    total += math.log10(p if bit else 1 - p)
                    tilt[j] += bit - p
                    step[j] += [(bit - p) * o for o in odds]
            rate = lm_scoring.RATE / math.sqrt(1 + lo / lm_scoring.FIRST_BLOCK) / (hi - lo)
            for j in range(8):
                bias[j] += 0.3 * rate * tilt[j]
                w[j] = [a + rate * 0.02 / lm_scoring.SCALE * g for a, g in zip(w[j], step[j], strict=True)]
            lo += size
            size = lo if lo >= 2 * lm_scoring.FIRST_BLOCK else size
        out.append(total)
    return out


def test_scores_are_those_of_a_plain_loop(spark, docs, texts):
    """Nulls, empty and long texts, copies: the query's scores against the loop, which knows no hashes or chunks."""
    lower = [(t or "").encode().lower() for _, t in texts]
    train = [t for (k, _), t in zip(texts, lower, strict=True) if zlib.crc32(("" if k is None else str(k)).encode()) % 5 != 1]
    want = plain_scores(train, lower)
    rows = lm_scoring.score(docs).collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.score) for r in rows)
    want = sorted((str(k), len(t), s) for (k, _), t, s in zip(texts, lower, want, strict=True))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=2e-4)


def test_scores_are_those_of_one_model(spark, monkeypatch):
    """Over several tasks and chunks: the operator's scores equal those by all counts at once."""
    texts = random_texts(1600)
    docs = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id bigint, text string")
    c = lm_scoring.Counts()
    c.add([t for k, t in enumerate(texts) if trains(k)])
    want = lm_scoring.scores_by(c.cells(), texts)
    got = {r.doc_id: r.score for r in lm_scoring.score(docs.repartition(5)).collect()}
    assert [got[k] for k in range(len(texts))] == pytest.approx(want.tolist(), rel=1e-6)


def test_odds_are_those_of_own_counts():
    """An asked cell's log-odds come from its own context's counts, looked up in a plain dictionary."""
    c = lm_scoring.Counts()
    c.add(random_texts(200))
    rng = np.random.default_rng(1)
    for (cell, n), smooth in zip(c.cells(), lm_scoring.SMOOTH, strict=True):
        asked = np.unique(np.r_[rng.choice(cell, 300), rng.choice(cell, 300) ^ np.uint64(19), rng.integers(0, 1 << 40, 50, dtype=np.uint64)])
        counts = defaultdict(dict)
        for x, k in zip(cell.tolist(), n.tolist(), strict=True):
            counts[x >> 8][x & 255] = k
        for x, got in zip(asked.tolist(), lm_scoring.odds_toward(cell, n, asked, smooth).tolist(), strict=True):
            for j in range(8):
                n2 = [smooth, smooth]
                for b, k in counts.get(x >> 8, {}).items():
                    if b >> (8 - j) == (x & 255) >> (8 - j):
                        n2[b >> (7 - j) & 1] += k
                want = lm_scoring.SCALE * math.log(n2[1] / n2[0]) * (1 if x >> (7 - j) & 1 else -1)
                assert abs(got[j] - max(-127, min(127, want))) < 0.51


def test_blocks_are_packed_without_loss():
    c = lm_scoring.Counts()
    c.add(random_texts(50))
    whole = c.cells()
    for k, blob in c.parts():
        cell, n = lm_scoring._unpacked(blob, k)
        mine = whole[k >> lm_scoring.BLOCK_BITS]
        at = np.searchsorted(mine[0], cell)
        assert np.array_equal(mine[0][at], cell) and np.array_equal(mine[1][at], n)
        assert np.array_equal(lm_scoring._unpacked(lm_scoring._packed(cell), k, False), cell)


def test_counts_of_batches_add_up():
    texts = random_texts(30)
    c, whole = lm_scoring.Counts(), lm_scoring.Counts()
    for t in texts:
        c.add([t])
    whole.add(texts)
    assert all(np.array_equal(a, b) for x, y in zip(c.cells(), whole.cells(), strict=True) for a, b in zip(x, y, strict=True))


def test_words_of_odd_texts():
    """Blanks at any place, zero bytes in words, empty texts: the names repeat just where words do; the end comes last."""
    texts = [b"", b" ", b"a", b"  a\tb\n", b"a\x00b a\x00b", b"b\va\fa\rb", "\u00a0é é".encode(), b"x" * 3000 + b" x"]
    data, _, at = lm_scoring.laid(texts)
    names, size = lm_scoring.words_of(data, at, lm_scoring.prefix_sums(data))
    want = [w for t in texts for w in [*t.split(), None]]
    assert size.tolist() == [len(t.split()) + 1 for t in texts] and len(names) == len(want)
    assert len(set(zip(names.tolist(), want, strict=True))) == len(set(names.tolist())) == len(set(want))
    assert {n for n, w in zip(names.tolist(), want, strict=True) if w is None} == {lm_scoring.END_NAME}


def plain_adapted_scores(train, texts):
    """As plain_scores, and the predictors take in each bit after it, and ranges of the mixed log-odds are corrected."""
    lm, clip = lm_scoring, lambda x, most: max(-most, min(most, x))
    counts = [defaultdict(Counter) for _ in range(3)]
    for t in train:
        t += b"\0"
        for i in range(len(t)):
            for c, ctx in zip(counts, before(t, i), strict=True):
                c[ctx][t[i]] += 1
    sure = lambda x: 1 / (1 + math.exp(-x))
    out = []
    for t in texts:
        t += b"\0"
        own = [defaultdict(lambda: [0, 0]) for _ in range(3)]  # bits seen at (context, leading bits)
        w, bias = [[x / lm.SCALE for x in lm.START_WEIGHTS] for _ in range(8)], [0.0] * 8
        change, mass = np.zeros((8, lm.RANGES)), np.zeros((8, lm.RANGES))
        total, lo, size = 0.0, 0, lm.FIRST_BLOCK
        while lo < len(t):
            hi = min(lo + size, len(t))
            step, tilt, learned, doubt = np.zeros((8, 3)), np.zeros(8), np.zeros((8, lm.RANGES)), np.zeros((8, lm.RANGES))
            for i in range(lo, hi):
                ctxs = before(t, i)
                trained = []
                for c, ctx, smooth in zip(counts, ctxs, lm.SMOOTH, strict=True):
                    row = []
                    for j in range(8):
                        n = [smooth, smooth]
                        for b, k in c.get(ctx, {}).items():
                            if b >> (8 - j) == t[i] >> (8 - j):
                                n[b >> (7 - j) & 1] += k
                        row.append(clip(round(lm.SCALE * math.log(n[1] / n[0])), 127))
                    trained.append(row)
                for j in range(8):
                    bit, odds = t[i] >> (7 - j) & 1, []
                    for m in range(3):
                        node = own[m][ctxs[m], j, t[i] >> (8 - j)]
                        o = trained[m][j]
                        if sum(node):
                            strength, p = lm.HISTORY[m] if any(trained[m]) else 2 * lm.SMOOTH[m], sure(o / lm.SCALE)
                            o = clip(round(lm.SCALE * math.log((strength * p + node[1]) / (strength * (1 - p) + node[0]))), 127)
                        odds.append(o)
                        node[bit] += 1
                    z = clip(bias[j] + sum(a * o for a, o in zip(w[j], odds, strict=True)), 10)
                    p, r = sure(z), round(z) + lm.RANGES // 2
                    q = sure(clip(z + change[j][r], 10))
                    total += math.log10(q if bit else 1 - q)
                    learned[j][r] += bit - q
                    doubt[j][r] += q * (1 - q)
                    tilt[j] += bit - p
                    step[j] += [(bit - p) * o for o in odds]
            mass += doubt
            change += learned / (mass + lm.DOUBT)
            rate = lm.RATE / math.sqrt(1 + lo / lm.FIRST_BLOCK) / (hi - lo)
            for j in range(8):
                bias[j] += 0.3 * rate * tilt[j]
                w[j] = [a + rate * 0.02 / lm.SCALE * g for a, g in zip(w[j], step[j], strict=True)]
            lo += size
            size = lo if lo >= 2 * lm.FIRST_BLOCK else size
        out.append(total)
    return out


def test_the_query_adapts_and_refines(spark, docs, texts, tmp_path):
    """op4's scores on nulls, empty and long texts, copies and contexts met over 256 times, against the loop."""
    from evigraph.llm import queries

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    lower = [(t or "").encode().lower() for _, t in texts]
    train = [t for (k, _), t in zip(texts, lower, strict=True) if zlib.crc32(("" if k is None else str(k)).encode()) % 5 != 1]
    want = plain_adapted_scores(train, lower)
    got = sorted((str(r.doc_id), r.n_bytes, r.score) for r in queries.op4_lm_scoring(spark, str(tmp_path)).collect())
    want = sorted((str(k), len(t), s) for (k, _), t, s in zip(texts, lower, want, strict=True))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=2e-4)


def test_own_bits_are_those_of_a_loop(monkeypatch):
    """Small parts, contexts that repeat little and much: what stands before a bit at its node is counted by a dictionary."""
    monkeypatch.setattr(lm_scoring, "PART", 50)
    rng = np.random.default_rng(8)
    data = rng.choice(np.array([0, 32, 97, 98, 101, 225, 255], np.uint8), 700)
    context = rng.choice(90, 700, p=np.r_[0.3, np.full(89, 0.7 / 89)])
    order = np.argsort(context, kind="stable")
    toward, against = lm_scoring._own_bits(data, order, np.bincount(context)[np.unique(context)])
    seen = defaultdict(lambda: [0, 0])
    for i, (c, b) in enumerate(zip(context.tolist(), data.tolist(), strict=True)):
        for j in range(8):
            node, bit = seen[c, j, b >> (8 - j)], b >> (7 - j) & 1
            assert (int(toward[i]) >> 8 * j & 255, int(against[i]) >> 8 * j & 255) == (node[bit], node[1 - bit])
            node[bit] += 1


def test_compiled_and_array_scores_are_equal(spark, docs, monkeypatch):
    """What texts of pieces small enough for the compiled loop get is what arrays give them, to the rounding of single numbers."""
    long = " ".join(f"the {k % 97} of {k * k % 1009}" for k in range(9000)) + "ab" * 4000
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**7, long), (10**7 + 1, "a" * 70_000), (10**7 + 5, "\x00￿" * 50)], "doc_id bigint, text string"))
    got = {}
    for most in (lm_scoring.MOST_PACKED, 0):
        monkeypatch.setattr(lm_scoring, "MOST_PACKED", most)
        got[most] = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.n_bytes, r.score) for r in lm_scoring.score(more, adapt=True).collect())
    compiled, arrays = got.values()
    assert [x[:4] for x in compiled] == [x[:4] for x in arrays]
    assert [x[4] for x in compiled] == pytest.approx([x[4] for x in arrays], rel=5e-5)
