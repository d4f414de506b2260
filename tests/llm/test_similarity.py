"""Similarity join and repeated strings against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np

from evigraph.llm import parity_join, suffix_dedup


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts):
    sets = [shingles(t) for _, t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    groups = defaultdict(list)
    for k, x in enumerate(label):
        if texts[k][0] is not None:
            groups[x].append(texts[k][0])
    return [(str(i), len(s), min(groups[x], default=None)) for (i, _), s, x in zip(texts, sets, label, strict=True)]


def test_components(docs, texts, empty):
    got = parity_join.link_components(docs).collect()
    key = lambda r: (r[0], r[1], str(r[2]))
    assert sorted(((str(r.doc_id), r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute_components(texts), key=key)
    assert parity_join.link_components(empty).count() == 0


def test_random_sets_never_lose_a_link():
    """Every pair of sets at or over the threshold shares an emitted cell, at sizes around the bands' limits."""
    rng = np.random.default_rng(5)
    linked = 0
    for _ in range(3000):
        n = int(rng.integers(1, 90))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        drop, add = int(rng.integers(0, n // 6 + 2)), int(rng.integers(0, n // 5 + 2))
        b = np.r_[a[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if not both or 100 * both < 80 * (len(a) + len(b) - both) or parity_join.fingerprint(a) == parity_join.fingerprint(b):
            continue
        linked += 1
        assert np.intersect1d(parity_join.cell_keys(a), parity_join.cell_keys(b)).size
        x, y = np.frombuffer(parity_join.sketch(a), np.uint64), np.frombuffer(parity_join.sketch(b), np.uint64)
        w = min(len(x), len(y))
        apart = int(np.bitwise_count(parity_join.fold(x, w) ^ parity_join.fold(y, w)).sum())
        assert apart <= len(a) + len(b) - 2 * both <= parity_join.most_different(len(a), len(b))
    assert linked > 500


def test_blocks_find_what_stars_miss(spark):
    """A member that only links to another than its cell's first one; small blocks, so pairs cross them."""
    from tests.llm.conftest import edited, para

    base = para(5, 200)
    rows = [(k, edited(base, [7 * k, 7 * k + 60, 90 + 3 * k][: 1 + k % 3])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    before, rounds = parity_join.BLOCK, parity_join.ROUNDS
    parity_join.ROUNDS = 1
    parity_join._exhaustive.__defaults__ = (3,)
    try:
        got = {r.doc_id: r.component_id for r in parity_join.link_components(docs).collect()}
    finally:
        parity_join._exhaustive.__defaults__ = (before,)
        parity_join.ROUNDS = rounds
    assert got == {int(i): c for i, _, c in brute_components(rows)}


def test_keep_one(docs, texts):
    kept = parity_join.keep_one(docs)
    assert kept.columns == docs.columns
    comps = brute_components(texts)
    with_words = {c for i, n, c in comps if n}
    rows = kept.collect()
    assert len(rows) == len(with_words) + sum(n == 0 for _, n, _ in comps)


def brute_removal(texts, least=400):
    starts = Counter()
    data = [(t or "").encode() for _, t in texts]
    for d in data:
        starts.update(d[i : i + least] for i in range(len(d) - least + 1))
    out = []
    for (i, _), d in zip(texts, data, strict=True):
        gone = np.zeros(len(d) + 1, bool)
        for s in range(len(d) - least + 1):
            if starts[d[s : s + least]] > 1:
                gone[s : s + least] = True
        runs = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(d) else 0
        out.append((str(i), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone[:-1], strict=True) if not g)).hexdigest()))
    return sorted(out)


def digest(rows):
    return sorted((str(r.doc_id), sum(s["end"] - s["start"] for s in r["__spans"]), len(r["__spans"]), hashlib.sha256(r["__kept"]).hexdigest()) for r in rows)


def test_repeats(docs, texts, empty):
    assert digest(suffix_dedup.remove_repeats(docs).collect()) == brute_removal(texts)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_repeats_by_counting(docs, texts):
    """The path for anchor strings with very many neighbourhoods gives the same."""
    assert digest(suffix_dedup.remove_repeats(docs, most_in_memory=1).collect()) == brute_removal(texts)


def test_shorter_strings(docs, texts):
    assert digest(suffix_dedup.remove_repeats(docs, least=60, gram=20).collect()) == brute_removal(texts, 60)


def shared(rows):
    return sorted((str(r.doc_id), sum(s["end"] - s["start"] for s in r["__shared"]), len(r["__shared"])) for r in rows)


def test_two_lengths_at_once(docs, texts):
    """The finer look changes nothing of the first, and finds what a search for its own length finds."""
    for most in (suffix_dedup.MOST_IN_MEMORY, 1):
        rows = suffix_dedup.remove_repeats(docs, short=240, most_in_memory=most).collect()
        assert digest(rows) == brute_removal(texts)
        assert shared(rows) == [x[:3] for x in brute_removal(texts, 240)]


def test_copies_between_the_lengths(spark):
    """A text of 300 bytes that occurs twice is shared, but holds no string of 400."""
    rows = [(1, "ab c" * 75), (2, "ab c" * 75), (3, "x" * 239), (4, "x" * 239)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), short=240).collect()
    assert digest(got) == brute_removal(rows) and shared(got) == [x[:3] for x in brute_removal(rows, 240)]


def test_cleaned_keeps_columns(docs):
    out = suffix_dedup.cleaned(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)


def test_multikey_quicksort():
    rows = [b"", b"a", b"ab", b"ab", b"abcdefgh", b"abcdefghi", b"abcdefgh\x00", b"\xff", b"b" * 40, b"b" * 41]
    assert [rows[i] for i in suffix_dedup.multikey_quicksort(rows)] == sorted(rows)


def test_large_groups_equal_pairs():
    """The sorted orders give what comparing all pairs gives."""
    rng = np.random.default_rng(4)
    for least in (12, 20):
        pool = [bytes(rng.integers(97, 99, 30).astype(np.uint8)) for _ in range(12)]
        cut = lambda: b"".join(pool[k][: int(rng.integers(1, 12))] for k in rng.integers(0, 12, 3))[:20]
        left, right = [cut() for _ in range(150)], [cut() for _ in range(150)]
        l, r = suffix_dedup.pairwise_common(left), suffix_dedup.pairwise_common(right)
        for i, j in ((0, 1), (5, 90), (17, 140)):
            assert l[i, j] == next((k for k, (x, y) in enumerate(zip(left[i], left[j])) if x != y), min(len(left[i]), len(left[j])))
        hit = l + r >= least
        np.fill_diagonal(hit, False)
        lo, hi = suffix_dedup.extents(left, right, (least + 3, least))[:, 2:].T
        assert (lo == np.where(hit, l, 0).max(axis=1)).all() and (hi == np.where(hit, r, 0).max(axis=1)).all() and hit.any()
