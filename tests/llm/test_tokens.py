"""Packing and counting against the tokenizer library itself."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from evigraph.llm import bfd_packing, pow2_packing, token_counts, tokens


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_counts(docs, texts, plain, empty):
    rows = token_counts.token_counts(docs, entries=50).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted((str(i), len((t or "").encode()), len(plain(t)), len(plain(t)) > 512) for i, t in texts)
    assert token_counts.token_counts(empty).count() == 0


def test_cache_starts_over(plain):
    e = tokens.Encoder(limit=3)
    for text in ("a b c d e f g a b", "  x\n\n y", "<|endoftext|>", "x<|endoftext|><|endoftext|>y"):
        assert np.frombuffer(e.ids(text), "<u4").tolist() == plain(text)


def test_every_code_point_splits_alike():
    """Characters in the middle of text, of every block: the pattern's classes are the library's."""
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(tokens.default_path()), tokens.Encoder()
    points = [c for c in range(1, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 500):
        text = "".join(f"a{chr(c)}1 {chr(c)} " for c in points[at : at + 500])
        assert np.frombuffer(e.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_pow2(docs, texts, plain, empty):
    pieces = pow2_packing.pack(docs).collect()
    assert len({r.sequence_id for r in pieces}) == len(pieces)
    got = defaultdict(list)
    for r in pieces:
        assert r.length == len(r.ids) // 4 == 2**r.bucket and r.length <= 2048 and r.offset == 0
        got[r.doc_id].append((r.start, r.doc_tokens, r.ids))
    want = defaultdict(list)
    for i, t in texts:
        want[i].append(np.array([*plain(t), 1], "<u4").tobytes())
    for i, whole in want.items():
        joined = b"".join(x[2] for x in sorted(got[i], key=lambda x: (x[1], x[0]))) if len(whole) == 1 else b"".join(x[2] for x in got[i])
        assert len(joined) == sum(map(len, whole))
        if len(whole) == 1:
            assert joined == whole[0] and all(x[1] == len(joined) // 4 for x in got[i])
    assert pow2_packing.pack(empty).count() == 0
    assert pow2_packing.binary_lengths(0, 8) == [] and pow2_packing.binary_lengths(29, 8) == [8, 8, 8, 4, 1]


def test_bfd_round_trip(docs, texts, plain, empty):
    rows = bfd_packing.pack(docs, max_length=256, window_tokens=3000).collect()
    back = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.input_ids, "<u2")
        assert len(ids) == 256 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        assert (ids[r.n_tokens :] == 50256).all()
        pos = bfd_packing.position_ids(r.cu_seqlens, 256)
        assert all(pos[a] == 0 for a in r.position_resets)
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            back[d].append((s, ids[a:b].tolist()))
    want = defaultdict(list)
    for i, t in texts:
        want[i].append([*plain(t), 50256])
    for i, whole in want.items():
        if len(whole) == 1:
            assert sum((p for _, p in sorted(back[i])), []) == whole[0]
        else:
            assert sum(len(p) for _, p in back[i]) == sum(map(len, whole))
    assert bfd_packing.pack(empty).count() == 0


def test_best_fit_is_best():
    """The tree's choice is that of a search through all bins."""
    x, lengths = 7, []
    for _ in range(500):
        x = (x * 1103515245 + 12345) % 2**31
        lengths.append(1 + x % 64)
    bins = bfd_packing.best_fit_decreasing(lengths, 64)
    assert sorted(i for b in bins for i in b) == list(range(500)) and all(sum(lengths[i] for i in b) <= 64 for b in bins)
    free: list[int] = []
    for i in sorted(range(500), key=lambda i: -lengths[i]):
        fits = [c for c in free if c >= lengths[i]]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - lengths[i])
        else:
            free.append(64 - lengths[i])
    assert sorted(free) == sorted(64 - sum(lengths[i] for i in b) for b in bins)


def test_crc_is_of_little_endian_ids(spark, docs, plain, texts):
    from pyspark.sql import functions as F

    row = pow2_packing.pack(docs).filter("doc_id = 10 and start = 0").select("ids", F.crc32("ids").alias("c")).first()
    assert row.c == zlib.crc32(row.ids)


def test_buckets_hold_one_length_each(spark, docs, tmp_path):
    """Written by length and read back: every piece is there, and a folder's sequences have one shape."""
    packed = pow2_packing.pack(docs)
    pow2_packing.write_buckets(packed, str(tmp_path / "packed"))
    back = spark.read.parquet(str(tmp_path / "packed"))
    assert all(r.length == 1 << r.bucket == len(r.ids) // 4 for r in back.collect())
    key = lambda r: (str(r.doc_id), r.start, r.length, bytes(r.ids))
    assert sorted(map(key, back.collect())) == sorted(map(key, packed.collect()))


def test_frequent_pieces_come_from_the_vocabulary():
    table = token_counts.frequent_lengths(entries=2000)
    library = tokens.Encoder().tokenizer
    assert 500 < len(table) <= 2000 and all(len(library.encode(p, add_special_tokens=False).ids) == n for p, n in table.items())
