"""Byte-level BPE through caches of pre-tokens: each distinct pre-token is encoded once by the library."""

from __future__ import annotations

import os
from array import array

from .common import worker_state

#: Fixed value: the pre-token pattern of the byte-level BPE vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens longer than this are encoded but not kept.
LONGEST_KEPT = 48
#: Entries of the younger half of a worker's cache, at most (some 170 MB; the older half is no larger).
CACHE_LIMIT = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Gives a text's ids as little-endian uint32 bytes, equal to the library's without added special tokens."""

    def __init__(self, path: str | None = None, seed: dict[str, bytes] | None = None, limit: int = CACHE_LIMIT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.split = regex.compile(PATTERN).findall
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = {s: array("I", [self.tokenizer.token_to_id(s)]).tobytes() for s in special}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None
        self.cache = Cache(self.tokenizer, seed or {}, limit)

    def pieces(self, text: str):
        """The pre-tokens between the special strings in a text, and those strings' ids."""
        if self.special_split is None or not any(s in text for s in self.special):
            yield text, None
            return
        for part in self.special_split(text):
            if part in self.special:
                yield None, self.special[part]
            elif part:
                yield part, None

    def ids(self, text: str) -> bytes:
        get, out = self.cache.__getitem__, []
        for part, special in self.pieces(text):
            out.append(special if part is None else b"".join(map(get, self.split(part))))
        return b"".join(out)


class Cache(dict):
    """Pre-tokens met lately: when full, the entries become the older half; what is met again moves back."""

    def __init__(self, tokenizer, seed, limit):
        super().__init__(seed)
        self.tokenizer, self.limit, self.older = tokenizer, limit, {}

    @staticmethod
    def made(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        value = self.older.get(piece)
        if value is None:
            value = self.made(self.tokenizer.encode(piece, add_special_tokens=False).ids)
            if len(piece) > LONGEST_KEPT:
                return value
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[piece] = value
        return value


def worker_encoder(path: str, limit: int = CACHE_LIMIT) -> Encoder:
    """One encoder for each Python worker, kept between tasks."""
    return worker_state(("encoder", path, limit), lambda: Encoder(path, limit=limit))
