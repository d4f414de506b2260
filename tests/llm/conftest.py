import pytest


def para(seed: int, words: int) -> str:
    """Pseudo-random words from a small recurrence: no library's generator is involved."""
    x, out = seed * 2654435761 % 2**32 + 1, []
    for _ in range(words):
        x = (x * 1664525 + 1013904223) % 2**32
        y, w = x >> 8, ""
        for _ in range(2 + y % 3):
            y //= 7
            w += ("ba", "re", "ti", "on", "és", "lu", "mk")[y % 7]
        out.append(w)
    return " ".join(out)


def edited(text: str, places: list[int]) -> str:
    words = text.split(" ")
    for p in places:
        words[p % len(words)] = f"Edit{p}"
    return " ".join(words)


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): nulls, blanks, ties, copies, near copies, shared passages, special strings and long texts."""
    base, passage = [para(k, 60 + 37 * k) for k in range(8)], para(99, 90)
    rows = [(None, None), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three four"), (6, "ONE two three  four"), (7, "a b c d e"), (7, "a b c d e"), (8, "x" * 450), (9, "ab " * 300)]
    rows += [(10 + k, t) for k, t in enumerate(base)]
    rows += [(20 + k, t) for k, t in enumerate(base[:4])]
    rows += [(30 + k, edited(base[5], [40 + 31 * k])) for k in range(6)]
    rows += [(40 + k, edited(base[7], list(range(k, 40 * k, 37)))) for k in range(1, 5)]
    rows += [(50 + k, para(200 + k, 40) + "\n" + passage + "\n" + para(300 + k, 30 + k)) for k in range(5)]
    rows += [(60, "tail<|endoftext|>more  <|endoftext|>\r\n\u00a0\u3000x \U0001f600 it's WE'LL 123 ½²"), (61, "é" * 300 + " " + passage), (62, " ".join(base) + "\n" + " ".join(base[::-1])), (62, "another text"), (None, "a text without an id " * 30)]
    rows += [(63, "THE END!! " * 40), (64, "same line here\nsame line here\n\n \nother # * $ % & | < >")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With columns whose names the operators use too."""
    rows = [(i, t, ("en", "de", None)[k % 3], f"s{k % 2}", len(t) if t is not None else None, 7, "f", 0, k) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens int, f string, key int, component_id int").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
