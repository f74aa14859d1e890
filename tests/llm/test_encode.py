import os
import random

import pytest

from idloom.llm import encode as E

pytestmark = pytest.mark.skipif(not os.path.isdir(E.TOKENIZERS), reason="no tokenizers here")

CORPUS = ["", None, "a", "  x  ", "<|endoftext|> is text", "don't 's'll", "a" * 70_000, "中" * 30_000, "'" * 40_000 + "s", " " * 40_000 + "x", "ab12!? " * 9_000, "é" * 5 + "​" + "x" * 33_000]


@pytest.fixture(scope="module")
def enc():
    return E.encoding(f"{E.TOKENIZERS}/{E.VOCABULARY}")


def test_segments_join_exactly(enc):
    rnd = random.Random(4)
    kinds = ["abcdefghij", "aaaaab", "0123456789", " \n\t", "!?-'.", "'", "é中文字", "st"]
    for _ in range(3000):
        s = "".join("".join(rnd.choice(rnd.choice(kinds) if rnd.random() < 0.3 else a) for _ in range(rnd.randint(1, 40))) for a in rnd.choices(kinds, k=rnd.randint(1, 6)))
        assert E.encode_text(enc, s, rnd.choice([8, 12, 16, 24])) == enc.encode_ordinary(s), repr(s)


def test_long_texts_round_trip(enc):
    for s in CORPUS:
        ids = E.encode_text(enc, s, 4096)
        assert ids == enc.encode_ordinary(s or "")
        assert enc.decode(ids) == (s or "")


def test_corpus(spark, enc):
    rows = [(i, t, "clash") for i, t in enumerate(CORPUS)] + [(0, "twice", "clash"), (6, "b" * 70_000, "clash")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in E.encode_corpus(df, "doc_id", "text", spread=8192).collect())
    assert got == sorted((i, enc.encode_ordinary(t or "")) for i, t, _ in rows)
    assert E.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    counts = sorted(map(tuple, E.token_counts(df, "text", spread=8192).collect()))
    assert counts == sorted((i, "clash", len(enc.encode_ordinary(t or ""))) for i, t, _ in rows)


def test_joins_decide(enc, monkeypatch):
    """Ordinary prose of more than a segment is cut within words, so its ids come from the windows of the joins."""
    joins = []
    real = E.join_tokens
    monkeypatch.setattr(E, "join_tokens", lambda *a: joins.append(1) or real(*a))
    s = " ".join(f"Information about customer number {i}, whose organisation's contract wasn't renewed." for i in range(80))
    assert E.encode_text(enc, s) == enc.encode_ordinary(s)
    assert len(joins) >= len(s) // E.SEGMENT - 1
