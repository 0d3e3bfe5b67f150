import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from testlog.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABET = [
    "'", "s", "t", "r", "e", "v", "l", "m", "d", " ", "  ", "\n", "\t", "\r\n", "a", "é", "1", "٣", "#", "!",
    " ", "　", "😀", "中", "S", "Re", "\x00", "\x1c", "́", "½", "'ll",
]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(merger, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in merger.encode_texts(texts)]


def test_matches_the_library_on_random_texts(ranks, library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    merger = bpe.Merger(ranks)
    assert ids_of(merger, texts) == [library.encode_ordinary(t) for t in texts]


def test_windows_and_long_slices(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW", 150)
    rng = random.Random(2)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 1500))) for _ in range(60)]
    texts += ["a" * 3000, " " * 2000 + "x", "\n" * 999 + " b", "'re" * 700, "", "ab" * 900 + " " + "é" * 500]
    merger = bpe.Merger(ranks)
    for text, ids in zip(texts, ids_of(merger, texts)):
        assert ids == library.encode_ordinary(text)
        packed = np.array(ids, np.int64)
        assert merger.decode(packed, merger.ends_of(packed)) == text.encode()


def test_every_class_of_character(ranks, library):
    rng = random.Random(3)
    points = [c for c in rng.sample(range(0x110000), 20000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}a 1{chr(c)}{chr(c)} {chr(c)}!" for c in points]
    assert ids_of(bpe.Merger(ranks), texts) == [library.encode_ordinary(t) for t in texts]


def test_small_cache_changes_nothing(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_SLICES", 3)
    texts = ["one two three four five", "one two", "six one"] * 3
    assert ids_of(bpe.Merger(ranks), texts) == [library.encode_ordinary(t) for t in texts]


def test_tables(spark, library):
    rows = [(1, "Hello world", 7), (2, None, 8), (3, "", 9), (1, "Hello world", 7), (None, "x" * 5000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    tokens = bpe.encode(docs, PATH)
    assert tokens.columns == ["doc_id", "ids", "ends"]
    out = bpe.decode(tokens.selectExpr("*", "1 AS decoded"), PATH).collect()
    assert len(out) == 5
    for row in out:
        text = {1: "Hello world", 2: "", 3: "", None: "x" * 5000}[row.doc_id]
        assert bytes(row.decoded) == text.encode()
        assert np.frombuffer(row.ids, "<u4").tolist() == library.encode_ordinary(text)
        assert np.frombuffer(row.ends, "<u4").tolist()[-1:] == ([len(text)] if text else [])
    empty = bpe.decode(bpe.encode(docs.limit(0), PATH), PATH)
    assert empty.count() == 0
