import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from packetlog.llm import tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter():
    return tokencount.TokenCounter(tokencount.load_vocabulary(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_whole_tokens_are_proven(counter, library):
    words = [w for w, n in dict(counter).items() if n == 1][::97]
    assert words and all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in words if w.strip())


def test_random_texts_as_the_library(counter, library):
    rng = random.Random(5)
    pool = ["<|endoftext|>", " ", "  ", "\n", "\t", "\r\n", "a", "'s", "'ll", "the", " The", "é", "漢字", "😀", "123", "!!", " ", "　",
            "x" * 300, "the" * 100, "\x00", "\x85", "​", "<|endoftext", "|>", "ab.\nCd", "ſ", "٣"]
    for _ in range(1500):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_long_words_take_the_heap(counter, library):
    for word in ("abcdefghij" * 500, "ä" * 400, "zq" * 3000):
        assert counter.count(word) == len(library.encode(word, add_special_tokens=False).ids)


def test_operator(spark, docs, empty, library):
    texts = ["", None, "Hello world", "Hello world", "a b  c\n" * 400, "é" * 10]
    rows = tokencount.count_tokens(docs([*enumerate(texts), (None, "x"), (2, "Hello world")]), PATH, limit=100).collect()
    want = [(k, len((t or "").encode()), len(library.encode(t or "").ids)) for k, t in [*enumerate(texts), (None, "x"), (2, "Hello world")]]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in rows), key=key) == sorted(want, key=key)
    assert all(r.over_limit == (r.n_tokens > 100) for r in rows)
    assert tokencount.count_tokens(empty, PATH).count() == 0
