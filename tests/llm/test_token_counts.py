import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from billweave.llm import token_counts as tc

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_are_the_librarys(library):
    rng = random.Random(1)
    letters = "abcAEÉéñΣσς İıﬁ①ẞß́̀가각🎉🏽👩‍👧\n\t  ​\u0085\x1c\x1f0123½²٣'stremlld한国中文ÀK﻿­ªº_-–—«»"
    parts = ["<|startoftext|>", "<|endoftext|>", "'s", "'LL", "<|endoftext|><|startoftext|>", "'re", "ΑΣ", "ΑΣ.", "<|END", "the", " and"]
    count = tc.counter(tc.read_table(PATH))
    texts = ["".join(rng.choice(parts) if rng.random() < 0.2 else rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    texts += ["a" * 20_000, "ab" * 3000, "é" * 2000, " " * 500, "", "\x1c", "x\x1cy z"]
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert count(text) == len(found.ids), text


def merged_plainly(symbols, merges):
    """The count by scanning for the lowest pair again and again."""
    symbols = list(symbols)
    while True:
        pairs = [(m[0], i) for i in range(len(symbols) - 1) if (m := merges.get(symbols[i] << tc.SHIFT | symbols[i + 1]))]
        if not pairs:
            return len(symbols)
        _, i = min(pairs)
        symbols[i : i + 2] = [merges[symbols[i] << tc.SHIFT | symbols[i + 1]][1]]


def test_heap_and_list_equal_plain_merging():
    rng = random.Random(2)
    for _ in range(300):
        merges, n = {}, 6
        for rank in range(rng.randint(1, 25)):
            merges.setdefault(rng.randrange(n) << tc.SHIFT | rng.randrange(n), (rank, n))
            n += rng.random() < 0.9
        word = [rng.randrange(4) for _ in range(rng.randint(1, 40))]
        assert tc.count_word(word[:], merges) == merged_plainly(word, merges)


def test_on_spark(spark, library, monkeypatch):
    rows = [(1, "A few words, é.", 1), (2, None, 1), (3, "", 1), (4, "word " * 2048, 1), (5, "word " * 2049, 1), (5, "word " * 2049, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS int")
    got = sorted(tuple(r) for r in tc.token_counts(df, PATH).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())
    want = [(i, len((t or "").encode()), n, n > 2048) for i, t, _ in rows for n in [len(library.encode(t or "", add_special_tokens=False).ids)]]
    assert got == want
    assert tc.token_counts(df.limit(0), PATH).collect() == []


def test_other_tokenizers_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        tc.read_table(public_tokenizers.path("byte_bpe_50k.json"))
