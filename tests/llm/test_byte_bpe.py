import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from billweave.llm import byte_bpe as bb

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def words():
    return bb.vocabulary(bb.read_ranks(PATH))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bb.read_ranks(PATH), special_tokens={})


def ids(packed):
    return np.frombuffer(packed, dtype="<u4").tolist()


def test_ids_are_the_librarys(words, library):
    rng = random.Random(3)
    letters = "abcAEÉéñΣσς İıﬁ①ẞß́̀가각🎉🏽👩‍👧\n\t  ​\u0085\x1c\x1f0123½²٣'stremlld韓国中文ÀK﻿­ªº_-–—«»"
    parts = ["<|endoftext|>", "'s", "'LL", "'re", "  ", "\r\n", "the", " and", "\x00", "�", " 　x"]
    encoder = bb.Encoder(words, PATTERN)
    texts = ["".join(rng.choice(parts) if rng.random() < 0.2 else rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["a" * 20_000, "ab" * 3000, "é" * 2000, " " * 5000, "", " ", "x" * 40 + " " * 40]
    tokens = {i: t for t, i in bb.read_ranks(PATH).items()}
    for text in texts:
        packed = encoder.encode(text)
        assert ids(packed) == library.encode_ordinary(text), text
        assert bb.decode_ids(packed, tokens).decode() == text


def merged_plainly(raw, ranks):
    """The ids of a piece by merging the lowest-ranked adjacent pair, leftmost first, again and again."""
    if raw in ranks:
        return [ranks[raw]]
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_backtracking_equals_merging_on_random_vocabularies():
    """Small alphabets make many tokens overlap; some tokens are ones that merging never makes."""
    rng, checked, refused, unmade = random.Random(4), 0, 0, 0
    for _ in range(300):
        ranks = {bytes([b]): b for b in range(256)}
        for _ in range(rng.randint(1, 25)):
            known = [t for t in ranks if set(t) <= set(b"abc")]
            token = rng.choice(known) + rng.choice(known)
            if rng.random() < 0.1:
                token += b"ab"
            ranks.setdefault(token, len(ranks) * 3)
        try:
            v = bb.vocabulary(ranks)
        except ValueError:
            refused += 1
            continue
        unmade += bb.NONE in v.left
        encoder = bb.Encoder(v, PATTERN)
        for _ in range(40):
            raw = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30)))
            assert [v.ids[t] for t in encoder.tokens_of(raw)] == merged_plainly(raw, ranks), (raw, ranks)
            checked += 1
    assert checked > 3000 and unmade > 10


def test_other_vocabularies_are_refused():
    ranks = {bytes([b]): b for b in range(256)}
    with pytest.raises(ValueError, match="ranks before a part"):
        bb.vocabulary(ranks | {b"abc": 300, b"ab": 301})
    with pytest.raises(ValueError, match="no token"):
        bb.vocabulary({b"a": 0})
    with pytest.raises(ValueError, match="no token has the id"):
        bb.decode_ids(b"\xff\xff\xff\x7f", {0: b"a"})


def test_long_pieces_take_linear_work(words, library):
    encoder = bb.Encoder(words, PATTERN)
    steps = 0
    own = encoder.beside

    def counted(a, b):
        nonlocal steps
        steps += 1
        return own(a, b)

    encoder.beside = counted
    rng = random.Random(5)
    piece = "".join(rng.choice("abc") for _ in range(200_000))
    assert encoder.tokens_of(piece.encode()) == [words.ids.index(i) for i in library.encode_ordinary(piece)]
    assert steps < 20_000  # pairs of tokens are few and remembered


def test_on_spark(spark, library):
    rows = [(1, "A few words, é.", 1), (2, None, 1), (3, "", 1), (4, "word " * 50_000, 1), (5, "twice", 1), (5, "twice", 1), (None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS int")
    out = bb.decode(bb.encode(df, PATH, PATTERN), PATH)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    assert out.exceptAll(bb.encode_and_decode(df, PATH, PATTERN)).count() == 0
    for r in out.collect():
        assert ids(r.ids) == library.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids(r.ids))
        assert bytes(r.decoded) == (r.text or "").encode()
    assert out.count() == len(rows)
    assert bb.encode(df.limit(0), PATH, PATTERN).collect() == []
    cut = spark.createDataFrame([(None,), (bytearray(b""),)], "ids binary")
    assert [r.decoded for r in bb.decode(cut, PATH).collect()] == [None, bytearray(b"")]


def test_batches_are_bounded(spark, monkeypatch):
    import pyarrow as pa

    from billweave.llm import common

    monkeypatch.setattr(common, "MOST_BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 6, None, "b" * 4, "c", "d" * 50, "", "e" * 9]})
    found = [[len(x or "") for x in part.column(0).to_pylist()] for part in common.slices(batch, "text")]
    assert found == [[6, 0, 4], [1], [50], [0, 9]]
