import random

import public_tokenizers
import pytest
import sentencepiece

from billweave.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.read_pieces(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_are_the_librarys(model, library):
    rng = random.Random(1)
    short = [t.replace("▁", " ") for t in model.ids if len(t) < 4][:4000]
    odd = [" ", "  ", "\n", "\x00", "é", "中", "🎉", "́", "▁", "\t", "​", "\r\n", "ﬁ", "0x1F", "<s>", "</s>", "<0x0A>"]
    bodies = ["".join(rng.choice(odd if rng.random() < 0.25 else short) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    bodies += ["a" * 3000, "ab" * 700, " " * 900, "the" * 300, "0123456789" * 50, "\n" * 50, "", " ", "\n"]
    offsets, ids = pieces.Encoder(model).encode(bodies)
    one = pieces.decoder(model)
    for i, body in enumerate(bodies):
        own = ids[offsets[i] : offsets[i + 1]].tolist()
        assert own == library.encode(body), body
        assert one(own) == library.decode(own)
        assert "▁" in body or one(own) == body


def test_a_full_memory_changes_nothing(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 3)
    bodies = ["some words and other words", "and more of these words", "words"] * 3
    encoder = pieces.Encoder(model)
    for body in bodies:
        offsets, ids = encoder.encode([body, body])
        assert ids[: offsets[1]].tolist() == ids[offsets[1] :].tolist() == library.encode(body)


def test_on_spark(spark, library):
    rows = [(1, "A text,  with two blanks.\n", "x"), (2, None, "x"), (3, "", "x"), (4, "a▁b", "x"), (5, "x" * 5000, "x"), (5, "x" * 5000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Piece_IDs string")
    got = sorted(pieces.encoded_and_checked(df, PATH).collect(), key=lambda r: r.doc_id)
    assert [r.piece_ids for r in got] == [library.encode(t or "") for _, t, _ in rows]
    assert [r.round_trip for r in got] == [True, True, True, False, True, True]
    assert pieces.encoded_and_checked(df.limit(0), PATH).collect() == []


def test_other_models_are_refused(monkeypatch):
    monkeypatch.setattr(pieces, "BPE", 1)
    with pytest.raises(ValueError):
        pieces.read_pieces(PATH)
