import random
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from billweave.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(model, markers, codes):
    """The best way through all roles, by trying every one."""
    scores = model.scores(markers, codes)
    best = None
    for way in itertools.product(range(3), repeat=len(markers)):
        total = model.start[way[0]] + scores[0, way[0]]
        total += sum(model.step[a, b] + scores[i + 1, b] for i, (a, b) in enumerate(zip(way, way[1:])))
        best = max(best or (total, way), (total, way))
    return best


@pytest.fixture
def model():
    rng = np.random.default_rng(1)
    log_rows = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return cf.SpeakerModel(log_rows(rng.random(3)), log_rows(rng.random((3, 3))), {k: log_rows(rng.random((3, n))) for k, n in cf.FEATURES.items()})


def test_blocks_give_the_best_way_of_the_whole(model):
    rng = np.random.default_rng(2)
    for n in range(1, 8):
        markers, codes = rng.integers(0, 4, n), rng.integers(0, 100, n)
        want = brute(model, markers, codes)
        scores = model.scores(markers, codes)
        cuts = sorted(set(rng.integers(0, n + 1, 2)) | {0, n})
        parts = [scores[a:b] for a, b in zip(cuts, cuts[1:])]
        matrices = [model.matrix(p) for p in parts]
        whole = cf.joined(matrices)[cf.START]
        assert whole.max() == pytest.approx(want[0])
        way = [r for p, (b, e) in zip(parts, cf.ends(matrices, cf.START, int(whole.argmax()))) for r in model.decode(p, b, e)]
        assert tuple(way) == want[1]


def talks(n, rng):
    rows = []
    for c in range(n):
        at = 0
        if rng.random() < 0.3:
            rows.append((c, at, "system", "You are a helpful program."))
            at += 1
        for _ in range(rng.randint(1, 6)):
            rows.append((c, at, "user", "What about " + " ".join(rng.choices(["this", "that", "these"], k=rng.randint(2, 8))) + "?"))
            rows.append((c, at + 1, "assistant", "\n".join("It is so. " * rng.randint(3, 30) for _ in range(rng.randint(1, 4)))))
            at += 2
    return rows


def test_hidden_roles_are_recovered(spark):
    rng = random.Random(3)
    rows = talks(120, rng)
    shown = [(c, t, r if rng.random() < 0.6 else None, x) for c, t, r, x in rows]
    got = cf.recover_roles(spark.createDataFrame(shown, SCHEMA)).collect()
    right = {(c, t): r for c, t, r, _ in rows}
    hits = [r.speaker == right[r.conv_id, r.turn] for r in got]
    assert len(hits) == len(rows) and sum(hits) / len(hits) > 0.95
    assert all(r.speaker == r.role for r in got if r.role)


def test_a_long_conversation_equals_one_block(spark, monkeypatch):
    rng = random.Random(4)
    rows = talks(3, rng) + [(99, t, rng.choice(["user", "assistant", None, None]), rng.choice(["Why?", "Because. " * 20, "- a\n- b"])) for t in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = sorted(map(tuple, cf.render(cf.recover_roles(df)).select("conv_id", "turn", "speaker", "rendered").collect()))
    monkeypatch.setattr(cf, "BLOCK", 5)
    many = sorted(map(tuple, cf.render(cf.recover_roles(df)).select("conv_id", "turn", "speaker", "rendered").collect()))
    assert one == many


def test_rendering_and_markers(spark):
    rows = [(1, 0, None, "### Human: Hi"), (1, 1, None, "and more"), (1, 2, "bot", "Hello\nthere"), (1, 3, "USER", "Bye"), (2, 0, "system", "S")]
    got = sorted(cf.render(cf.recover_roles(spark.createDataFrame(rows, SCHEMA))).collect(), key=lambda r: (r.conv_id, r.turn))
    whole = "".join(r.rendered for r in got if r.conv_id == 1)
    first = "<|im_start|>user\nHi"
    assert whole.startswith(first) and whole.endswith("<|im_end|>\n<|im_start|>user\nBye<|im_end|>\n")
    assert whole.count("<|im_start|>") == whole.count("<|im_end|>") and "assistant\nHello\nthere" in whole or "assistant\nand more" in whole
    assert got[-1].rendered == "<|im_start|>system\nS<|im_end|>\n"


def test_whole_transcripts(spark):
    text = "System: be brief\n\nUser: How?\nand why?\n\nAssistant: So.\nQ: Again?\nA: So."
    lines = cf.transcript_lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "conv_id long, text string"))
    got = sorted(cf.render(cf.recover_roles(lines)).collect(), key=lambda r: r.turn)
    assert "".join(r.rendered for r in got) == "".join(
        f"<|im_start|>{r}\n{t}<|im_end|>\n"
        for r, t in [("system", "be brief"), ("user", "How?\nand why?"), ("assistant", "So."), ("user", "Again?"), ("assistant", "So.")]
    )


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(None, 0, "user", "a"), (None, None, None, None), (5, 1, "user", "x"), (5, 1, "user", "x"), (5, 1, "assistant", "y"), (5, 10**6, "tool", ""), (5, -3, None, "z" * 50_000)]
    df = spark.createDataFrame([(*r, "s") for r in rows], SCHEMA + ", Speaker string")
    got = cf.render(cf.recover_roles(df)).collect()
    assert len(got) == len(rows) and all(r.speaker in cf.ROLES and r.rendered for r in got)
    assert len({(r.speaker, r.rendered) for r in got if r.text == "x"}) == 1
    assert cf.render(cf.recover_roles(df.limit(0))).collect() == []


def test_no_block_has_more_lines_whatever_the_positions(spark, monkeypatch):
    rng = random.Random(5)
    line = lambda i: (rng.choice(["user", "assistant", None]), f"{rng.choice(['Why', 'So'])} {i}" + rng.choice(["?", "."]))
    rows = [(1, None, *line(i)) for i in range(90)] + [(None, i % 3, *line(i)) for i in range(90)] + [(2, 7, "user", "x")] * 40 + [(c, 0, *line(c)) for c in range(3, 20)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sizes, count = [], cf.count_model

    def counted(blocks):
        sizes.append([r.n for r in blocks.selectExpr("size(lines) AS n").collect()])
        return count(blocks)

    monkeypatch.setattr(cf, "count_model", counted)
    said = lambda: sorted((repr(tuple(r)) for r in cf.render(cf.recover_roles(df)).collect()))
    one = said()
    monkeypatch.setattr(cf, "BLOCK", 8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert said() == one and len(one) == len(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes[0]) == 90 and max(sizes[1]) == 8 and sum(sizes[1]) == 198


def test_lines_are_numbered_across_ranges(spark):
    rows = [(c, at, mark) for c, n in ((None, 50), (1, 1), (2, 120), (3, 3)) for at in range(2) for mark in range(n)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = cf.numbered(spark.createDataFrame(random.Random(6).sample(rows, len(rows)), "conv long, at long, mark long").repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = {None: 50, 1: 1, 2: 120, 3: 3}
    assert len(got) == len(rows) and all(r.n == r.at * sizes[r.conv] + r.mark for r in got)


def test_transcribed_turns(spark):
    rows = [(1, 0, "user", "Hi"), (1, 1, " Assistant", None), (1, 2, "tool", "x"), (1, 3, None, "y"), (1, 4, "system", "z")]
    df = spark.createDataFrame([(*r, "s") for r in rows], SCHEMA + ", _at string")
    got = sorted(cf.transcribed(df, F.col("turn") < 4).collect(), key=lambda r: r.turn)
    assert [r.text for r in got] == ["User: Hi", "Assistant: ", "x", "y", "z"]
    assert [r.given_role for r in got] == [r[2] for r in rows] and "role" not in got[0].asDict() and got[0]["_at"] == "s"


@pytest.mark.parametrize("every, least", [(4, 0.95), (2, 0.9)])
def test_roles_of_the_given_turns_come_back(spark, every, least):
    """One of ``every`` turns of the given table has no marker; its role follows from the model."""
    given = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    lines = cf.transcribed(given.withColumn("marked", F.pmod(F.xxhash64("conv_id", "turn"), F.lit(every)) != 0), F.col("marked"))
    got = cf.recover_roles(lines, role=None).collect()
    open_ = [r for r in got if not r.marked]
    assert len(got) == given.count() and len(open_) > len(got) / (2 * every)
    assert all(r.speaker == r.given_role for r in got if r.marked)
    assert sum(r.speaker == r.given_role for r in open_) / len(open_) >= least


def test_clashing_names(spark):
    taken = ["_conv", "_at", "_mark", "_marker", "_code", "own0", "conv", "n", "block", "a.b", "Is_First"]
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, None, "b"), (None, None, None, None)], SCHEMA).select("*", *[F.lit(c).alias(c) for c in taken])
    got = cf.render(cf.recover_roles(df)).collect()
    assert len(got) == 3 and all(r[c] == c for r in got for c in taken[:-1])
