import random

import pytest

from billweave.llm import decontaminate as dc

WORDS = [f"w{i}" for i in range(60)]


def case(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 25)))) for i in range(12)] + [(50, None), (51, "!?"), (None, "w1 w2 w3")]
    docs = []
    for i in range(40):
        words = rng.choices(WORDS, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            item = (rng.choice(items[:12])[1]).split()
            start = rng.randrange(len(item))
            at = rng.randint(0, len(words))
            words[at:at] = item[start : start + rng.choice([5, 12, 30])]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.2 else w for w in words)))
    return docs + [(100, None), (101, ""), (102, "...")], items


def brute(text, items, n):
    words = dc.words_of(text)
    marks, hit = set(), set()
    for item, body in items:
        own = dc.words_of(body)
        size = min(n, len(own))
        for i in range(len(own) - size + 1 if own and item is not None else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[i : i + size]:
                    marks |= set(range(j, j + size))
                    hit.add(item)
    return len(words), sorted(marks), sorted(hit)


def spread(ranges):
    return [i for a, b in zip(ranges[::2], ranges[1::2]) for i in range(a, b)]


@pytest.mark.parametrize("block", [10**6, 40])
def test_hits_and_cuts(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_WORDS", block)
    docs, items = case(block)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, spread(r.hit_ranges), list(r["items"])) for r in dc.find_hits(df, bench, 10).collect()}
    assert got == {i: brute(t, items, 10) for i, t in docs}
    clean = {r.doc_id: r.text for r in dc.remove_hits(df, bench, 10, least_left=0.3).collect()}
    for i, t in docs:
        n, marks, _ = brute(t, items, 10)
        if not marks:
            assert clean[i] == t
        elif i in clean:
            left, hits, _ = brute(clean[i], items, 10)
            assert not hits and 0.3 * n <= left <= n - len(marks)
        else:
            assert len(marks) > 0


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, Items string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in dc.find_hits(df, none).collect()] == [(1, "a b", 2, [], [])]
    assert dc.remove_hits(df, none).collect() == df.collect()
    assert dc.find_hits(df.limit(0), none).collect() == []


def test_cut_keeps_what_is_around():
    assert dc.cut("Keep this, a b c; and that.", [2, 5]) == "Keep this,\n; and that."
    assert dc.cut("a b", [0, 2]) == ""


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(dc, "MULTIPLIER", dc.np.uint64(0))
    windows = dc.TestWindows([(1, "a b c"), (2, "c b a")], 2)
    marks, items = windows.scan([b"a", b"b", b"x", b"b", b"a"])
    assert marks.tolist() == [True, True, False, True, True] and items == {1, 2}


@pytest.mark.parametrize("block", [10**6, 2])
def test_items_without_an_id_mark_words(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_WORDS", block)
    df = spark.createDataFrame([(1, "x a b c y z q r s t"), (2, "d e x e f a b"), (3, "x y z")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b c"), (7, "d e"), (None, "d e"), (None, "e f")], "item_id long, text string")
    got = {r.doc_id: (spread(r.hit_ranges), list(r["items"])) for r in dc.find_hits(df, bench).collect()}
    assert got == {1: ([1, 2, 3], []), 2: ([0, 1, 3, 4], [7]), 3: ([], [])}
    clean = {r.doc_id: " ".join(r.text.split()) for r in dc.remove_hits(df, bench, least_left=0.3).collect()}
    assert clean == {1: "x y z q r s t", 2: "x a b", 3: "x y z"}


def test_columns_of_any_name_stay(spark):
    item = "one two three four five six seven eight nine ten"
    more = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, more + " " + item, "a", "b", "c"), (2, more, "a", "b", "c")], "doc_id long, text string, _words string, _left string, _cut string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in dc.remove_hits(docs, items).collect()}
    assert got[1].text == got[2].text == more and all((r["_words"], r["_left"], r["_cut"]) == ("a", "b", "c") for r in got.values())
    with pytest.raises(TypeError, match="item_id"):
        dc.remove_hits(docs, items.selectExpr("'x' AS item_id", "text"))
