import random
from itertools import combinations

import numpy as np
import pytest

from billweave.llm import near_dedup
from billweave.llm.components import components


def shingles(text, size):
    words = text.encode().lower().split() if text else []
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute(rows, size):
    """Component by doc_id and set size by row."""
    parent = {d: d for d, _ in rows if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t, size)) for d, t in rows]
    for (a, s), (b, t) in combinations([x for x in sets if x[0] is not None and x[1]], 2):
        if a != b and 100 * len(s & t) >= 80 * len(s | t):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return sorted(((d, len(s), root(d) if d is not None else None) for d, s in sets), key=repr)


def run(spark, rows, size):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dedup.near_duplicates(df, size).collect()
    for r in got:
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr)


def edited(rng, words, share):
    return " ".join(rng.choice(VOCABULARY) if rng.random() < share else w for w in words)


VOCABULARY = [f"w{i}" for i in range(400)]


@pytest.mark.parametrize("size", [2, 5])
def test_against_brute_force(spark, size):
    rng = random.Random(size)
    texts = []
    for length in (1, 2, 3, 5, 6, 9, 15, 16, 17, 40, 130, 500):
        for _ in range(3):
            words = rng.choices(VOCABULARY, k=length)
            texts += [" ".join(words)] + [edited(rng, words, s) for s in (0.01, 0.02, 0.03, 0.05, 0.08, 0.1)]
            texts += [" ".join(words[: max(1, int(length * s))]) for s in (0.79, 0.8, 0.82, 0.9)]
    texts += [None, "", "  \n\t", "ONE", "one", "Äpfel äpfel", "a b a b a b", "b a b a b a"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert run(spark, rows, size) == brute(rows, size)


def test_repeated_and_missing_ids(spark):
    long = [" ".join(VOCABULARY[i : i + 30]) for i in (0, 100, 200)]
    rows = [(5, long[0]), (5, long[1]), (3, long[0]), (9, long[1] + " x"), (None, long[0]), (None, long[0]), (7, long[2]), (7, long[2]), (8, None)]
    assert run(spark, rows, 2) == brute(rows, 2)


def test_chains_that_only_join_through_a_middle_text(spark):
    """Neighbours share 85 % but the ends do not."""
    words = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 100])) for i in range(30)]
    assert {c for _, _, c in run(spark, rows, 2)} == {0}


def test_large_group_of_copies_and_near_copies(spark):
    rng = random.Random(1)
    words = rng.choices(VOCABULARY, k=60)
    rows = [(i, " ".join(words) if i % 2 else edited(rng, words, 0.02)) for i in range(400)]
    assert run(spark, rows, 2) == brute(rows, 2)


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, component_id string, kept int")
    assert near_dedup.near_duplicates(df).collect() == []
    df = spark.createDataFrame([(1, "a b", "x", 3)], "doc_id long, text string, component_id string, kept int")
    assert [tuple(r) for r in near_dedup.near_duplicates(df).collect()] == [(1, 1, 1, True)]


def test_estimate_is_unbiased_over_size_classes():
    rng = np.random.default_rng(0)
    for n in (4, 12, 40, 300, 3000):
        found = []
        for _ in range(40):
            pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            a, b = np.unique(pool[:n]), np.unique(pool[n // 4 : n // 4 + n])
            k = near_dedup.size_class(len(a))
            found.append(near_dedup.estimate(near_dedup.signature(a, k), near_dedup.signature(b, k), len(a), len(b), k))
        exact = (n - n // 4) / (n + n // 4)
        assert abs(np.mean(found) - exact) < 0.03


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (60, 61), (61, 60), (70, 70)] + [(200, 200 + rng.randint(1, 50)) for _ in range(30)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {got[i] for i in [*range(41), 100]} == {0} and got[61] == got[60] == 60 and got[200] == 200
    assert 70 not in got and {got[b] for a, b in pairs if a == 200} == {200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("block", [5, 1024])
def test_crowds_that_share_a_passage(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(6)
    common, texts = " ".join(rng.choices(VOCABULARY, k=40)), []
    for i in range(60):
        own = [f"o{i}x{k}" for k in range(rng.randint(8, 25))]
        texts.append(common + " " + " ".join(own))
        if i % 3 == 0:
            texts += [common + " " + " ".join(own[:-1] + ["other"]), common + " again " + " ".join(own)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute(rows, 2)
    assert run(spark, rows, 2) == want and len({c for _, _, c in want}) > 30


@pytest.mark.parametrize("cells", [10, 10**7])
def test_blocks_lose_no_pair(monkeypatch, cells):
    monkeypatch.setattr(near_dedup, "CELLS", cells)
    rng, block = random.Random(7), []
    for i in range(80):
        base = block[rng.randrange(i)]["set"] if i and rng.random() < 0.5 else frozenset(rng.sample(range(400), rng.randint(1, 60)))
        own = frozenset(x if rng.random() > 0.06 else rng.randrange(400) for x in base)
        short = np.unique(np.array(sorted(own), dtype=np.uint32)).tobytes()
        block.append({"id": i, "component": i // 3, "own": i % 2, "n": len(own), "short": short, "set": own})
    for across in (False, True):
        got = {tuple(sorted(p)) for p in near_dedup._similar_members(block, across, 80)}
        want = {
            (i, j)
            for i, j in combinations(range(80), 2)
            if i // 3 != j // 3 and (not across or i % 2 != j % 2) and 100 * len(block[i]["set"] & block[j]["set"]) >= 80 * len(block[i]["set"] | block[j]["set"])
        }
        assert want <= got and want


def test_a_stranger_in_a_crowd_costs_each_member_once(spark):
    """20,000 copies and one stranger in a bucket: rows sent grow with the bucket, not with its square."""
    crowd = spark.range(20_000).selectExpr("7L AS key", "id", "IF(id = 9, 9L, 0L) AS component", "50L AS n")
    rows = near_dedup._blocks(crowd)
    assert rows.count() == 19_999 + 1 + 20
    sizes = rows.groupBy("x", "y").count().collect()
    assert len(sizes) == 21 and max(r["count"] for r in sizes) < 1200


def test_long_members_make_small_blocks(spark):
    few = spark.range(64).selectExpr("7L AS key", "id", "id % 2 AS component", "2000000L AS n")
    assert max(r["count"] for r in near_dedup._blocks(few).groupBy("x", "y").count().collect()) < 40


def test_blocks_let_all_different_members_meet(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(8)
    rows = [(k, i, rng.choice([0, 0, 0, 1, 2]) + 100 * k, rng.randint(1, 90)) for k in range(3) for i in range(40 * k + 3)]
    made = near_dedup._blocks(spark.createDataFrame(rows, "key long, id long, component long, n long")).collect()
    met = {}
    for r in made:
        met.setdefault((r.key, r.x, r.y), []).append(r)
    pairs = [(k, *sorted((a.id, b.id))) for (k, x, y), block in met.items() for a in block for b in block if a.id < b.id and a.component != b.component and (x == y or a.own != b.own)]
    want = {(a[0], *sorted((a[1], b[1]))) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] != b[2]}
    assert set(pairs) == want and len(pairs) == len(want)


def test_long_texts_at_the_threshold_leave_a_block():
    """Sets of 270,000 shingles, 80 % alike to the last one, of which equal short hashes hide several."""
    rng = np.random.default_rng(9)
    every = rng.integers(0, 2**64, 300_000, dtype=np.uint64)
    sets = [every[:270_000], np.concatenate((every[:240_000], every[270_000:])), rng.integers(0, 2**64, 270_000, dtype=np.uint64)]
    short = [np.unique((s >> np.uint64(32)).astype(np.uint32)) for s in sets]
    assert min(len(s) - len(t) for s, t in zip(sets, short)) > 2
    block = [{"id": i, "component": i, "own": 0, "n": len(s), "short": t.tobytes()} for i, (s, t) in enumerate(zip(sets, short))]
    assert {tuple(sorted(p)) for p in near_dedup._similar_members(block, False, 80)} == {(0, 1)}


def test_ids_that_are_no_integers_are_refused(spark):
    with pytest.raises(TypeError, match="doc_id"):
        near_dedup.near_duplicates(spark.createDataFrame([("a", "x y z")], "doc_id string, text string"))
