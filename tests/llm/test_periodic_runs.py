import random

import numpy as np
import pytest

from billweave.llm import periodic_runs as pr


def plain_runs(codes):
    """Runs by comparing every word with every later one: maximal equal stretches for each period, and of
    those that cover the same words the one with the smallest period."""
    found = {}
    for q in range(1, len(codes) // pr.TIMES + 1):
        i = 0
        while i + q < len(codes):
            j = i
            while j + q < len(codes) and codes[j] == codes[j + q]:
                j += 1
            if j > i and j - i + q >= max(pr.LEAST, pr.TIMES * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def runs_of_tiles(codes):
    """The runs by tiles, stitched here as ``stitched`` does."""
    stretches = {}
    for octave, _, first, at, words in pr.tiles(np.array(codes)):
        for period, start, end in pr.solved(octave, first, at.tolist(), words.tolist()):
            stretches.setdefault(period, []).append((start, end))
    found = []
    for period, parts in stretches.items():
        parts.sort()
        whole = [list(parts[0])]
        for start, end in parts[1:]:
            if start > whole[-1][1]:
                whole.append([start, end])
            whole[-1][1] = max(whole[-1][1], end)
        found += [(s, e - s + period, period) for s, e in whole if e - s + period >= max(pr.LEAST, pr.TIMES * period)]
    return sorted(found)


def samples(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        letters, out = rng.randint(1, 4), []
        while len(out) < rng.randint(0, 300):
            if rng.random() < 0.5:
                out += [rng.randrange(letters) for _ in range(rng.randint(1, 12))]
            else:
                unit = [rng.randrange(letters) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 21, 40]))]
                if rng.random() < 0.2:
                    unit = unit * rng.randint(1, 3) + unit[: rng.randint(0, len(unit))]
                out += (unit * 9)[: int(len(unit) * rng.uniform(1, 8))]
        yield out


@pytest.mark.parametrize("tile", [1, 8, 1024])
def test_tiles_find_all_runs(monkeypatch, tile):
    monkeypatch.setattr(pr, "TILE", tile)
    many = 0
    for codes in samples(tile, 1200):
        want = plain_runs(codes)
        assert runs_of_tiles(codes) == want, codes
        many += len(want) > 3
    assert many > 100


def test_structured_texts(monkeypatch):
    monkeypatch.setattr(pr, "TILE", 16)
    fibonacci = [0]
    last = [0, 1]
    for _ in range(12):
        fibonacci, last = last, last + fibonacci
    for codes in [[0] * 700, [0] * 5, [0] * 6, [0, 1] * 200, ([0] * 50 + [1]) * 9, last[:400], [0] * 99 + list(range(1, 90)) * 5, list(range(100)), []]:
        assert runs_of_tiles(codes) == plain_runs(codes)


def test_work_is_linear_up_to_octaves(monkeypatch):
    rng = random.Random(1)
    unit = [rng.randrange(1000) for _ in range(3000)]
    for codes in ([0] * 30_000, unit * 10, [0, 1, 2] * 10_000):
        made = list(pr.tiles(np.array(codes)))
        fragments = sum(len(pr.solved(o, f, at.tolist(), w.tolist())) for o, _, f, at, w in made)
        assert fragments < 100
        assert sum(len(w) for *_, w in made) < 8 * len(codes) * 15
        assert all(len(w) < 3 * pr.TILE for o, *_, w in made if o < 8)


def collapsed(text):
    words = (text or "").split()
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def test_on_spark(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "no run here at all"), (5, "a\tb\n" * 9 + "a"), (5, "a\tb\n" * 9 + "a"), (None, "x " * 50), (7, "é ß " * 5 + "é " * 20)]
    rows += [(10 + i, " ".join(f"w{c}" for c in codes)) for i, codes in enumerate(samples(9, 60))]
    rows += [(100, " ".join(["long"] * 30_000 + [f"u{i % 4000}" for i in range(20_000)]))]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, RUNS int, _key int, possible int").repartition(3)
    out = pr.collapse_runs(df)
    assert out.columns == ["doc_id", "text", "_key", "possible", "runs", "collapsed"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        found = [tuple(x) for x in r.runs]
        if r.doc_id == 100:
            assert found == [(0, 30_000, 1), (30_000, 20_000, 4000)]
            assert len(r.collapsed.split()) == 4001
        else:
            assert (found, r.collapsed) == collapsed(r.text), r.text
    assert pr.collapse_runs(df.limit(0)).collect() == []


def test_a_text_of_many_rows(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('again and ', 30) ELSE concat('text ', id) END AS text")
    out = pr.collapse_runs(df)
    assert {(r.collapsed, r["count"]) for r in out.where("size(runs) > 0").groupBy("collapsed").count().collect()} == {("again and", 1000)}
    assert out.where("size(runs) = 0").count() == 2000
