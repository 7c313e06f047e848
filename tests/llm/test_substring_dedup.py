import random

import pytest

from billweave.llm import substring_dedup as sd

VOCABULARY = [f"word{i}" for i in range(3000)]


def prose(rng, n):
    return " ".join(rng.choices(VOCABULARY, k=n))


def brute(rows, min_words):
    """Texts after cutting, by chunk texts instead of digests and one document after the other."""
    def parts(text):
        raw = text.encode()
        a, b, n = sd.chunks(raw)
        return [(raw[x:y], int(k)) for x, y, k in zip(a, b, n)]

    first = {}
    for doc, text in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        for chunk, _ in parts(text):
            first.setdefault(chunk, doc)
    out = []
    for doc, text in rows:
        left, run, words, seen = [], [], 0, set()
        for chunk, n in parts(text or "") + [(None, 0)]:
            if chunk is not None and (chunk in seen or (doc is not None and first[chunk] < doc)):
                run.append(chunk)
                words += n
            else:
                left += run if words < min_words else []
                left += [chunk] if chunk is not None else []
                run, words = [], 0
            seen.add(chunk)
        out.append((doc, None if text is None else " ".join(b" ".join(left).decode().split())))
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, n_cut string").repartition(3)
    return sd.substring_dedup(df, **kw).collect()


def flat(got):
    return sorted(((r.doc_id, None if r.text is None else " ".join(r.text.split())) for r in got), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(1)
    passages = [prose(rng, 60) for _ in range(5)] + ["\n".join(prose(rng, 12) for _ in range(6))]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 80)) for _ in range(3)]
        for p in rng.sample(passages, rng.randint(0, 2)):
            parts.insert(rng.randint(0, 3), p)
        rows.append((i * 7 % 60, rng.choice([" ", "\n", "\n\n"]).join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, " \n "), (None, passages[0]), (None, passages[0] + "\n" + passages[0]), (105, "é " * 400)]
    got = run(spark, [(*r, "x") for r in rows])
    assert flat(got) == brute(rows, sd.MIN_WORDS)
    texts = {r.doc_id: r.text for r in got}
    assert texts[100] == texts[101] == "" and texts[102] is None and texts[103] == "" and texts[104] == " \n "
    before = dict(rows)
    for r in got:
        if r.doc_id is not None and before[r.doc_id] is not None:
            raw, spans = before[r.doc_id].encode(), r.cut_ranges
            assert r.n_cut == sum(len(raw[a:b].split()) for a, b in zip(spans[::2], spans[1::2]))
            assert r.n_cut > 0 or r.text == before[r.doc_id]


def test_shared_passages_go_from_all_but_the_first_and_the_rest_stays(spark):
    rng = random.Random(2)
    rows, passages, own = [], [prose(rng, 52) for _ in range(40)], {}
    for i in range(400):
        own[i] = (prose(rng, 30), prose(rng, 30))
        rows.append((i, own[i][0] + " " + passages[i % 40] + " " + own[i][1], ""))
    for r in run(spark, rows):
        passage, (head, tail) = passages[r.doc_id % 40], own[r.doc_id]
        if r.doc_id < 40:
            assert r.n_cut == 0
        else:
            assert r.n_cut >= sd.MIN_WORDS
            assert r.text.startswith(head) and r.text.endswith(tail)
            assert passage not in " ".join(r.text.split())


def test_insertions_move_only_the_cuts_near_them():
    rng = random.Random(3)
    words = rng.choices(VOCABULARY, k=2000)
    one, two = " ".join(words).encode(), " ".join([*words[:900], "inserted", *words[900:]]).encode()
    a, b = (set(sd.digests(x, *sd.chunks(x)[:2])) for x in (one, two))
    assert len(a - b) <= 5 and len(b - a) <= 5


def test_short_repeats_stay(spark):
    rng = random.Random(5)
    line = prose(rng, 14)
    rows = [(i, prose(rng, 40) + "\n" + line + "\n" + prose(rng, 40), "") for i in range(30)]
    assert all(r.n_cut == 0 and r.text == t for r, (_, t, _) in zip(sorted(run(spark, rows)), rows))


def test_rows_with_one_id_and_empty_table(spark):
    text = prose(random.Random(6), 60)
    assert [r.text for r in run(spark, [(1, text, ""), (1, text, "")])] == [text, text]
    assert run(spark, []) == []


def test_gear_hash_is_the_rolled_one():
    raw = np_bytes = bytes(random.Random(7).choices(range(256), k=300))
    out, g = sd.gear_hashes(__import__("numpy").frombuffer(np_bytes, dtype="uint8")), [int(x) for x in sd.gear()]
    for i in range(300):
        h = 0
        for b in raw[max(0, i - sd.REACH + 1) : i + 1]:
            h = (h << 1) + g[b]
        assert int(out[i]) == h % 2**64


def test_lines_in_another_order_are_no_shared_passage(spark):
    words = [f"item{i}" for i in range(60)]
    other = random.Random(8).sample(words, 60)
    rows = [(1, "\n".join(words), ""), (2, "\n".join(other), "")]
    # Each of these lines stands in one of the documents before, a longer passage in none.
    rows += [(i, "\n".join(words[i - 3 :: 12]), "") for i in range(3, 15)]
    assert all(r.n_cut == 0 and r.text == t for r, (_, t, _) in zip(sorted(run(spark, rows)), rows))


def test_runs_that_one_document_holds_are_cut_whole(spark):
    rng = random.Random(9)
    for _ in range(6):
        lines = ["\n".join(prose(rng, rng.choice([1, 2, 24, 25])) for _ in range(12)).split("\n") for _ in range(3)]
        rows = []
        for i in range(12):
            parts = []
            for _ in range(5):
                one, a = rng.choice(lines), rng.randrange(12)
                parts += one[a : a + rng.randint(1, 5)]
            rows.append((i, "\n".join(parts), ""))
        chunked = {i: [(raw[a:b], int(n)) for a, b, n in zip(*sd.chunks(raw))] for i, t, _ in rows for raw in [t.encode()]}
        for r in run(spark, rows):
            own, marks = chunked[r.doc_id], set()
            for a in range(len(own)):
                for b in range(a + 1, len(own) + 1):
                    if sum(n for _, n in own[a:b]) >= sd.MIN_WORDS:
                        held = any(x[k : k + b - a] == own[a:b] for i, x in chunked.items() if i < r.doc_id for k in range(len(x)))
                        if held or any(own[k : k + b - a] == own[a:b] for k in range(a)):
                            marks |= set(range(a, b))
            assert r.n_cut == sum(own[k][1] for k in marks)
            assert r.text.split() == b" ".join(own[k][0] for k in range(len(own)) if k not in marks).decode().split()


def test_columns_of_any_name_stay(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, passage, "a", "b"), (2, passage + "\nown words", "a", "b")], "doc_id long, text string, _id string, _repeats string")
    got = {r.doc_id: r for r in sd.substring_dedup(docs).collect()}
    assert got[1].n_cut == 0 and got[2].n_cut == 60 and all((r["_id"], r["_repeats"]) == ("a", "b") for r in got.values())
    with pytest.raises(TypeError, match="doc_id"):
        sd.substring_dedup(docs.selectExpr("'x' AS doc_id", "text"))
