"""Cut-offs that follow the data, and what each rule rejects."""

import math
import random

import pytest
from pyspark.sql import functions as F

from billweave.llm import quality_rules as qr

DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string"
WORDS = [a + b for a in ("lor", "mem", "tas", "vi", "sun", "ker") for b in ("a", "em", "it", "ons", "ulet", "")]


def prose(rng, n, symbols=0, line=12):
    """``n`` words in lines, no three of them alike."""
    words = [rng.choice(WORDS) + rng.choice(WORDS) + str(i) for i in range(n)]
    for i in rng.sample(range(n), symbols):
        words[i] += "#"
    return "\n".join(" ".join(words[i : i + line]) for i in range(0, n, line))


def rows_of(source, n, rng, **how):
    return [(prose(rng, rng.randint(60, 400), **how), "en", source) for _ in range(n)]


def judge(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    return {r.doc_id: r for r in qr.quality_rules(df).collect()}


@pytest.fixture(scope="module")
def given(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    measured = qr.stored(qr.measures(docs), "measured")
    return measured, {(r["_lang"], r["_source"]): r for r in qr.cutoffs(measured).collect()}


def test_cutoffs_are_those_of_sorted_values(given):
    measured, cut = given
    rows = measured.where(~qr.base_failed()).select("lang", "source", *[c.alias(n) for n, c in qr.ratios().items()]).collect()
    pick = lambda of, rule: [sorted(r[rule.ratio] for r in of)[math.ceil(q * len(of)) - 1] for q in (0.25, 0.5, 0.75)]
    assert len(cut) == 80
    for (lang, source), row in cut.items():
        everything = [r for r in rows if r.lang == lang]
        own = [r for r in everything if r.source == source]
        n = len(own)
        for rule in qr.RULES:
            wide = pick(everything, rule)
            a, b, c = ((n * x + qr.PRIOR * y) / (n + qr.PRIOR) for x, y in zip(pick(own, rule), wide))
            reach = lambda x, y, rule=rule: rule.reach * max(y - x, rule.least)
            assert row[f"{rule.ratio}_hi"] == pytest.approx(min(c + reach(b, c), wide[2] + 2 * reach(wide[1], wide[2])))
            if rule.both:
                assert row[f"{rule.ratio}_lo"] == pytest.approx(max(a - reach(a, b), wide[0] - 2 * reach(wide[0], wide[1])))


def test_cutoffs_differ_between_the_given_sources(given):
    """Of 80 groups nearly all have cut-offs of their own, and the least distance decides none of them."""
    measured, cut = given
    for rule in qr.RULES:
        highs = [r[f"{rule.ratio}_hi"] for r in cut.values()]
        assert len(set(highs)) >= 70 and max(highs) > 1.15 * min(highs)
    none = qr.cutoffs(measured, tuple(qr.Rule(r.ratio, r.reach, 0.0, r.both) for r in qr.RULES))
    assert {(r["_lang"], r["_source"]): r for r in none.collect()} == cut


def test_one_text_in_two_sources(spark):
    """A text with some symbols is as usual in the one source and an exception in the other."""
    rng = random.Random(1)
    odd = (prose(rng, 200, symbols=26), "en")
    rows = rows_of("plain", 300, rng) + rows_of("code", 300, rng, symbols=6) + [(*odd, "plain"), (*odd, "code")]
    got = judge(spark, rows)
    assert not got[600].base_failed and not got[600].kept and got[601].kept
    assert sum(r.kept for r in got.values()) >= 598


@pytest.mark.parametrize(
    "text",
    [
        lambda rng: prose(rng, 200, symbols=60),
        lambda rng: prose(rng, 120) + "\nsame" * 25 + "\n" + prose(rng, 120),
        lambda rng: prose(rng, 200) + "\n" + " ".join(f"this is said {i} this is said" for i in range(17)),
        lambda rng: " ".join("x" * 30 + str(i) for i in range(100)),
        lambda rng: " ".join("abcdefghij"[i % 10] + str(i % 9) for i in range(90)),
    ],
    ids=["symbols", "lines", "words", "long", "short"],
)
def test_every_rule_rejects_alone(spark, text):
    rng = random.Random(2)
    rows = rows_of("a", 150, rng) + rows_of("b", 30, rng) + [(text(rng), "en", s) for s in ("a", "b", "new")]
    got = judge(spark, rows)
    assert all(not got[i].base_failed and not got[i].kept for i in (180, 181, 182))
    assert all(got[i].kept for i in range(180))


def test_a_source_of_junk_does_not_make_it_the_norm(spark):
    rng = random.Random(3)
    rows = rows_of("good", 400, rng) + [(prose(rng, 200, symbols=150), "en", "junk") for _ in range(100)]
    got = judge(spark, rows)
    assert not any(got[i].kept for i in range(400, 500)) and all(got[i].kept for i in range(400))


def test_small_and_large_sources_lie_on_one_scale(spark):
    """No switch by size: with more texts of its own a source goes over to its own cut-off step by step."""
    rng = random.Random(4)
    base, highs = rows_of("base", 300, rng), []
    for n in (20, 90, 110, 400):
        rows = base + rows_of("code", n, random.Random(5), symbols=20)
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
        cut = {r["_source"]: r.symbol_ratio_hi for r in qr.cutoffs(qr.measures(df)).collect()}
        highs.append(cut["code"] / cut["base"])
    assert 1 < highs[0] and all(1 < h < 12 for h in highs) and max(highs[1:3]) < 1.5 * min(highs[1:3])


def test_nulls_and_clashing_names(spark):
    taken = ["_words", "_tri", "_l", "_s", "_lang", "_source", "_n", "_lines", "own0", "a.b", "N_WORDS"]
    df = spark.createDataFrame(
        [(1, None, "en", "a"), (2, "", None, None), (2, "", None, None), (3, prose(random.Random(6), 80), None, "a"), (4, "w " * 90_000, "en", None)], SCHEMA
    ).select("*", *[F.lit(c).alias(c) for c in taken])
    got = qr.quality_rules(df)
    assert got.columns == [*df.columns[:-1], *qr.MEASURES, "base_failed", "kept"]
    rows = sorted(got.collect(), key=lambda r: r.doc_id)
    assert [r.kept for r in rows] == [False, False, False, True, False] and rows[1] == rows[2]
    assert all(r[c] == c for r in rows for c in taken[:-1])
    assert qr.quality_rules(df.limit(0)).collect() == []
