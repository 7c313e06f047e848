import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from billweave.llm import quality_classifier as qc

WORDS = [f"w{i}" for i in range(300)]


def corpus(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        grade = rng.choice([0, 1, 2, 2, 2])
        words = rng.choices(WORDS, k=rng.randint(20, 200))
        if grade < 2:
            words += [rng.choice(["spam", "scam"])] * rng.randint(1, 3) if rng.random() < 0.5 or grade == 0 else [w + "###" for w in words]
        if grade == 0:
            words = [w + "!!!" for w in words]
        rng.shuffle(words)
        rows.append((i, " ".join(words), grade))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows] + [(None, 1), (5, None), (10**9, 2)], "doc_id long, grade int")
    return docs, labels, qc.fit(docs, labels, F.col("grade"))


def test_held_out_texts(spark, fitted):
    model = fitted[2]
    rows = corpus(300, 2)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, grade int, P_TOP string")
    got = qc.classify(df, model).collect()
    assert model.grades == 3 and list(model.thresholds) == sorted(model.thresholds)
    assert np.mean([r.kept == (r.grade == 2) for r in got]) > 0.95
    means = [np.mean([r.expected_grade for r in got if r.grade == g]) for g in range(3)]
    assert means[0] < means[1] < means[2]
    assert all(0 <= r.p_top <= 1 and 0 <= r.expected_grade <= 2 for r in got)


def test_fitting_is_repeatable_and_bounded(spark, fitted):
    docs, labels, model = fitted
    assert qc.fit(docs.repartition(5), labels.repartition(3), F.col("grade")) == model
    small = qc.fit(docs, labels, F.col("grade"), max_rows=200)
    assert small != model and len(small.weights) <= qc.MAX_FEATURES


def test_gradient_is_that_of_the_likelihood():
    """At the fitted point, no small step raises the likelihood by much."""
    rng = np.random.default_rng(3)
    n, width = 400, 3
    x = rng.random((n, width))
    score = x @ np.array([3.0, -2.0, 0.5])
    y = np.searchsorted([0.2, 1.4], score + rng.logistic(size=n) * 0.7)
    owner, column = np.repeat(np.arange(n), width), np.tile(np.arange(width), n)
    weights, cuts = qc.descend(owner, column, x.ravel(), y, width, 3)

    def loss(w, c):
        below = np.concatenate([np.zeros((n, 1)), qc._logistic(np.asarray(c)[None, :] - (x @ w)[:, None]), np.ones((n, 1))], axis=1)
        return -np.log(below[np.arange(n), y + 1] - below[np.arange(n), y]).mean() + qc.DECAY / 2 * (w**2).sum()

    here = loss(weights, cuts)
    for k in range(width):
        for d in (-0.05, 0.05):
            assert loss(weights + d * np.eye(width)[k], cuts) > here - 1e-4
    assert weights[0] > 0 > weights[1]


def test_edge_cases(spark, fitted):
    docs, labels, model = fitted
    df = spark.createDataFrame([(1, None), (2, ""), (3, "w1 " * 50_000), (3, "w1 " * 50_000)], "doc_id long, text string")
    got = sorted(qc.classify(df, model).collect(), key=lambda r: r.doc_id)
    assert got[0][2:] == got[1][2:] and got[2] == got[3]
    assert qc.classify(df.limit(0), model).collect() == []
    none = qc.fit(docs, labels.limit(0), F.col("grade"))
    assert {(r.expected_grade, r.p_top, r.kept) for r in qc.classify(df, none).collect()} == {(0.0, 1.0, True)}


def test_few_labels_give_features(spark):
    """Some ninety labels, as the smallest tables have."""
    rows = corpus(90, 4)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = qc.fit(docs, spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int"), F.col("grade"))
    held_out = corpus(300, 5)
    got = qc.classify(spark.createDataFrame(held_out, "doc_id long, text string, grade int"), model).collect()
    assert model.weights and np.mean([r.kept == (r.grade == 2) for r in got]) > 0.85


def test_labels_that_tell_nothing_give_hardly_any_feature(spark):
    rows = corpus(400, 6)
    rng = random.Random(7)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = qc.fit(docs, spark.createDataFrame([(r[0], rng.choice([0, 1, 2])) for r in rows], "doc_id long, grade int"), F.col("grade"))
    assert len(model.weights) <= 5


def test_deviates_are_those_of_the_likelihood(spark):
    rows = [(0, 10), (3, 0), (11, 76), (5, 38), (11, 0)]
    got = spark.createDataFrame(rows, "a int, b int").select(qc.deviate(F.col("a"), F.col("b"), 11, 76).alias("z")).collect()

    def best(hits, n):
        return sum(x * np.log(x / n) for x in (hits, n - hits) if x)

    for (a, b), r in zip(rows, got):
        assert r.z == pytest.approx(max(0, 2 * (best(a, 11) + best(b, 76) - best(a + b, 87))) ** 0.5, abs=1e-6)
