"""A quality classifier: ordinal cumulative-link regression on graded ratings.

A rating is a grade from 0 up. One weight per hashed feature is shared by all grades, and ordered
thresholds turn the score into the chance of each: P(grade <= k) = logistic(threshold_k - score). A text's
result is its expected grade and the chance that it has the top grade, which decides what is kept.

Features are hashed from words, their beginnings, their shape (symbols, capitals), words said twice in a
row, repeated lines and the length. Their value is log(1 + rate per thousand words).

Fitting: ``MAX_ROWS`` labelled rows at most, those with the smallest hash of their id, a documented bound
as is that of the features (``MAX_FEATURES``, the ones that tell top grades from others best by a
likelihood-ratio test whose bound follows the number of features tested, so that ``BY_CHANCE`` of them
would pass if none told anything; the counts come from Spark with partial sums). Both together bound what the driver holds. All rows of the
table are scored, each task with the weights, which are broadcast.

Edge cases: labels without an id or a rating are left out; without labels, or with a single grade, every
text gets that grade (the top one without labels). Null and empty texts have no words and are scored by
the feature for that. Repeated rows are scored alike; repeated labels count as often as they stand. An
empty table gives an empty table; a column named like a new one is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from math import log1p
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.llm.common import map_batches, stored, texts

DIMENSIONS = 1 << 18
MAX_ROWS = 20_000
MAX_FEATURES = 2_000
#: Of the features tested, so many may pass by chance; the bound on their deviates follows from it.
BY_CHANCE = 1.0
EPOCHS, RATE, DECAY = 600, 0.3, 1e-4
SYMBOLS = "#*$%&|<>!"
EDGES = ".,!?;:" + SYMBOLS
MEMORY = 500_000


def bucket(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass")) % DIMENSIONS


def word_features(word: str) -> tuple[int, ...]:
    """The features of one word as it stands."""
    core = word.lower().strip(EDGES)
    out = [bucket("w" + core)] + [bucket(f"p{core[:m]}") for m in (4, 5, 6, 7) if len(core) > m]
    if any(c in word for c in SYMBOLS):
        out.append(bucket("s"))
    if len(core) > 1 and word.isupper():
        out.append(bucket("u"))
    return tuple(out)


class Features:
    """Counts of a text's features, of those in ``wanted`` if it is given."""

    def __init__(self, wanted: set[int] | None = None) -> None:
        self.wanted, self.memory = wanted, {}

    def of_word(self, word: str) -> tuple[int, ...]:
        if len(self.memory) >= MEMORY:
            self.memory.clear()
        found = word_features(word)
        if self.wanted is not None:
            found = tuple(f for f in found if f in self.wanted)
        self.memory[word] = found
        return found

    def counts(self, text: str | None) -> tuple[dict[int, int], int]:
        """The counts and the number of words."""
        words = (text or "").split()
        known = self.memory
        out = Counter(chain.from_iterable([known[w] if w in known else self.of_word(w) for w in words]))
        n = len(words)
        out[bucket(f"n{n.bit_length()}")] += 1
        if twice := sum(map(str.__eq__, words, words[1:])):
            out[bucket("r")] += twice
        lines = [x for x in (text or "").split("\n") if x.strip()]
        if again := len(lines) - len(set(lines)):
            out[bucket("l")] += again * n // len(lines)
        if self.wanted is not None:
            out = {f: c for f, c in out.items() if f in self.wanted}
        return out, n


@dataclass(frozen=True)
class OrdinalModel:
    weights: dict[int, float]
    thresholds: tuple[float, ...]

    @property
    def grades(self) -> int:
        return len(self.thresholds) + 1

    def scorer(self) -> Callable[[str | None], float]:
        features = Features(set(self.weights))

        def score(text: str | None) -> float:
            counts, n = features.counts(text)
            return sum(self.weights[f] * log1p(1000 * c / max(n, 1)) for f, c in sorted(counts.items()))

        return score

    def chances(self, scores: np.ndarray) -> np.ndarray:
        """P(grade) per text and grade."""
        below = np.stack([_logistic(t - scores) for t in self.thresholds] + [np.ones(len(scores))], axis=1) if self.thresholds else np.ones((len(scores), 1))
        return np.diff(below, axis=1, prepend=0.0)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, grade: Column, doc_id: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS, by_chance: float = BY_CHANCE) -> OrdinalModel:
    """Fit on the labelled rows of ``docs``. ``grade`` is an expression on ``labels``; see the module for
    the bounds."""
    rated = labels.select(F.col(doc_id).alias("_id"), grade.cast("int").alias("_grade")).where("_id IS NOT NULL AND _grade IS NOT NULL")
    chosen = rated.orderBy(F.xxhash64("_id"), "_id", "_grade").limit(max_rows)
    sample = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id").select("_id", "_grade", "text")
    sample = stored(sample, "rated")
    sizes = {r["_grade"]: r["n"] for r in sample.groupBy("_grade").agg(F.count("*").alias("n")).collect()}
    levels = sorted(sizes)
    if len(levels) < 2:
        return OrdinalModel({}, ())
    top, n = levels[-1], sum(sizes.values())
    good, other = sizes[top], n - sizes[top]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, hits = Features(), np.zeros((2, DIMENSIONS), dtype=np.int64)
        for batch in batches:
            for level, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                hits[int(level == top), list(features.counts(body)[0])] += 1
        some = np.flatnonzero(hits.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(hits[0, some]), pa.array(hits[1, some])], ["feature", "other", "good"])

    tested = sample.mapInArrow(tally, "feature bigint, other bigint, good bigint").groupBy("feature").agg(F.sum("good").alias("good"), F.sum("other").alias("other"))
    tested = stored(tested.where(F.col("good") + F.col("other") < n), "tested")
    z = deviate(F.col("good"), F.col("other"), good, other)
    bound = NormalDist().inv_cdf(1 - min(0.5, by_chance / (2 * max(1, tested.count()))))
    used = tested.where(z >= bound).orderBy(F.desc(z), "feature").limit(max(0, MAX_FEATURES)).select("feature")
    columns = sorted(r.feature for r in used.collect())
    wanted = set(columns)

    def chosen_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(wanted)
        for batch in batches:
            found = [features.counts(t) for t in batch.column(2).to_pylist()]
            ids = pa.array([sorted(c) for c, _ in found], pa.list_(pa.int64()))
            values = pa.array([[log1p(1000 * c[f] / max(n, 1)) for f in sorted(c)] for c, n in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids, values], ["id", "grade", "ids", "values"])

    kind = sample.schema["_id"].dataType.simpleString()
    rows = sample.mapInArrow(chosen_counts, f"id {kind}, grade int, ids array<bigint>, values array<double>").toArrow()
    # In the order of the ids, so that sums of fractions do not depend on where rows came from.
    rows = rows.append_column("width", pc.list_value_length(rows["ids"]))
    rows = rows.sort_by([("id", "ascending"), ("grade", "ascending"), ("width", "ascending")])
    owner = np.repeat(np.arange(len(rows)), rows["width"].to_numpy())
    column = np.searchsorted(columns, pc.list_flatten(rows["ids"]).to_numpy())
    value = pc.list_flatten(rows["values"]).to_numpy()
    y = np.searchsorted(levels, rows["grade"].to_numpy())
    weights, thresholds = descend(owner, column, value, y, len(columns), len(levels))
    return OrdinalModel({f: float(w) for f, w in zip(columns, weights, strict=True)}, tuple(thresholds.tolist()))


def deviate(in_good: Column, in_other: Column, good: int, other: int) -> Column:
    """How far apart a feature's shares of two kinds of texts are, in standard deviations: the root of the
    log-likelihood ratio, which holds for rare features too."""
    texts_with, n = in_good + in_other, good + other

    def part(seen: Column, kind: int, among: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * n / (among * kind))).otherwise(F.lit(0.0))

    without = n - texts_with
    ratio = part(in_good, good, texts_with) + part(in_other, other, texts_with) + part(good - in_good, good, without) + part(other - in_other, other, without)
    return F.sqrt(F.greatest(2 * ratio, F.lit(0.0)))


def descend(owner: np.ndarray, column: np.ndarray, value: np.ndarray, y: np.ndarray, width: int, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of largest likelihood, by gradient steps scaled per parameter."""
    n = len(y)
    weights = np.zeros(width)
    shares = np.clip(np.cumsum(np.bincount(y, minlength=grades))[:-1] / n, 1e-6, 1 - 1e-6)
    cuts = np.log(shares / (1 - shares))
    seen_w, seen_c = np.full(width, 1e-8), np.full(grades - 1, 1e-8)
    rows = np.arange(n)
    for _ in range(EPOCHS):
        score = np.bincount(owner, value * weights[column], minlength=n)
        below = np.zeros((n, grades + 1))
        below[:, 1:-1] = _logistic(cuts[None, :] - score[:, None])
        below[:, -1] = 1
        slope = below * (1 - below)
        chance = np.maximum(below[rows, y + 1] - below[rows, y], 1e-9)
        by_score = (slope[rows, y] - slope[rows, y + 1]) / chance
        up = np.zeros((n, grades + 1))
        up[rows, y + 1] += slope[rows, y + 1] / chance
        up[rows, y] -= slope[rows, y] / chance
        step_w = np.bincount(column, value * by_score[owner], minlength=width) / n - DECAY * weights
        step_c = up[:, 1:-1].sum(axis=0) / n
        seen_w += step_w**2
        seen_c += step_c**2
        weights += RATE * step_w / np.sqrt(seen_w)
        cuts = np.maximum.accumulate(cuts + RATE * step_c / np.sqrt(seen_c) + np.arange(grades - 1) * 1e-9)
    return weights, cuts


def classify(docs: DataFrame, model: OrdinalModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with ``expected_grade`` (0 is the lowest), ``p_top``, the chance of the top grade, and
    ``kept`` (``p_top`` at least ``least``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made: dict[str, Callable[[str | None], float]] = {}

    def function(batch: pa.RecordBatch) -> list[pa.Array]:
        if "score" not in made:
            made["score"] = shared.value.scorer()
        chances = shared.value.chances(np.array([made["score"](t) for t in texts(batch, text)], dtype=float))
        grade = chances @ np.arange(chances.shape[1])
        return [pa.array(grade), pa.array(chances[:, -1]), pa.array(chances[:, -1] >= least)]

    return map_batches(docs, [("expected_grade", "double"), ("p_top", "double"), ("kept", "boolean")], function)
