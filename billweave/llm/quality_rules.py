"""Quality rules whose cut-offs follow the data.

Every rule is a ratio of a text. Its cut-off comes from a mergeable quantile sketch (KLL) of that ratio
per language and source: the quartile plus a multiple of the distance between median and quartile. The
quartiles of a source are blended with those of its language, which come from the merged sketches, by the
source's number of texts: ``PRIOR`` texts of a source weigh as much as its language. No source's cut-off
is laxer than its language's by more than that distance once more, so a source that is mostly junk does
not make junk its norm.

Most texts have no symbols and no repeats at all. Counts are therefore raised by one before they are
divided, which makes a ratio say how much of it a text of that length can show: quartiles differ then, and
they differ between sources of long and of short texts.

Native: DataFrame functions only. Texts are measured once; the measures are written to the shared
scratch folder and read for the sketches and again for the join with the cut-offs. Sketches are merged
map-side, so a source with a third of all rows sends one sketch per task.

Edge cases: a null or empty text has no words, fails the base rule and is not kept. Null languages and
sources are groups like any other. A source none of whose texts pass the base rule has no cut-offs.
Repeated rows are judged alike, each on its own. An empty table gives an empty table. Columns of the
input that have a name of the new columns are replaced; others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.llm.common import BLANKS, aside, named, stored, words_of

SYMBOLS = "#*$%&|<>"
#: Groups whose cut-offs are broadcast; above it Spark joins them as any table.
BROADCAST_GROUPS = 20_000
#: Sketch parameter: ranks are exact up to about this many texts, and within 0.1 % beyond.
SKETCH_K = 4096
#: A source with this many texts weighs as much as its language.
PRIOR = 100.0


@dataclass(frozen=True)
class Rule:
    """Reject above ``q75 + reach * (q75 - median)`` and, if ``both``, below the mirror of it.

    ``least`` stands for the distance where all texts are alike; it is far below that of real texts.
    """

    ratio: str
    reach: float
    least: float
    both: bool = False


RULES = (
    Rule("symbol_ratio", 20.0, 1e-4),
    Rule("dup_line_ratio", 15.0, 1e-4),
    Rule("repeat_ratio", 50.0, 1e-4),
    Rule("mean_word_chars", 10.0, 1e-2, both=True),
)
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
QUANTILES = {"lo": 0.25, "mid": 0.5, "hi": 0.75}


def _trigrams(words: Column, n: Column) -> Column:
    part = lambda start: F.slice(words, start, F.greatest(n - 2, F.lit(0)))
    pairs = F.zip_with(part(1), part(2), lambda a, b: F.concat_ws(" ", a, b))
    return F.zip_with(pairs, part(3), lambda a, b: F.concat_ws(" ", a, b))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts in ``MEASURES``.

    Words that lie in a repeated three-word window are found by sorting the windows of the text with
    their places, which is done only where some window repeats.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    has_word = lambda line: line.rlike(f"[^{BLANKS}]")
    step = docs.drop(*MEASURES).withColumns({"_words": words_of(F.col(text)), "_lines": F.filter(F.split(t, "\n", -1), has_word)})
    step = step.withColumn("n_words", F.size("_words"))
    step = step.withColumn("_tri", _trigrams(F.col("_words"), F.col("n_words")))
    step = step.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_tri")) < F.size("_tri"),
            F.array_sort(F.transform("_tri", lambda w, i: F.struct(w.alias("w"), i.alias("i")))),
        ),
    )
    s = F.col("_sorted")
    same = lambda x, k: x["w"].eqNullSafe(F.get(s, k)["w"])
    step = step.withColumn("_hits", F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)))
    places = F.flatten(F.transform("_hits", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return step.withColumns(
        {
            "n_words": F.col("n_words").cast("long"),
            "word_chars": F.length(F.translate(t, BLANKS, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(F.size(F.array_distinct(places)), F.lit(0)).cast("long"),
        }
    ).drop("_words", "_lines", "_tri", "_sorted", "_hits")


def ratios() -> dict[str, Column]:
    """The columns that ``RULES`` look at, from the counts: symbols, repeated lines and repeated words by
    words, each raised by one, and the mean length of a word."""
    raised = lambda count: (F.col(count) + 1).cast("double") / (F.col("n_words") + 1).cast("double")
    length = F.try_divide(F.col("word_chars").cast("double"), F.col("n_words").cast("double"))
    return {
        "symbol_ratio": raised("n_symbols"),
        "dup_line_ratio": raised("n_dup_lines"),
        "repeat_ratio": raised("n_repeat_words"),
        "mean_word_chars": F.coalesce(length, F.lit(0.0)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def cutoffs(measured: DataFrame, rules: tuple[Rule, ...] = RULES, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per language and source with ``<ratio>_lo`` and ``<ratio>_hi`` of every rule, from the
    rows that pass the base rule."""
    sketches = [F.kll_sketch_agg_double(r.ratio, F.lit(SKETCH_K)).alias(r.ratio) for r in rules]
    merged = [F.kll_merge_agg_double(r.ratio).alias(r.ratio) for r in rules]
    quantiles = [F.kll_sketch_get_quantile_double(r.ratio, F.lit(q)).alias(f"{r.ratio}_{n}") for r in rules for n, q in QUANTILES.items()]
    passing = measured.where(~base_failed()).withColumns(ratios())
    groups = passing.groupBy(F.col(lang).alias("_lang"), F.col(source).alias("_source")).agg(*sketches, F.count("*").alias("_n"))
    languages = groups.groupBy("_lang").agg(*merged).select(F.col("_lang").alias("_of"), F.struct(*quantiles).alias("_all"))
    groups = groups.select("_lang", "_source", "_n", F.struct(*quantiles).alias("_own"))
    both = groups.join(languages, groups["_lang"].eqNullSafe(languages["_of"]))
    weight = F.col("_n").cast("double")
    columns = []
    for r in rules:
        everything = {n: F.col("_all")[f"{r.ratio}_{n}"] for n in QUANTILES}
        own = {n: (weight * F.col("_own")[f"{r.ratio}_{n}"] + PRIOR * q) / (weight + PRIOR) for n, q in everything.items()}
        distance = lambda a, b, r=r: r.reach * F.greatest(b - a, F.lit(r.least))
        most = everything["hi"] + 2 * distance(everything["mid"], everything["hi"])
        columns.append(F.least(own["hi"] + distance(own["mid"], own["hi"]), most).alias(f"{r.ratio}_hi"))
        if r.both:
            least = everything["lo"] - 2 * distance(everything["lo"], everything["mid"])
            columns.append(F.greatest(own["lo"] - distance(own["lo"], own["mid"]), least).alias(f"{r.ratio}_lo"))
    return both.select("_lang", "_source", "_n", *columns)


def quality_rules(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    carry: list[str] | None = None,
) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with the counts, ``base_failed`` and ``kept``.

    See the module for nulls, ties and empty input.
    """
    away, back = aside([c for c in (docs.columns if carry is None else carry) if c.lower() not in {*MEASURES, "base_failed", "kept"}])
    plain = docs.select(*away, named(text).alias("_text"), named(lang).alias("_l"), named(source).alias("_s"))
    measured = stored(measures(plain, "_text").drop("_text"), "quality")
    table = stored(cutoffs(measured, rules, "_l", "_s"), "cutoffs")
    if table.count() <= BROADCAST_GROUPS:
        table = F.broadcast(table)
    joined = measured.join(table, F.col("_l").eqNullSafe(F.col("_lang")) & F.col("_s").eqNullSafe(F.col("_source")), "left")
    value, fine = ratios(), F.lit(True)
    for r in rules:
        fine &= F.coalesce(value[r.ratio] <= F.col(f"{r.ratio}_hi"), F.lit(True))
        if r.both:
            fine &= F.coalesce(value[r.ratio] >= F.col(f"{r.ratio}_lo"), F.lit(True))
    return joined.select(*back, *MEASURES, base_failed().alias("base_failed"), (~base_failed() & fine).alias("kept"))
