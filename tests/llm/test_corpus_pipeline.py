"""The pipeline against a plain version of every stage, on the smallest tables and a few odd rows."""

import math

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from billweave.llm import decontaminate, quality_rules, substring_dedup
from tests.llm import test_near_dedup, test_substring_dedup

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_quality(rows):
    judged = []
    for row in rows:
        text = row[1] or ""
        words = text.split()
        lines = [x for x in text.split("\n") if x.split()]
        seen, hit = {}, set()
        for i in range(len(words) - 2):
            seen.setdefault(tuple(words[i : i + 3]), []).append(i)
        for places in seen.values():
            if len(places) > 1:
                hit |= {p + k for p in places for k in range(3)}
        n = len(words)
        ratios = (
            (sum(text.count(c) for c in quality_rules.SYMBOLS) + 1) / (n + 1),
            (len(lines) - len(set(lines)) + 1) / (n + 1),
            (len(hit) + 1) / (n + 1),
            sum(map(len, words)) / n if n else 0.0,
        )
        judged.append((row, n < 50 or 100 * len(hit) > 50 * n, ratios))

    def quartiles(chosen, k):
        values = sorted(x[2][k] for x in chosen)
        return [values[max(1, math.ceil(q * len(values))) - 1] for q in (0.25, 0.5, 0.75)]

    kept = []
    for row, failed, ratios in judged:
        if failed:
            continue
        language = [x for x in judged if not x[1] and x[0][2] == row[2]]
        group = [x for x in language if x[0][3] == row[3]]
        fine = True
        for k, r in enumerate(quality_rules.RULES):
            wide, n = quartiles(language, k), len(group)
            a, b, c = ((n * x + quality_rules.PRIOR * y) / (n + quality_rules.PRIOR) for x, y in zip(quartiles(group, k), wide))
            lo = max(a - r.reach * max(b - a, r.least), wide[0] - 2 * (r.reach * max(wide[1] - wide[0], r.least)))
            hi = min(c + r.reach * max(c - b, r.least), wide[2] + 2 * (r.reach * max(wide[2] - wide[1], r.least)))
            fine &= ratios[k] <= hi and (not r.both or ratios[k] >= lo)
        if fine:
            kept.append(row)
    return kept


def plain_near_dedup(rows):
    component = {d: c for d, _, c in test_near_dedup.brute([r[:2] for r in rows], 5)}
    first = {}
    for r in sorted(rows, key=lambda r: r[1]):
        if component[r[0]] == r[0]:
            first.setdefault(r[0], r)
    return list(first.values())


def words_in(text):
    return decontaminate.words_of(text)


def plain_hits(text, windows):
    words = words_in(text)
    hit = set()
    for i in range(len(words)):
        for size in {len(w) for w in windows}:
            if tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
    return words, hit


def plain_windows(items):
    out = set()
    for text in items:
        words = words_in(text)
        size = min(10, len(words))
        out |= {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()
    return out


def plain(rows, items):
    out = [plain_quality(rows)]
    out.append(plain_near_dedup(out[-1]))
    cut = dict(test_substring_dedup.brute([r[:2] for r in out[-1]], substring_dedup.MIN_WORDS))
    out.append([(r[0], cut[r[0]]) for r in out[-1] if cut[r[0]] or not r[1]])
    return out


def words(text):
    return " ".join(text.split())


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    some = [r for r in docs.collect() if r.n_chars > 2000][:3]
    extra = [
        (10_001, None, "en", "src0", 0),
        (10_002, "", None, None, 0),
        (some[0].doc_id, some[0].text, some[0].lang, some[0].source, 1),
        (10_003, some[1].text + " more", some[1].lang, None, 1),
        (10_004, "Only here. " + some[2].text[:1200] + " And " + " ".join(f"w{i}" for i in range(80)), some[2].lang, "src0", 1),
    ]
    rows = docs.unionAll(spark.createDataFrame(extra, SCHEMA))
    out = [rows]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.stored(stage(spark, out[-1], DIR), "stage"))
    return out


def test_stages_equal_their_plain_versions(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    want = plain([tuple(r) for r in stages[0].collect()], items)
    assert sorted(r.doc_id for r in stages[1].collect()) == sorted(r[0] for r in want[0])
    assert sorted((r.doc_id, r.text) for r in stages[2].collect()) == sorted(r[:2] for r in want[1])
    cut = {r.doc_id: r.text for r in stages[3].collect()}
    assert sorted((d, words(t)) for d, t in cut.items()) == sorted(want[2])
    # Decontamination: nothing hits any more, texts without hits are as they were.
    windows = plain_windows(items)
    clean = {r.doc_id: r.text for r in stages[4].collect()}
    for doc, text in cut.items():
        all_words, hit = plain_hits(text, windows)
        if not hit:
            assert clean[doc] == text
        elif doc in clean:
            left = [w for i, w in enumerate(all_words) if i not in hit]
            assert not plain_hits(clean[doc], windows)[1] and len(words_in(clean[doc])) <= len(left)
        else:
            assert len(hit) > 0.5 * len(all_words) - 20
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = stages[5].collect()
    assert {r.doc_id: r.text for r in last} == clean
    for r in last:
        assert list(r.piece_ids) == library.encode(r.text) and r.round_trip


def test_every_stage_takes_something_out_and_keeps_the_columns(stages):
    sizes = [s.count() for s in stages]
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] >= sizes[4] == sizes[5] > 0
    assert all(s.columns == stages[0].columns for s in stages[:5])
    assert stages[3].selectExpr("sum(length(text))").first()[0] < stages[2].selectExpr("sum(length(text))").first()[0]
    assert all(r.n_chars == len(r.text) for r in stages[4].collect())


def test_empty_tables_pass_every_stage(spark, stages):
    empty = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DIR).count() == 0


def test_stages_let_rows_without_text_or_id_through(spark):
    rows = [(1, None, "en", "s", 0), (None, "a few words", "en", "s", 0), (None, "a few words", "en", "s", 0), (2, "", None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[1:]:
        got = stage(spark, docs, DIR)
        assert sorted(map(str, (r.doc_id for r in got.collect()))) == ["1", "2", "None", "None"]


def test_scratch_tables_go_with_their_stage(spark, tmp_path):
    """Tables that the given rows are read from stay, all others of earlier stages go; of a run only the
    result is left."""
    from pathlib import Path

    base = spark.conf.get("spark.checkpoint.dir")
    corpus_pipeline._clear(spark, spark.range(1))
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, DIR)
    lazy = corpus_pipeline.STAGES[3][1](spark, first, DIR)
    n = lazy.count()
    first.write.parquet(str(tmp_path / "first"))
    again = spark.read.parquet(str(tmp_path / "first"))
    assert corpus_pipeline.STAGES[3][1](spark, again, DIR).count() == n
    assert not [f for f in corpus_pipeline._left if "/quality-" in f]
    out = corpus_pipeline.run(spark, DIR)
    assert out.count() and corpus_pipeline._left == []
    assert len(list(Path(base).glob("sentencepiece-*"))) == 1 and not list(Path(base).glob("near_dedup-*"))


def test_the_quality_stage_keeps_columns_named_like_its_counts(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").selectExpr("*", "-1L AS n_words", "'mine' AS kept", "doc_id AS row", "0 AS `a.b`")
    got = corpus_pipeline.quality(spark, docs, DIR)
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r.n_words == -1 and r.kept == "mine" and r.row == r.doc_id for r in rows)
    plain = corpus_pipeline.quality(spark, spark.read.parquet(f"{DIR}/documents.parquet"), DIR)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in plain.collect())
