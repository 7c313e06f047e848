"""The corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, SentencePiece ids.

Each stage takes what its predecessor kept, as a table, and returns a DataFrame; all but the last return
the columns of ``documents``. ``run`` writes every stage's rows to the shared scratch folder before the
next one reads them, so a lost executor costs at most one stage. A stage's scratch tables go when the next
stage is called with a table that is not read from them, its output when the next one is written.

Rows with null or empty texts fail the quality rules, so the later stages only meet them when they are
called on their own; they let them through. Each stage treats ties, repeated rows and empty tables as its
operator says.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from urllib.parse import unquote, urlparse

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.catalog.registry import Query
from billweave.llm import decontaminate, near_dedup, pieces, quality_rules, substring_dedup
from billweave.llm.common import noting, stored, table
from billweave.session import scratch_dir, written
from billweave.sources.storage import delete_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. The rows are carried whole, so that columns of the table
    that are named like the rules' counts stay what they are."""
    rows = docs.select(F.struct("*").alias("row"), "text", "lang", "source")
    return quality_rules.quality_rules(rows, carry=["row"]).where("kept").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates on five-word shingles, the document with the smallest id stays; of
    several rows with one id, the one whose text sorts first."""
    found = near_dedup.near_duplicates(docs)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    out = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = stored(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if twice.isEmpty():
        return out
    row = F.min(F.struct("text", *[c for c in docs.columns if c != "text"])).alias("row")
    first = out.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(row).select("row.*").select(*docs.columns)
    return out.join(twice, "doc_id", "left_anti").select(*docs.columns).unionAll(first)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; a document that has nothing else goes."""
    out = substring_dedup.substring_dedup(docs).where("n_cut = 0 OR text <> ''")
    return out.withColumn("n_chars", _chars()).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is mostly benchmark goes."""
    out = decontaminate.remove_hits(docs, table(spark, sf_dir, "benchmark"))
    return out.withColumn("n_chars", _chars()).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their pieces."""
    return pieces.encoded_and_checked(docs, public_tokenizers.path("piece_bpe_32k.model"))


def _chars() -> Column:
    return F.length("text").cast("long")


#: Scratch tables of the stages called so far.
_left: list[str] = []


def _clear(spark: SparkSession, docs: DataFrame) -> None:
    """Delete the scratch tables of earlier stages that ``docs`` is not read from. A stage's result is written
    and read again before the next stage gets it; what the result was made from is not needed then."""
    if _left:
        read = {unquote(urlparse(f).path).rsplit("/", 1)[0] for f in docs.inputFiles()}
        kept = [folder for folder in _left if any(r == p or r.startswith(p + "/") for p in [urlparse(folder).path] for r in read)]
        for folder in set(_left) - set(kept):
            delete_folder(spark, folder)
        _left[:] = kept


def _tidy(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _clear(spark, docs)
        with noting(_left):
            return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", _tidy(quality)),
    ("near_dedup", _tidy(one_of_each_group)),
    ("substring_dedup", _tidy(without_repeats)),
    ("decontamination", _tidy(decontaminated)),
    ("sentencepiece", _tidy(encoded)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_dir(spark, name)
        docs = written(stage(spark, docs, sf_dir), path)
        _clear(spark, docs)
        if before is not None:
            delete_folder(spark, before)
        before = path
    return docs


#: Near-dedup, substring dedup and SentencePiece have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None

QUERY = Query(run, ORACLE_SQL)
