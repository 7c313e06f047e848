"""A kept index of a source's values, by billing month: what pickers list and what a search looks through.

Distinct values come from counts that are maintained: each value with the number of lines that hold it. When
a month is rewritten, its old counts are taken away and its new ones added, as one small delta; no other
month is read. A value is there as long as its deltas add up to more than nothing.

Resource ids have trigram postings as well: every three consecutive characters of an id in lower case lead to
the id, and the id to the months that have it. An id is posted once by a refresh, however many months it is in.
A search takes the needle's rarest trigram, verifies the ids posted under it, and so learns which months can
hold a match and between which ids the matches lie, before it reads any cost line.

A log names the month parts and the deltas in force. Rows of a refresh that dies half-way are named by none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.model import BadRequest, CostFilter, Dimension
from billweave.operators.costs import first_rows, search_resources
from billweave.operators.predicates import contains_text
from billweave.session import RELEASE, settings
from billweave.sources import storage
from billweave.sources.exports import fingerprints_of, read_months, resolve

VALUE_KEY = ["kind", "tag_key", "value"]
COUNT_SCHEMA = "kind string, tag_key string, value string, n bigint"
ID_SCHEMA = "value string, months array<string>, n bigint"
GRAM_SCHEMA = "gram string, value string"
GRAM_COUNT_SCHEMA = "gram string, n bigint"
TAG = "tag"
#: Characters of a posting key. A shorter needle is compared with all distinct ids.
GRAM = 3
#: More deltas than this are added up into one.
MOST_DELTAS = 16
#: Of the tables of a part. An index of another one is made anew by the next refresh.
FORMAT = 3
ENTRY_TYPE = "array<struct<kind:string,tag_key:string,value:string>>"


def values_of(nc: DataFrame, *by: str) -> DataFrame:
    """``(*by, kind, tag_key, value, n)``: the lines that hold each value of a dimension or of a tag key. A
    tag key without a value is there with a NULL value."""
    columns = [
        F.struct(F.lit(d.column).alias("kind"), F.lit(None).cast("string").alias("tag_key"), F.col(d.column).alias("value"))
        for d in Dimension
    ]
    tags = F.transform(
        F.map_entries("tags"), lambda e: F.struct(F.lit(TAG).alias("kind"), e["key"].alias("tag_key"), e["value"].alias("value"))
    )
    entries = F.concat(F.array(*columns), F.coalesce(tags, F.array().cast(ENTRY_TYPE)))
    # A plain filter on the rows: one on the array would call a function for every entry.
    held = nc.select(*by, F.inline(entries)).where((F.col("kind") == TAG) | F.col("value").isNotNull())
    return held.groupBy(*by, *VALUE_KEY).agg(F.count("*").alias("n"))


def grams(text: Column) -> Column:
    """The distinct trigrams of lower-cased ``text``; none for a shorter text."""
    places = F.length(text) - (GRAM - 1)
    starts = F.when(places > 0, F.sequence(F.lit(1), places)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM))))


class ValueIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        names = [e.name.removesuffix(".json") for e in storage.list_folder(self.spark, f"{self.path}/log")]
        return sorted(int(n) for n in names if n.isdigit())

    def entry(self) -> dict:
        """``months``: month -> fingerprint and part; ``deltas``: the parts whose counts add up."""
        for version in reversed(self._versions()):
            try:
                entry = json.loads(storage.read_small(self.spark, f"{self.path}/log/{version}.json"))
            except ValueError:  # a writer died on it; the one before is as good, only older
                continue
            if entry.get("format") == FORMAT:
                return entry
            break
        return {"months": {}, "deltas": []}

    def refresh(self, base: str) -> list[str]:
        """Bring the index to the files under ``base``; returns the months that were read."""
        resolved = resolve(self.spark, base)
        now, old = fingerprints_of(resolved), self.entry()
        known = old["months"]
        changed = sorted(m for m in known.keys() | now.keys() if known.get(m, {}).get("fingerprint") != now.get(m))
        if not changed:
            return []
        version = max(self._versions(), default=0) + 1
        part = f"{datetime.now():%Y%m%d%H%M%S}-{uuid.uuid4().hex}"
        folder = f"{self.path}/parts/{part}"
        periods = [p for p in resolved if p.readable and p.month in changed]
        if periods:
            with settings(self.spark, RELEASE):
                self._write_months(read_months(self.spark, periods), folder)
        months = {m: e for m, e in known.items() if m not in changed}
        months |= {m: {"fingerprint": now[m], "part": part} for m in changed if m in now}
        gone = self._month_rows("values", COUNT_SCHEMA, {m: e for m, e in known.items() if m in changed})
        come = self._month_rows("values", COUNT_SCHEMA, {m: months[m] for m in changed if m in months})
        delta = gone.withColumn("n", -F.col("n")).drop("billing_period")
        # The part is of these months alone, so its ids are counted already; there are many of them in each month.
        delta = delta.unionAll(come.where(F.col("kind") != Dimension.RESOURCE.column).drop("billing_period"))
        if periods:
            ids = self.spark.read.schema(ID_SCHEMA).parquet(f"{folder}/ids")
            delta = delta.unionAll(ids.select(F.lit(Dimension.RESOURCE.column), F.lit(None).cast("string"), "value", "n"))
        deltas = old["deltas"]
        if len(deltas) >= MOST_DELTAS:
            delta, deltas = delta.unionAll(self._deltas(deltas)), []
        # What a month holds before and after, most of it, adds up to nothing and is not stored.
        delta = delta.groupBy(*VALUE_KEY).agg(F.sum("n").alias("n")).where(F.col("n") != 0)
        with settings(self.spark, RELEASE):
            delta.write.parquet(f"{folder}/delta")
        text = json.dumps({"format": FORMAT, "months": months, "deltas": [*deltas, part]})
        if not storage.create_marker(self.spark, f"{self.path}/log/{version}.json", text):
            raise RuntimeError(f"another job refreshed {self.path} at the same time")
        return changed

    def _write_months(self, nc: DataFrame, folder: str) -> None:
        """Plain tables sorted by month, not a folder for each month: readers skip row groups by their ranges."""
        month = "billing_period"
        values = values_of(nc, month).hint("rebalance", month).sortWithinPartitions(month, "kind")
        values.write.parquet(f"{folder}/values")
        held = self.spark.read.schema(f"{COUNT_SCHEMA}, {month} string").parquet(f"{folder}/values")
        # An id has a row for each of its months by now, so there is nothing to gather before they are dealt out.
        held = held.where(F.col("kind") == Dimension.RESOURCE.column).select("value", month, "n").repartition("value")
        ids = held.groupBy("value").agg(F.collect_list(month).alias("months"), F.sum("n").alias("n"))
        ids.write.parquet(f"{folder}/ids")
        ids = self.spark.read.schema(ID_SCHEMA).parquet(f"{folder}/ids")
        posted = ids.select(F.explode(grams(F.lower("value"))).alias("gram"), "value")
        # Sorted by trigram; a frequent one spreads over several ranges by its values.
        ranged = posted.repartitionByRange("gram", "value").sortWithinPartitions("gram", "value")
        ranged.write.parquet(f"{folder}/postings")
        back = self.spark.read.schema(GRAM_SCHEMA).parquet(f"{folder}/postings")
        back.groupBy("gram").agg(F.count("*").alias("n")).write.parquet(f"{folder}/grams")

    def _month_rows(self, name: str, schema: str, months: dict[str, dict]) -> DataFrame:
        """``(*schema, billing_period)`` of the months given."""
        by_part: dict[str, list[str]] = {}
        for month, entry in months.items():
            by_part.setdefault(entry["part"], []).append(month)
        out = None
        for part, held in sorted(by_part.items()):
            folder = f"{self.path}/parts/{part}/{name}"
            if storage.exists(self.spark, folder):
                rows = self.spark.read.schema(f"{schema}, billing_period string").parquet(folder)
                rows = rows.where(F.col("billing_period").isin(held))
                out = rows if out is None else out.unionAll(rows)
        return self.spark.createDataFrame([], f"{schema}, billing_period string") if out is None else out

    def _part_rows(self, name: str, schema: str, months: dict[str, dict]) -> DataFrame:
        """``(*schema, part)`` of the parts that have some of the months, ids with these months only."""
        out = None
        for part in sorted({e["part"] for e in months.values()}):
            folder = f"{self.path}/parts/{part}/{name}"
            if storage.exists(self.spark, folder):
                rows = self.spark.read.schema(schema).parquet(folder).withColumn("part", F.lit(part))
                if schema == ID_SCHEMA:
                    held = [m for m, e in months.items() if e["part"] == part]
                    # Some months may be of a later part, so the count of all is of no use.
                    rows = rows.drop("n").withColumn("months", F.array_intersect("months", F.lit(held))).where(F.size("months") > 0)
                out = rows if out is None else out.unionAll(rows)
        none = self.spark.createDataFrame([], f"{schema}, part string")
        return (none.drop("n") if schema == ID_SCHEMA else none) if out is None else out

    def _deltas(self, parts: list[str]) -> DataFrame:
        folders = [f"{self.path}/parts/{p}/delta" for p in parts]
        rows = self.spark.read.schema(COUNT_SCHEMA)
        return rows.parquet(*folders) if folders else self.spark.createDataFrame([], COUNT_SCHEMA)

    def counts(self) -> DataFrame:
        """``(kind, tag_key, value, n)`` of the values that lines hold now."""
        parts = self.entry()["deltas"]
        rows = self._deltas(parts)
        if len(parts) > 1:
            rows = rows.groupBy(*VALUE_KEY).agg(F.sum("n").alias("n"))
        return rows.where(F.col("n") > 0)

    def values(self, dimension: Dimension, limit: int | None = None) -> DataFrame:
        """As ``distinct_values``, without a look at the cost table."""
        rows = self.counts().where(F.col("kind") == dimension.column)
        return first_rows(rows.select("value").orderBy("value"), limit)

    def tag_keys(self, limit: int | None = None) -> DataFrame:
        rows = self.counts().where(F.col("kind") == TAG)
        return first_rows(rows.select(F.col("tag_key").alias("value")).distinct().orderBy("value"), limit)

    def tag_values(self, key: str, limit: int | None = None) -> DataFrame:
        if not key:
            raise BadRequest("a tag key is required")
        rows = self.counts().where((F.col("kind") == TAG) & (F.col("tag_key") == key) & F.col("value").isNotNull())
        return first_rows(rows.select("value").orderBy("value"), limit)

    def ids(self, needle: str) -> DataFrame:
        """``(part, value, months)``: the ids that contain ``needle``, with the months that have them. One that
        several refreshes have met has a row for each."""
        needle = needle.strip()
        if not needle:
            raise BadRequest("a search text is required")
        months = self.entry()["months"]
        ids = self._part_rows("ids", ID_SCHEMA, months)
        # Spark's lower case, as in the postings. As many rows as the needle has trigrams.
        asked = self.spark.range(1).select(F.explode(grams(F.lower(F.lit(needle)))).alias("gram"))
        asked = [r.gram for r in asked.collect()]
        if not asked:
            return ids.where(contains_text(F.col("value"), needle))
        totals = self._part_rows("grams", GRAM_COUNT_SCHEMA, months).where(F.col("gram").isin(asked))
        posted = {r.gram: r.n for r in totals.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        rarest = min(asked, key=lambda g: (posted.get(g, 0), g))
        rows = self._part_rows("postings", GRAM_SCHEMA, months).where(F.col("gram") == rarest)
        return ids.join(rows.where(contains_text(F.col("value"), needle)).drop("gram"), ["part", "value"])

    def resources(self, needle: str) -> DataFrame:
        """``(billing_period, value)``: the ids that contain ``needle``, by the months that have them."""
        return self.ids(needle).select(F.explode("months").alias("billing_period"), "value")


def search_indexed(
    index: ValueIndex,
    load: Callable[[list[str]], DataFrame],
    f: CostFilter,
    needle: str,
    limit: int | None = None,
) -> DataFrame:
    """As ``search_resources``, reading only months that hold a match. ``load`` gives the canonical frame of the
    billing months it is asked for; the index must be up to date with it.

    Of the matches themselves only their months and their smallest and greatest id reach the driver: with
    these the reader skips row groups, and ``contains`` decides on each line as it does without an index."""
    hits = index.ids(needle)
    found = sorted(r.month for r in hits.select(F.explode("months").alias("month")).distinct().collect())
    nc = load(found)
    if found:
        ends = hits.agg(F.min("value").alias("low"), F.max("value").alias("high")).first()
        nc = nc.where(F.col("resource_id").between(ends.low, ends.high))
    return search_resources(nc, f, needle, limit)


def months_loader(spark: SparkSession, base: str) -> Callable[[list[str]], DataFrame]:
    """The cost lines of some billing months of the files under ``base``; other months' footers are not read."""

    def load(months: list[str]) -> DataFrame:
        return read_months(spark, [p for p in resolve(spark, base) if p.readable and p.month in months])

    return load
