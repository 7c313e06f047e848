"""Incremental ingest: keep daily series up to date as billing files arrive or are rewritten.

The series table is partitioned by billing month. Exports rewrite a month's files in place, and
Spark's file stream ignores a rewritten file, so new files only trigger the work: what is recomputed
follows from the listing fingerprints of the months. A changed month is recomputed whole and its
partition replaced, which is why late and revised data cannot be counted twice.
"""

from __future__ import annotations

import json
from datetime import date, datetime
from functools import partial
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from billweave.model import BadRequest, CostMetric
from billweave.operators.rules import Rules
from billweave.operators.currency import single_currency
from billweave.operators.series import daily_series
from billweave.plans.monitor import Source, run_check
from billweave.sinks.state import StateStore
from billweave.sources import storage
from billweave.sources.exports import fingerprints_of, listing_fingerprints, read_months, resolve

if TYPE_CHECKING:
    from billweave.streaming.window import SeriesWindow

SERIES_SCHEMA = (
    "scope_kind string, scope_key string, day date, currency string, cost double, billing_period string"
)
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
# Any spelling of the month folders.
PERIOD_GLOB = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "billing_period=") + "*"


class SeriesTable:
    """Daily series per billing month, and a ledger of what each month was computed from."""

    def __init__(self, spark: SparkSession, path: str, metric: CostMetric = CostMetric.AMORTIZED):
        self.spark, self.path, self.metric = spark, path.rstrip("/"), metric

    def _ledgers(self) -> list[int]:
        names = [e.name for e in storage.list_folder(self.spark, f"{self.path}/ledger")]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def ledger(self) -> dict[str, dict]:
        """month -> fingerprint and the folder version that holds its rows."""
        versions = self._ledgers()
        if not versions:
            return {}
        return json.loads(storage.read_small(self.spark, f"{self.path}/ledger/{versions[-1]}.json"))

    def changed_months(self, base: str) -> list[str]:
        return self._changed(listing_fingerprints(self.spark, base))

    def _changed(self, now: dict[str, str]) -> list[str]:
        known = {m: e["fingerprint"] for m, e in self.ledger().items()}
        return sorted(m for m in known.keys() | now.keys() if known.get(m) != now.get(m))

    def refresh(self, base: str) -> list[str]:
        """Recompute the months whose files changed; returns them.

        New rows go to a new folder and count once the ledger names it, so a job that dies half-way
        leaves the old rows in force.
        """
        resolved = resolve(self.spark, base)
        before = fingerprints_of(resolved)
        months = self._changed(before)
        if not months:
            return []
        version = max(self._ledgers(), default=0) + 1
        folder = f"{self.path}/data/v={version}-{datetime.now():%Y%m%d%H%M%S%f}"
        periods = [p for p in resolved if p.readable and p.month in months]
        if periods:
            lines = read_months(self.spark, periods)
            series = daily_series(lines, metric=self.metric, on_mixed="split", by=("billing_period",))
            series.write.partitionBy("billing_period").parquet(folder)
        ledger = {m: e for m, e in self.ledger().items() if m in before}
        ledger |= {m: {"fingerprint": before[m], "folder": folder} for m in months if m in before}
        if not storage.create_marker(self.spark, f"{self.path}/ledger/{version}.json", json.dumps(ledger)):
            raise RuntimeError(f"another job refreshed {self.path} at the same time")
        return months

    def vacuum(self) -> None:
        """Delete the folders that no month reads any more."""
        used = {entry["folder"] for entry in self.ledger().values()}
        for entry in storage.list_folder(self.spark, f"{self.path}/data"):
            if entry.path not in used:
                storage.delete_folder(self.spark, entry.path)

    def rows(self, months: list[str] | None = None) -> DataFrame:
        """The stored rows (``SERIES_SCHEMA``) of the billing months given, all by default."""
        by_folder = {}
        for month, entry in self.ledger().items():
            if months is None or month in months:
                by_folder.setdefault(entry["folder"], []).append(month)
        rows = self.spark.createDataFrame([], SERIES_SCHEMA)
        for folder, held in by_folder.items():
            if storage.exists(self.spark, folder):
                part = self.spark.read.schema(SERIES_SCHEMA).parquet(folder)
                rows = rows.unionByName(part.where(F.col("billing_period").isin(held)))
        return rows

    def read(self, start: date | None = None, end: date | None = None) -> DataFrame:
        """scope_kind, scope_key, day, cost over all months. A day may have lines in two months'
        files, so the months are added up."""
        rows = self.rows()
        if start is not None:
            rows = rows.where((F.col("day") >= F.lit(start)) & (F.col("day") < F.lit(end)))
        keys = ["scope_kind", "scope_key", "day"]
        summed = rows.groupBy(*keys, "currency").agg(F.sum("cost").alias("cost"))
        return single_currency(summed, "error", "cost", count_missing=False).groupBy(*keys).agg(F.sum("cost").alias("cost"))

    def fingerprint(self) -> str:
        return json.dumps(sorted((m, e["fingerprint"]) for m, e in self.ledger().items()))


def arriving_files(spark: SparkSession, base: str) -> DataFrame:
    """A stream of the billing files under ``base``: path, modificationTime, length; contents unread."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "*.parquet")
    return files.load(f"{base.rstrip('/')}/{PERIOD_GLOB}").select("path", "modificationTime", "length")


def ingest_available(table: SeriesTable, base: str, checkpoint: str) -> StreamingQuery:
    """Take in everything that has arrived, then stop; meant to be started by a scheduler.

    A run also refreshes months whose files were only rewritten, which the stream does not report.
    """
    table.refresh(base)
    return (
        arriving_files(table.spark, base)
        .writeStream.foreachBatch(lambda _batch, _id: table.refresh(base))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def check_available(
    table: SeriesTable,
    base: str,
    store: StateStore,
    source_id: str,
    rules: Rules,
    now: datetime,
    checkpoint: str,
    window: SeriesWindow | None = None,
) -> StreamingQuery:
    """Ingest and check, first what was only rewritten, which the stream does not report, then per batch
    of new files. Lateness is handled by evaluating the last settled days again, not by dropping late
    lines. A check of unchanged data ends at once. With ``window``, the newest days of all series are kept
    between batches, and a check reads the series of changed months only."""

    def refresh_and_check(*_batch):
        table.refresh(base)
        check_table(table, store, source_id, rules, now, window)

    refresh_and_check()
    return (
        arriving_files(table.spark, base)
        .writeStream.foreachBatch(refresh_and_check)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def check_table(
    table: SeriesTable, store: StateStore, source_id: str, rules: Rules, now: datetime, window: SeriesWindow | None = None
):
    if rules.metric is not table.metric:
        raise BadRequest(f"the table holds {table.metric.value} costs, the rules are for {rules.metric.value} ones")
    series = table.read if window is None else partial(window.series, table)
    source = Source(source_id, lambda *_: None, table.fingerprint(), series=series)
    return run_check(store, source, rules, now)
