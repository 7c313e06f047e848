"""The newest days of every series, kept between the batches of a continuous check.

State is one row a series with its days, each with the billing month it was delivered in. A batch that finds
months changed takes their days out, reads these months' series for the days of the window, and puts those in;
no other month is read. Days that the check has moved past are dropped, so a row stays as long as the window.

A log names the folder with the rows in force and what they were made of. The state is a cache of the series
table: of two batches at once, one stores its rows and the other only uses its own.
"""

from __future__ import annotations

import json
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.operators.currency import single_currency
from billweave.sources import storage
from billweave.streaming.ingest import SeriesTable

KEYS = ["scope_kind", "scope_key"]
DAY = ["billing_period", "day", "currency", "cost"]
SCHEMA = "scope_kind string, scope_key string, days array<struct<billing_period:string,day:date,currency:string,cost:double>>"


class SeriesWindow:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        names = [e.name.removesuffix(".json") for e in storage.list_folder(self.spark, f"{self.path}/log")]
        return sorted(int(n) for n in names if n.isdigit())

    def entry(self) -> dict | None:
        """``start``: the first day held; ``months``: the fingerprints of what the rows were made of."""
        for version in reversed(self._versions()):
            try:
                return json.loads(storage.read_small(self.spark, f"{self.path}/log/{version}.json"))
            except ValueError:  # a writer died on it; the one before is as good, only older
                continue
        return None

    def advance(self, table: SeriesTable, start: date) -> DataFrame:
        """The state from ``start`` on, as the table is now. A window that has to begin earlier than what is
        kept, after a long gap or with rules that remember more, is read anew."""
        now = {m: e["fingerprint"] for m, e in table.ledger().items()}
        entry = self.entry()
        if entry is not None and date.fromisoformat(entry["start"]) > start:
            entry = None
        known = entry["months"] if entry else {}
        changed = sorted(m for m in known.keys() | now.keys() if known.get(m) != now.get(m))
        if entry and not changed and entry["start"] == start.isoformat():
            return self._rows(entry["folder"])
        fresh = table.rows([m for m in changed if m in now]).where(F.col("day") >= F.lit(start))
        rows = fresh.select(*KEYS, F.array(F.struct(*DAY)).alias("days"))
        if entry:
            stays = lambda d: (d["day"] >= F.lit(start)) & ~d["billing_period"].isin(changed)
            rows = rows.unionAll(self._rows(entry["folder"]).withColumn("days", F.filter("days", stays)))
        # One row a series: a few hundred days at most, whatever the number of lines behind them.
        merged = rows.groupBy(*KEYS).agg(F.flatten(F.collect_list("days")).alias("days")).where(F.size("days") > 0)
        version = max(self._versions(), default=0) + 1
        folder = f"{self.path}/rows/{version}-{uuid.uuid4().hex}"
        merged.write.parquet(folder)
        text = json.dumps({"start": start.isoformat(), "months": now, "folder": folder})
        storage.create_marker(self.spark, f"{self.path}/log/{version}.json", text)
        return self._rows(folder)

    def _rows(self, folder: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(folder)

    def series(self, table: SeriesTable, start: date, end: date) -> DataFrame:
        """As ``table.read(start, end)``: scope_kind, scope_key, day, cost."""
        days = self.advance(table, start).select(*KEYS, F.inline("days")).where(F.col("day") < F.lit(end))
        keys = [*KEYS, "day"]
        summed = days.groupBy(*keys, "currency").agg(F.sum("cost").alias("cost"))
        return single_currency(summed, "error", "cost", count_missing=False).groupBy(*keys).agg(F.sum("cost").alias("cost"))

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` states. Not to be called while a batch runs."""
        versions = self._versions()
        for version in versions[:-keep]:
            storage.delete_folder(self.spark, f"{self.path}/log/{version}.json")
        kept = {str(v) for v in versions[-keep:]}
        for found in storage.list_folder(self.spark, f"{self.path}/rows"):
            if found.name.split("-")[0] not in kept:
                storage.delete_folder(self.spark, found.path)
