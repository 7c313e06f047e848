"""A kept index of a source's files: each footer is read once, and scans skip files by it.

The index is a table beside the source, one row per file as it was at some time (path, size, change time):
its schema and its row groups with their usage-start ranges. A refresh lists the files, joins the listing with
what is kept, and reads the footers of new and rewritten files only. These rows are added as a part; a log
names the parts in force, and when there are many they are merged into one. Files that are gone stay in the
table until then and are left out by the join.

The index is a cache: of two jobs that refresh it at once, one stores its rows and the other only uses its own.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.operators.footers import ESTIMATE_COLUMNS, Ranges, hit, row_groups
from billweave.sources import storage
from billweave.sources.exports import layouts_of, read_layouts, resolve
from billweave.sources.footers import FileOpener, files_frame, store_options
from billweave.sources.normalise import UnsupportedExport, detect_format

log = logging.getLogger(__name__)

ROW_GROUPS = "array<struct<row_group:int,min_ts:timestamp_ntz,max_ts:timestamp_ntz,bytes:bigint,chunks:int>>"
FILE = ["file", "size", "modified_ms"]
SCHEMA = f"file string, size bigint, modified_ms bigint, schema string, row_groups {ROW_GROUPS}, version int"
#: More parts than this are merged into one.
MOST_PARTS = 16


def footers_of(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``(file, schema, row_groups)`` of ``files(file)``, each footer opened once. A file of unknown layout has
    one row group without a range, which no scan skips: reading it is an error, leaving it out would hide it."""
    options = store_options(spark)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opener = FileOpener(options)
        for batch in batches:
            schemas, groups = [], []
            for uri in batch["file"]:
                metadata = opener.metadata(uri)
                fields = [(f.name, str(f.type)) for f in metadata.schema.to_arrow_schema()]
                schemas.append(json.dumps(fields))
                try:
                    wanted = ESTIMATE_COLUMNS[detect_format(tuple(name for name, _ in fields))]
                    found = row_groups(metadata, wanted)
                except UnsupportedExport:
                    found = [(0, None, None, 0, 0)]
                names = ("row_group", "min_ts", "max_ts", "bytes", "chunks")
                groups.append([dict(zip(names, g, strict=True)) for g in found])
            yield pd.DataFrame({"file": batch["file"], "schema": schemas, "row_groups": groups})

    return files_frame(spark, files).mapInPandas(read, f"file string, schema string, row_groups {ROW_GROUPS}")


class FileIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        names = [e.name.removesuffix(".json") for e in storage.list_folder(self.spark, f"{self.path}/log")]
        return sorted(int(n) for n in names if n.isdigit())

    def _parts(self) -> list[str]:
        for version in reversed(self._versions()):
            try:
                return json.loads(storage.read_small(self.spark, f"{self.path}/log/{version}.json"))
            except ValueError:  # a writer died on it; the one before is as good
                continue
        return []

    def kept(self) -> DataFrame:
        """All rows in force, also those of files that have changed since."""
        parts = [f"{self.path}/parts/{p}" for p in self._parts()]
        rows = self.spark.read.schema(SCHEMA)
        return rows.parquet(*parts).dropDuplicates(FILE) if parts else self.spark.createDataFrame([], SCHEMA)

    def refresh(self, base: str, start: date | None = None, end_exclusive: date | None = None) -> DataFrame:
        """The index rows of the source's files as they are now, for the months that ``[start, end)`` touches
        (all by default)."""
        resolved = [p for p in resolve(self.spark, base, start, end_exclusive) if p.readable]
        entries = {e.path: e for p in resolved for e in p.listed}
        now = [(f, entries[f].size, entries[f].modified_ms) for f in dict.fromkeys(f for p in resolved for f in p.files)]
        files = self.spark.createDataFrame(now, "file string, size bigint, modified_ms bigint")
        unseen = files.join(self.kept(), FILE, "left_anti")
        if not unseen.isEmpty():
            self._add(unseen)
        return files.join(self.kept(), FILE).select(*[c.split(" ")[0] for c in SCHEMA.replace(ROW_GROUPS, "x").split(", ")])

    def _add(self, files: DataFrame) -> None:
        for _ in range(MOST_PARTS):
            versions, parts = self._versions(), self._parts()
            version, part = max(versions, default=0) + 1, uuid.uuid4().hex
            # The listing is small and repeated here; footers are read once, while the part is written.
            rows = footers_of(self.spark, files).join(files, "file").withColumn("version", F.lit(version))
            rows = rows.select(*[c.split(" ")[0] for c in SCHEMA.replace(ROW_GROUPS, "x").split(", ")])
            if len(parts) >= MOST_PARTS:
                rows, parts = rows.unionAll(self.kept()), []
            rows.write.parquet(f"{self.path}/parts/{part}")
            if storage.create_marker(self.spark, f"{self.path}/log/{version}.json", json.dumps([*parts, part])):
                return
            log.info("%s: another job refreshed the index first", self.path)
            files = files.join(self.kept(), FILE, "left_anti")
            if files.isEmpty():
                return


def in_range(index: DataFrame, ranges: Ranges) -> DataFrame:
    """``(file, schema)`` of the files with a row group that meets one of the ranges or has no range."""
    groups = index.select("file", "schema", F.inline("row_groups"))
    return groups.where(hit(ranges)).select("file", "schema").distinct()


def row_group_index(index: DataFrame) -> DataFrame:
    """The index as estimates take it, one row per row group."""
    return index.select("file", F.inline("row_groups"))


def load_indexed(spark: SparkSession, index: DataFrame, ranges: Ranges) -> DataFrame:
    """The canonical frame over the files that can hold lines of the ranges; other files are not opened. Lines
    outside the ranges that these files hold are in it."""
    return read_layouts(spark, layouts_of(in_range(index, ranges)))
