"""Billing exports on storage: find the months, resolve their files, read and normalise them.

Layout: ``<base>/BILLING_PERIOD=yyyy-MM/`` with Parquet files and an optional ``Manifest.json``.
File names and the different schemas reach the driver; folders are listed and footers read on the executors,
the data by Spark.
"""

from __future__ import annotations

import hashlib
import json
import logging
import re
from collections import defaultdict
from dataclasses import dataclass, replace
from datetime import date
from functools import reduce
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billweave.functions.periods import month_range
from billweave.model import CANONICAL_SCHEMA
from billweave.sources import storage
from billweave.sources.footers import footer_schemas, listing
from billweave.sources.normalise import detect_format, normalise

log = logging.getLogger(__name__)

PERIOD_FOLDER = re.compile(r"(?i)^billing_period=([+-]?\d+)-(\d+)$")
MANIFEST_NAME = "Manifest.json"
MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("dataFiles", T.ArrayType(T.StringType())),
        T.StructField(
            "files",
            T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("dataFile", T.StringType())])),
        ),
        T.StructField("_corrupt", T.StringType()),
    ]
)


@dataclass(frozen=True)
class BillingPeriod:
    month: str  # yyyy-MM
    folder: str


@dataclass(frozen=True)
class PeriodFiles:
    """A month folder's data files. ``listed`` has what a fingerprint covers: the files of the folder itself,
    the manifest with them, and data files elsewhere. ``whole``: the folder holds these files and nothing
    else. A month with a broken manifest, or without any file, is not ``readable``."""

    month: str
    folder: str
    files: tuple[str, ...]
    listed: tuple[storage.Entry, ...] = ()
    whole: bool = False
    readable: bool = True


def billing_periods(spark: SparkSession, base: str) -> list[BillingPeriod]:
    """Month folders directly under ``base``, sorted by month and then path."""
    found = []
    for entry in storage.list_folder(spark, base):
        match = PERIOD_FOLDER.match(entry.name) if entry.is_dir else None
        if match and 1 <= int(match[2]) <= 12:
            found.append(BillingPeriod(f"{int(match[1]):04d}-{int(match[2]):02d}", entry.path))
    return sorted(found, key=lambda p: (p.month, p.folder))


def resolve_path(path: Column, folder: Column) -> Column:
    """Absolute paths and URIs stay as they are; anything else is relative to the period folder."""
    absolute = path.contains("://") | path.startswith("/") | path.rlike(r"^.:[\\/]")
    return F.when(absolute, path).otherwise(F.concat(F.regexp_replace(folder, r"[\\/]+$", ""), F.lit("/"), path))


def manifest_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """folder, files, broken: what each period's manifest lists, read in one Spark job."""
    folder = F.regexp_replace(F.input_file_name(), rf"/{MANIFEST_NAME}$", "")
    listed = (
        spark.read.schema(MANIFEST_SCHEMA)
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json([f"{f}/{MANIFEST_NAME}" for f in folders])
    )
    none = F.array().cast("array<string>")
    entries = F.coalesce("files", F.array().cast(MANIFEST_SCHEMA["files"].dataType))
    keys = F.transform(entries, lambda f: F.coalesce(f["key"], f["dataFile"]))
    paths = F.concat(F.coalesce("dataFiles", none), F.filter(keys, lambda k: k.isNotNull()))
    return listed.select(
        folder.alias("folder"),
        F.transform(paths, lambda p: resolve_path(p, folder)).alias("files"),
        F.col("_corrupt").isNotNull().alias("broken"),
    )


def _listed(spark: SparkSession, folders: list[str]) -> dict[str, list[storage.Entry]]:
    """The files in each folder and below, listed on the executors."""
    found = defaultdict(list)
    if folders:
        for r in listing(spark, folders).collect():
            found[r.folder].append(storage.Entry(r.path.rsplit("/", 1)[-1], r.path, False, r.size, r.modified_ms))
    return {f: sorted(entries, key=lambda e: e.path) for f, entries in found.items()}


def resolve(
    spark: SparkSession, base: str, start: date | None = None, end_exclusive: date | None = None
) -> list[PeriodFiles]:
    """Every month folder that ``[start, end)`` touches (all by default) with its data files.

    The driver lists ``base``, one entry a month; the month folders and those of files that a manifest names
    elsewhere are listed on the executors, and manifests are read by one job.
    """
    periods = billing_periods(spark, base)
    if start is not None and end_exclusive is not None:
        wanted = set(month_range(start, end_exclusive))
        periods = [p for p in periods if p.month in wanted]
    by_month = defaultdict(list)
    for p in periods:
        by_month[p.month].append(p.folder)
    for month, folders in by_month.items():
        if len(folders) > 1:
            log.warning("month %s has several folders, reading all of them: %s", month, folders)
    listed = _listed(spark, [p.folder for p in periods])
    with_manifest = [f for f, entries in listed.items() if any(e.path == f"{f}/{MANIFEST_NAME}" for e in entries)]
    manifests = {}
    if with_manifest:
        for row in manifest_files(spark, with_manifest).collect():
            manifests[_plain(row.folder)] = row
    named = {}
    for p in periods:
        row = manifests.get(_plain(p.folder))
        if row is not None and not row.broken:
            # Spark names the folder as a URI; keep the spelling of the listing.
            local = row.folder + "/"
            named[p.folder] = [f"{p.folder}/{f.removeprefix(local)}" if f.startswith(local) else f for f in row.files]
    outside = {f.rsplit("/", 1)[0] for p in periods for f in named.get(p.folder, ()) if not f.startswith(p.folder + "/")}
    known = {e.path: e for entries in [*listed.values(), *_listed(spark, sorted(outside)).values()] for e in entries}
    out = []
    for p in periods:
        entries = listed.get(p.folder, [])
        direct = [e for e in entries if "/" not in e.path[len(p.folder) + 1 :]]
        row = manifests.get(_plain(p.folder))
        if row is None:
            files = [e.path for e in direct if e.name.endswith(".parquet")]
            if not files:
                log.warning("month %s skipped: no manifest and no Parquet files in %s", p.month, p.folder)
            out.append(PeriodFiles(p.month, p.folder, tuple(files), tuple(direct), len(files) == len(entries), bool(files)))
        elif row.broken:
            log.warning("month %s skipped: its manifest cannot be parsed", p.month)
            out.append(PeriodFiles(p.month, p.folder, (), tuple(direct), readable=False))
        else:
            files = named[p.folder]
            # A file that is not there has size -1.
            others = [known.get(f, storage.Entry(f, f, False, -1, 0)) for f in sorted(set(files) - {e.path for e in direct})]
            out.append(PeriodFiles(p.month, p.folder, tuple(files), (*direct, *others)))
    return out


def discover(
    spark: SparkSession, base: str, start: date | None = None, end_exclusive: date | None = None
) -> list[PeriodFiles]:
    """The data files per month, for the months that ``[start, end)`` touches (all by default)."""
    return [p for p in resolve(spark, base, start, end_exclusive) if p.readable]


def _plain(uri: str) -> str:
    """A path without scheme and percent escapes, to match listings with input_file_name."""
    parsed = urlparse(uri)
    return f"{parsed.netloc}{unquote(parsed.path)}" if parsed.scheme else uri


@dataclass(frozen=True)
class Layout:
    """Files with one schema. A source may change its columns, their types or its format at any file."""

    columns: tuple[str, ...]
    files: tuple[str, ...]


def layouts(spark: SparkSession, periods: list[PeriodFiles]) -> list[Layout]:
    """All files by their full schema, from their footers; one of unknown layout is an error."""
    files = list(dict.fromkeys(f for p in periods for f in p.files))
    if not files:
        return []
    return layouts_of(footer_schemas(spark, files))


def layouts_of(schemas: DataFrame) -> list[Layout]:
    """``(file, schema)`` rows by schema; a schema reaches the driver once, not once a file."""
    out = []
    for row in schemas.groupBy("schema").agg(F.array_sort(F.collect_list("file")).alias("files")).orderBy("schema").collect():
        columns = tuple(name for name, _ in json.loads(row.schema))
        detect_format(columns)
        out.append(Layout(columns, tuple(row.files)))
    return out


def read_layouts(spark: SparkSession, found: list[Layout], folders: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The canonical frame over layouts. ``folders``: files of folders that hold nothing else; one whose files
    are all of one layout is read as a folder, so that Spark lists it instead of being handed its files."""
    frames = []
    for x in found:
        members, paths = set(x.files), []
        for folder, files in (folders or {}).items():
            if members.issuperset(files):
                paths.append(folder)
                members.difference_update(files)
        frames.append(normalise(spark.read.parquet(*paths, *sorted(members)), detect_format(x.columns)))
    if not frames:
        return spark.createDataFrame([], CANONICAL_SCHEMA)
    return reduce(DataFrame.unionByName, frames)


def read_periods(spark: SparkSession, periods: list[PeriodFiles]) -> DataFrame:
    """The canonical frame over all periods. Files with the same schema share one scan."""
    return read_layouts(spark, layouts(spark, periods), {p.folder: p.files for p in periods if p.whole})


def read_months(spark: SparkSession, periods: list[PeriodFiles]) -> DataFrame:
    """The canonical frame with a ``billing_period`` column: the month a line was delivered in.

    It is read off the file's folder, so all months still share one scan. Files that a manifest
    keeps elsewhere get their month as a literal.
    """
    inside = [replace(p, files=tuple(f for f in p.files if f.startswith(p.folder + "/"))) for p in periods]
    folder = F.regexp_extract("source_file", r"(?i)^.*/billing_period=([^/]+)/", 1)
    found = F.col("billing_period")
    year, month = F.split_part(found, F.lit("-"), F.lit(1)), F.split_part(found, F.lit("-"), F.lit(2))
    unknown = F.raise_error(F.concat(F.lit("no billing month in the path of "), "source_file")).cast("string")
    period = F.when(found == "", unknown).otherwise(F.concat_ws("-", year, F.lpad(month, 2, "0")))
    # In two steps: the pattern is looked for once a line, not at each mention.
    out = read_periods(spark, inside).withColumn("billing_period", folder).withColumn("billing_period", period)
    for p in periods:
        outside = tuple(f for f in p.files if not f.startswith(p.folder + "/"))
        if outside:
            nc = read_periods(spark, [replace(p, files=outside, whole=False)])
            out = out.unionByName(nc.withColumn("billing_period", F.lit(p.month)))
    return out


def load_source(
    spark: SparkSession, base: str, start: date | None = None, end_exclusive: date | None = None
) -> DataFrame:
    """One source as a lazy canonical frame. An empty location is valid and has no rows."""
    return read_periods(spark, discover(spark, base, start, end_exclusive))


def listing_fingerprints(spark: SparkSession, base: str) -> dict[str, str]:
    """Per month, a fingerprint of its files' names, sizes and change times; no data is read.

    It covers the listing of the month's folder, the manifest with it, and the files that the manifest
    names elsewhere or in subfolders. A file that is rewritten in place changes its month's fingerprint.
    """
    return fingerprints_of(resolve(spark, base))


def fingerprints_of(resolved: list[PeriodFiles]) -> dict[str, str]:
    prints = {}
    for p in resolved:
        digest = hashlib.sha256(prints.get(p.month, "").encode())
        for e in p.listed:
            digest.update(f"{e.path}|{e.size}|{e.modified_ms}\n".encode())
        prints[p.month] = digest.hexdigest()
    return prints
