"""Folder listings and Parquet footers, read on the executors.

pyarrow lists folders and opens files; it gets the store's settings from Spark's Hadoop configuration, and
each task makes one file system per store.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

FILES_PER_TASK, FOLDERS_PER_TASK = 64, 16
#: Settings of the s3a connector and the arguments that pyarrow has for them.
S3A_SETTINGS = {
    "fs.s3a.access.key": "access_key",
    "fs.s3a.secret.key": "secret_key",
    "fs.s3a.session.token": "session_token",
    "fs.s3a.endpoint": "endpoint_override",
    "fs.s3a.endpoint.region": "region",
}


def store_options(spark: SparkSession) -> dict[str, str]:
    """The settings of object stores that executors need."""
    conf = spark._jsc.hadoopConfiguration()
    return {k: v for k in [*S3A_SETTINGS, "fs.s3a.connection.ssl.enabled"] if (v := conf.get(k)) is not None}


class FileOpener:
    """Opens files by their URI, with one file system per store."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.known = options, {}

    def located(self, uri: str) -> tuple[fs.FileSystem, str]:
        parsed = urlparse(uri)
        scheme = parsed.scheme if len(parsed.scheme) > 1 else ""  # a drive letter is no scheme
        key = (scheme, parsed.netloc)
        if scheme in ("", "file"):
            return fs.LocalFileSystem(), unquote(parsed.path) if scheme else uri
        if scheme in ("s3", "s3a", "s3n"):
            if key not in self.known:
                arguments = {S3A_SETTINGS[k]: v for k, v in self.options.items() if k in S3A_SETTINGS}
                if self.options.get("fs.s3a.connection.ssl.enabled") == "false":
                    arguments["scheme"] = "http"
                self.known[key] = fs.S3FileSystem(**arguments)
            return self.known[key], parsed.netloc + unquote(parsed.path)
        if key not in self.known:
            self.known[key] = fs.FileSystem.from_uri(f"{scheme}://{parsed.netloc}/")[0]
        return self.known[key], unquote(parsed.path)

    def metadata(self, uri: str) -> pq.FileMetaData:
        system, path = self.located(uri)
        with system.open_input_file(path) as source:
            return pq.ParquetFile(source).metadata

    def files(self, folder: str) -> list[tuple[str, int, int]]:
        """Path, size and change time (ms) of the files in a folder and below, spelled as the folder is; none
        if it does not exist."""
        system, path = self.located(folder.rstrip("/"))
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True))
        base = folder.rstrip("/")
        return [(base + f.path[len(path) :], f.size, (f.mtime_ns or 0) // 1_000_000) for f in found if f.type == fs.FileType.File]


def listing(spark: SparkSession, folders: list[str]) -> DataFrame:
    """``(folder, path, size, modified_ms)`` of all files in the folders and below, listed in tasks of a few
    folders each. Hidden files, whose names begin with ``_`` or ``.``, are left out."""
    options = store_options(spark)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opener = FileOpener(options)
        for batch in batches:
            rows = [(f, *entry) for f in batch["folder"] for entry in opener.files(f)]
            rows = [r for r in rows if not any(part[:1] in ("_", ".") for part in r[1][len(r[0].rstrip("/")) + 1 :].split("/"))]
            yield pd.DataFrame(rows, columns=["folder", "path", "size", "modified_ms"])

    tasks = max(1, -(-len(folders) // FOLDERS_PER_TASK))
    frame = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(tasks, "folder")
    return frame.mapInPandas(read, "folder string, path string, size bigint, modified_ms bigint")


def files_frame(spark: SparkSession, files: list[str] | DataFrame) -> DataFrame:
    """One row per file, a few files per task."""
    if isinstance(files, DataFrame):
        return files.select("file")
    tasks = max(1, -(-len(files) // FILES_PER_TASK))
    return spark.createDataFrame([(f,) for f in files], "file string").repartition(tasks, "file")


def footer_schemas(spark: SparkSession, files: list[str] | DataFrame) -> DataFrame:
    """``(file, schema)``: the names and types of a file's columns as JSON, equal for equal schemas."""
    options = store_options(spark)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opener = FileOpener(options)
        for batch in batches:
            schemas = [opener.metadata(uri).schema.to_arrow_schema() for uri in batch["file"]]
            yield pd.DataFrame({"file": batch["file"], "schema": [json.dumps([(f.name, str(f.type)) for f in s]) for s in schemas]})

    return files_frame(spark, files).mapInPandas(read, "file string, schema string")
