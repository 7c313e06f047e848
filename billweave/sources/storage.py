"""Folder listings through Spark's own Hadoop file system, so local, s3a and hdfs paths all work."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    path: str
    is_dir: bool
    size: int
    modified_ms: int


def _fs(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def list_folder(spark: SparkSession, path: str) -> list[Entry]:
    """Direct children sorted by path; a missing folder has none."""
    fs, hadoop_path = _fs(spark, path)
    if not fs.exists(hadoop_path):
        return []
    base = path.rstrip("/")
    entries = [
        Entry(s.getPath().getName(), f"{base}/{s.getPath().getName()}", s.isDirectory(), s.getLen(), s.getModificationTime())
        for s in fs.listStatus(hadoop_path)
    ]
    return sorted(entries, key=lambda e: e.path)


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _fs(spark, path)
    return fs.exists(hadoop_path)


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _fs(spark, path)
    fs.delete(hadoop_path, True)


def create_marker(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small new file; False when it exists already, so only one writer can win."""
    fs, hadoop_path = _fs(spark, path)
    try:
        out = fs.create(hadoop_path, False)
    except Exception as error:  # the JVM reports a taken path as FileAlreadyExistsException
        if "AlreadyExists" in str(error) or "already exists" in str(error):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def read_small(spark: SparkSession, path: str) -> str:
    row = spark.read.format("text").option("wholetext", True).load(path).first()
    return row.value if row else ""
