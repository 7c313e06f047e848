"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # Billing timestamps are UTC without a zone; date_trunc and casts must not shift them.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

#: The shuffle files of a job go when it is done. They would stay until the driver happens to collect its garbage,
#: those of many jobs at a time. For blocks that run no frame twice.
RELEASE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def build_session(app: str = "billweave", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Set the one setting results depend on, on a session someone else built."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings that hold for a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for intermediate tables, below the folder the cluster names in
    ``spark.checkpoint.dir``. A session without that setting uses its warehouse, which driver and
    executors share as well."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table at ``path`` in the shared scratch folder, computed once.

    Cuts the lineage of a small result that is read several times. ``checkpoint()`` would compute it
    twice, once to count it and once to write it.
    """
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
