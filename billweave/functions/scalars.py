"""Column expressions shared by the operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from billweave.model import NONE_LABEL, Granularity


def ntz(value: datetime) -> Column:
    """A zone-less timestamp literal; stays comparable with the Parquet statistics."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def instant(value: datetime) -> Column:
    """A UTC timestamp literal, whatever the driver's own time zone."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def period_start(granularity: Granularity, ts: Column) -> Column:
    # date_trunc returns a zoned timestamp; the session runs in UTC, so the cast back is exact.
    return F.date_trunc(granularity.value, ts).cast("timestamp_ntz")


def display_label(key: Column) -> Column:
    """NULL and empty keys read as ``(none)``."""
    return F.when(key.isNull() | (key == ""), F.lit(NONE_LABEL)).otherwise(key)


def percent_change(current: Column, previous: Column) -> Column:
    """NULL when there is no previous cost to compare with."""
    return F.when(previous != 0, (current - previous) / previous * 100)


def median(values: Column, size: Column) -> Column:
    """Exact median of an array: the mean of the two middle values for an even count, NULL for
    an empty array. ``size`` is the array's length, passed in so it is not computed twice."""
    take = F.lit(2) - size % 2
    first = ((size + 1) / 2).cast("int")
    middle = F.slice(F.sort_array(values), first, take)
    return F.when(size > 0, F.aggregate(middle, F.lit(0.0), lambda a, x: a + x) / take)


def spreadsheet_safe(text: Column) -> Column:
    """Prefix a quote to text that a spreadsheet would run as a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 2).when(severity == "medium", 1).when(severity == "low", 0)


def severity_name(rank: Column) -> Column:
    return F.when(rank == 2, "high").when(rank == 1, "medium").when(rank == 0, "low")
