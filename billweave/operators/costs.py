"""Cost queries on the canonical table: summary, series, breakdown, compare, lookups, search.

Each is one scan, filtered and column-pruned at the reader, and one shuffle of map-side partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.functions.scalars import ntz, percent_change, period_start
from billweave.model import (
    BadRequest,
    CostFilter,
    Dimension,
    check_limit,
)
from billweave.operators.currency import at_most_one, currency_names, single_currency
from billweave.operators.predicates import contains_text, in_range, matches

MEASURES = ("total", "row_count")


def first_rows(ordered: DataFrame, limit: int | None) -> DataFrame:
    """All rows, or as many as the caller asks for."""
    return ordered if limit is None else ordered.limit(check_limit(limit))


def totals_by(nc: DataFrame, f: CostFilter, on_mixed: str = "error", **keys: Column) -> DataFrame:
    """``keys`` + currency + total + row_count for the rows that match, currency-checked."""
    grouped = (
        nc.where(matches(f))
        .groupBy(*[k.alias(name) for name, k in keys.items()], "currency")
        .agg(F.sum(f.metric.column).alias("total"), F.count("*").alias("row_count"))
    )
    return single_currency(grouped, on_mixed, *MEASURES)


def summary(nc: DataFrame, f: CostFilter, on_mixed: str = "error") -> DataFrame:
    """One row: metric, currency, total, row_count, source_format, start, end.

    No matching rows give currency '', total 0 and count 0. ``split`` gives one row per currency.
    """
    # Currency and format are grouping keys rather than min/first of a string: string aggregates
    # would turn the hash aggregate into a sort of every input row.
    parts = (
        nc.where(matches(f))
        .groupBy("currency", "source_format")
        .agg(F.sum(f.metric.column).alias("total"), F.count("*").alias("row_count"))
    )
    measures = [
        F.sum("total").alias("total"),
        F.sum("row_count").alias("row_count"),
        F.min("source_format").alias("source_format"),
    ]
    if on_mixed == "split":
        out = parts.groupBy("currency").agg(*measures)
    else:
        out = (
            parts.agg(*measures, currency_names().alias("currencies"))
            .where(at_most_one(F.col("currencies")))
            .withColumn("currency", F.coalesce(F.get("currencies", F.lit(0)), F.lit("")))
            .withColumn("row_count", F.coalesce("row_count", F.lit(0)))
            .withColumn("total", F.when(F.col("row_count") == 0, F.lit(0.0)).otherwise(F.col("total")))
        )
    source_format = F.col("source_format")
    if f.has_predicates:
        # The format is that of any row in the range, also when no row matches the predicates.
        in_window = nc.where(in_range(f)).select("source_format").limit(1)
        source_format = F.coalesce(source_format, in_window.agg(F.first("source_format")).scalar())
    return out.select(
        F.lit(f.metric.value).alias("metric"),
        "currency",
        "total",
        "row_count",
        source_format.alias("source_format"),
        ntz(f.start).alias("start"),
        ntz(f.end).alias("end"),
    )


def timeseries(
    nc: DataFrame,
    f: CostFilter,
    group_by: Dimension | None = None,
    on_mixed: str = "error",
    limit: int | None = None,
) -> DataFrame:
    """period[, group], currency, total, row_count; ascending, gaps are not filled."""
    keys = {"period": period_start(f.granularity, F.col("usage_start"))}
    if group_by:
        keys["group"] = F.col(group_by.column)
    order = [F.asc("period"), *([F.asc_nulls_last("group")] if group_by else []), F.asc("currency")]
    return first_rows(totals_by(nc, f, on_mixed, **keys).orderBy(*order), limit)


def breakdown(
    nc: DataFrame,
    f: CostFilter,
    dimension: Dimension,
    limit: int | None = None,
    on_mixed: str = "error",
) -> DataFrame:
    """The keys, the most expensive first: key, currency, total, row_count."""
    rows = totals_by(nc, f, on_mixed, key=F.col(dimension.column))
    return first_rows(rows.orderBy(F.desc_nulls_last("total"), F.asc_nulls_last("key"), "currency"), limit)


def compared(
    nc: DataFrame,
    current: CostFilter,
    previous: CostFilter,
    dimension: Dimension | None = None,
    on_mixed: str = "error",
) -> DataFrame:
    """Both periods per key, uncapped and unordered: key, currency, current, previous, changes.

    One scan of the union of both filters with conditional sums: a key that is missing on one side
    comes out as 0 there, which is what a full outer join of two scans would give. Both sides are
    measured in the current filter's metric.
    """
    now, before = matches(current), matches(previous)
    cost = F.col(current.metric.column)
    key = F.col(dimension.column) if dimension else F.lit(None).cast("string")
    grouped = (
        nc.where(now | before)
        .groupBy(key.alias("key"), "currency")
        .agg(
            F.coalesce(F.sum(F.when(now, cost)), F.lit(0.0)).alias("current"),
            F.coalesce(F.sum(F.when(before, cost)), F.lit(0.0)).alias("previous"),
        )
    )
    rows = single_currency(grouped, on_mixed, "current", "previous")
    if dimension is None and on_mixed == "error":
        # A single row also when nothing matches.
        rows = rows.groupBy().agg(
            F.lit(None).cast("string").alias("key"),
            F.coalesce(F.max("currency"), F.lit("")).alias("currency"),
            F.coalesce(F.sum("current"), F.lit(0.0)).alias("current"),
            F.coalesce(F.sum("previous"), F.lit(0.0)).alias("previous"),
        )
    return with_changes(rows)


def with_changes(rows: DataFrame) -> DataFrame:
    return rows.select(
        "*",
        (F.col("current") - F.col("previous")).alias("absolute_change"),
        percent_change(F.col("current"), F.col("previous")).alias("percentage_change"),
    )


def compare(
    nc: DataFrame,
    current: CostFilter,
    previous: CostFilter,
    dimension: Dimension | None = None,
    on_mixed: str = "error",
    limit: int | None = None,
) -> DataFrame:
    """``compared`` ordered by the size of the change, largest first."""
    rows = compared(nc, current, previous, dimension, on_mixed)
    return first_rows(rows.orderBy(F.desc(F.abs("absolute_change")), F.asc_nulls_last("key"), "currency"), limit)


def search_resources(nc: DataFrame, f: CostFilter, needle: str, limit: int | None = None) -> DataFrame:
    """Resource ids that contain ``needle``, most expensive first: resource_id, total."""
    needle = needle.strip()
    if not needle:
        raise BadRequest("a search text is required")
    found = (
        nc.where(matches(f) & contains_text(F.col("resource_id"), needle))
        .groupBy("resource_id")
        .agg(F.sum(f.metric.column).alias("total"))
        .orderBy(F.desc_nulls_last("total"), "resource_id")
    )
    return first_rows(found, limit)


def distinct_values(nc: DataFrame, dimension: Dimension, limit: int | None = None) -> DataFrame:
    """Sorted non-NULL values over the whole table."""
    column = F.col(dimension.column)
    return first_rows(nc.where(column.isNotNull()).select(column.alias("value")).distinct().orderBy("value"), limit)


def distinct_tag_keys(nc: DataFrame, limit: int | None = None) -> DataFrame:
    return first_rows(nc.select(F.explode(F.map_keys("tags")).alias("value")).distinct().orderBy("value"), limit)


def distinct_tag_values(nc: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    if not key:
        raise BadRequest("a tag key is required")
    value = F.col("tags")[key]
    return first_rows(nc.where(value.isNotNull()).select(value.alias("value")).distinct().orderBy("value"), limit)


class FilterValues:
    """Filter-value lookups for pickers, remembered until the data's fingerprint changes.

    A picker shows the first ``most`` values, which bounds what is kept on the driver; ``cut`` names
    the lookups that have more, for which ``distinct_values`` and its like give all rows. A failed
    lookup is not remembered. With a kept ``index`` of values (``sources.value_index``), lookups read that
    instead of the cost table.
    """

    def __init__(self, nc: DataFrame | None, fingerprint: str, most: int = 1000, index=None):
        self.most, self._index = check_limit(most), index
        self.cut: set[tuple[str, str]] = set()
        self._nc = nc
        self._fingerprint = fingerprint
        self._known: dict[tuple[str, str], list[str]] = {}

    def refresh(self, nc: DataFrame | None, fingerprint: str) -> None:
        if fingerprint != self._fingerprint:
            self._nc, self._fingerprint, self._known, self.cut = nc, fingerprint, {}, set()

    def of(self, dimension: Dimension) -> list[str]:
        if self._index is not None:
            return self._lookup(("column", dimension.column), lambda: self._index.values(dimension, self.most + 1))
        return self._lookup(("column", dimension.column), lambda: distinct_values(self._nc, dimension, self.most + 1))

    def tag_keys(self) -> list[str]:
        if self._index is not None:
            return self._lookup(("tag_keys", ""), lambda: self._index.tag_keys(self.most + 1))
        return self._lookup(("tag_keys", ""), lambda: distinct_tag_keys(self._nc, self.most + 1))

    def tag_values(self, key: str) -> list[str]:
        if self._index is not None:
            return self._lookup(("tag_values", key), lambda: self._index.tag_values(key, self.most + 1))
        return self._lookup(("tag_values", key), lambda: distinct_tag_values(self._nc, key, self.most + 1))

    def _lookup(self, name, query) -> list[str]:
        if name not in self._known:
            values = [row.value for row in query().collect()]
            if len(values) > self.most:
                self.cut.add(name)
            self._known[name] = values[: self.most]
        return self._known[name]

