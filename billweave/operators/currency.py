"""One-currency contract: a total never adds up different currencies.

Every aggregate groups by currency as well, so the check reads the aggregate, not the raw rows. The
check is a scalar subquery over the same aggregate; Spark runs the scan and the shuffle once and
reuses the exchange for both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def currency_names(count_missing: bool = True) -> Column:
    """The currencies of an aggregate, sorted; a missing one counts as a currency of its own."""
    name = F.coalesce("currency", F.lit("(no currency)")) if count_missing else F.col("currency")
    return F.array_sort(F.collect_set(name))


def at_most_one(currencies: Column) -> Column:
    """A filter condition that fails the query when more than one currency is present."""
    message = F.concat(F.lit("amounts in several currencies cannot be added up: ["), F.array_join(currencies, ", "), F.lit("]"))
    return F.when(F.size(currencies) > 1, F.raise_error(message).cast("boolean")).otherwise(True)


def single_currency(
    grouped: DataFrame,
    on_mixed: str = "error",
    *measures: str,
    count_missing: bool = True,
    within: tuple[str, ...] = (),
) -> DataFrame:
    """Guard an aggregate that has a ``currency`` key.

    ``on_mixed="split"`` keeps one row per currency instead of failing. ``measures`` are the
    aggregate's value columns: the check sums them too, which keeps its plan identical to the
    aggregate's, so that the exchange is reused. With ``within`` each of its groups, such as a
    source, may have a currency of its own.
    """
    if on_mixed == "split":
        return grouped
    if on_mixed != "error":
        raise ValueError("on_mixed must be 'error' or 'split'")
    totals = totals_of(grouped, *measures, count_missing=count_missing, within=within)
    return grouped.where(at_most_one(totals.getField("currencies")))


def totals_of(
    grouped: DataFrame, *measures: str, count_missing: bool = True, within: tuple[str, ...] = ()
) -> Column:
    """One struct over the whole aggregate: its currencies (with ``within``: those of the group that
    has most) and the sum of each measure."""
    names, sums = currency_names(count_missing).alias("currencies"), [F.sum(m).alias(m) for m in measures]
    if within:
        per_group = grouped.groupBy(*within).agg(names, *sums)
        names = F.max_by("currencies", F.size("currencies")).alias("currencies")
        return per_group.agg(F.struct(names, *sums).alias("totals")).scalar()
    return grouped.agg(F.struct(names, *sums).alias("totals")).scalar()
