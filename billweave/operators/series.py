"""Daily cost per service and per account: the anomaly detector's input."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.model import NONE_LABEL, CostFilter, CostMetric
from billweave.operators.currency import single_currency
from billweave.operators.predicates import daily_usage_only, in_range


def daily_series(
    nc: DataFrame,
    start: date | None = None,
    end: date | None = None,
    metric: CostMetric = CostMetric.AMORTIZED,
    on_mixed: str = "error",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """[by,] scope_kind, scope_key, day, cost for ``[start, end)``; a NULL key reads ``(none)``.

    One scan feeds both series. NULL keys are named before grouping, so they merge with a literal
    ``(none)`` in the same aggregate. With ``split`` there is a row per currency.
    ``by`` names further key columns, such as a source id, each with a currency of its own; without a
    range the whole table is summed.
    """
    lines = nc.where(daily_usage_only())
    if start is not None:
        lines = lines.where(in_range(CostFilter.between(start, end)))
    # Two entries per line rather than SQL grouping sets: Spark reuses the exchange of this shape for
    # the currency check, which it does not do across an Expand.
    entries = F.array(
        *[
            F.struct(F.lit(kind).alias("scope_kind"), F.coalesce(column, F.lit(NONE_LABEL)).alias("scope_key"))
            for kind, column in (("service", "service_name"), ("account", "account_id"))
        ]
    )
    base = lines.select(
        *by,
        F.inline(entries),
        F.col("usage_start").cast("date").alias("day"),
        "currency",
        F.col(metric.column).alias("cost"),
    )
    keys = [*by, "scope_kind", "scope_key", "day"]
    grouped = base.groupBy(*keys, "currency").agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))
    # Rows without a currency do not count as a second one here.
    checked = single_currency(grouped, on_mixed, "cost", count_missing=False, within=by)
    if on_mixed == "split":
        return checked
    return checked.groupBy(*keys).agg(F.sum("cost").alias("cost"))
