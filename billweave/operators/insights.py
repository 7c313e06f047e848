"""Derived reports on the cost queries: "Other" buckets, movers, credits, run rate, entity pages.

Top-n rows come from an ordered limit, never from a window over all keys, so a dimension with
hundreds of millions of keys is ranked in parallel. What is folded after that is at most n rows.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billweave.functions.periods import days_in_month, month_start
from billweave.functions.scalars import display_label, percent_change, period_start
from billweave.model import (
    OTHER_LABEL,
    CostFilter,
    CostMetric,
    Dimension,
    Granularity,
    TagFilter,
    TagOp,
    check_limit,
)
from billweave.operators.costs import MEASURES, compared, summary, totals_by
from billweave.operators.currency import currency_names, single_currency, totals_of
from billweave.operators.predicates import matches

# Charge categories shown as credits.
CREDIT_CATEGORIES = ["Credit", "Refund", "Discount", "Adjustment"]
#: Names of a trend that are broadcast.
MOST_BROADCAST = 10_000


def breakdown_with_other(
    nc: DataFrame, f: CostFilter, dimension: Dimension, n: int = 10, min_share: float = 0.0
) -> DataFrame:
    """Top ``n`` keys plus one "Other" row for the remainder: label, is_other, total.

    "Other" is the overall total minus the rows shown. It stands there whenever keys were folded, so
    the rows add up to the total, unless the caller wants it left out below ``min_share`` of it.
    """
    check_limit(n)
    rows = totals_by(nc, f, key=F.col(dimension.column))
    top = rows.orderBy(F.desc_nulls_last("total"), F.asc_nulls_last("key"), "row_count").limit(n)
    shown = top.agg(
        F.collect_list(F.struct(display_label(F.col("key")).alias("label"), F.lit(False).alias("is_other"), "total"))
        .alias("shown"),
        F.coalesce(F.sum("total"), F.lit(0.0)).alias("shown_total"),
        F.sum("row_count").alias("shown_lines"),
    )
    totals = totals_of(rows, *MEASURES)
    overall = F.coalesce(totals.getField("total"), F.lit(0.0))
    return (
        shown.withColumn("overall", overall)
        .withColumn("rest", F.col("overall") - F.col("shown_total"))
        .withColumn("folded", totals.getField("row_count") > F.col("shown_lines"))
        .select(F.explode(F.concat("shown", _other_entry(min_share))).alias("row"))
        .select("row.*")
    )


def _other_entry(min_share: float) -> Column:
    entry = F.struct(F.lit(OTHER_LABEL).alias("label"), F.lit(True).alias("is_other"), F.col("rest").alias("total"))
    shown = F.col("folded") & (F.abs("rest") >= F.abs("overall") * min_share)
    return F.filter(F.array(entry), lambda _: shown)


def trend_with_other(nc: DataFrame, f: CostFilter, dimension: Dimension, n: int = 10) -> DataFrame:
    """Stacked trend: period, rank, label, is_other, total, row_count.

    Groups are ranked by their total over the whole range; the first ``n`` keep their name, the rest is folded
    per period. Absent (period, group) pairs are 0. "Other" has rank 0 and exists only when some group was
    folded.

    The ranking is a dictionary of ``n`` keys at most, joined by broadcast before a second partial sum by
    period and position; the plan is the same for every ``n``.
    """
    keep = check_limit(n)
    points = totals_by(nc, f, period=period_start(f.granularity, F.col("usage_start")), key=F.col(dimension.column))
    groups = points.groupBy("key").agg(F.sum("total").alias("total"), F.sum("row_count").alias("rows"))
    top = groups.orderBy(F.desc_nulls_last("total"), F.asc_nulls_last("key"), "rows").limit(keep)
    ranking_row = top.agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("order"), F.col("key").isNull(), "key"))),
            lambda g: g["key"],
        ).alias("ranking")
    )
    dictionary = ranking_row.select(F.posexplode("ranking").alias("position", "named"))
    # Beyond the bound Spark decides by the sizes that it sees.
    small = F.broadcast(dictionary) if keep <= MOST_BROADCAST else dictionary
    positions = points.join(small, F.col("key").eqNullSafe(F.col("named")), "left")
    folded = positions.groupBy("period", F.coalesce("position", F.lit(-1)).alias("position")).agg(
        F.sum("total").alias("total"), F.sum("row_count").alias("row_count")
    )
    # At most n + 1 entries each.
    entry = F.struct("position", F.struct("total", "row_count"))
    per_period = folded.groupBy("period").agg(F.map_from_entries(F.collect_list(entry)).alias("sums"))
    counted = groups.agg(F.struct(F.count("*").alias("n"), F.sum("total").alias("total"), F.sum("rows").alias("rows")))
    filled = per_period.withColumn("ranking", ranking_row.scalar()).withColumn("n_groups", counted.scalar().getField("n"))

    def row(rank: Column, label: Column, is_other: bool) -> Column:
        sums = F.try_element_at("sums", rank - 1)
        zero = {c: F.lit(0).cast(points.schema[c].dataType) for c in ("total", "row_count")}
        values = [F.coalesce(sums[c], zero[c]).alias(c) for c in zero]
        return F.struct(rank.alias("rank"), label.alias("label"), F.lit(is_other).alias("is_other"), *values)

    named = F.transform("ranking", lambda key, i: row(i + 1, display_label(key), False))
    other = F.filter(F.array(row(F.lit(0), F.lit(OTHER_LABEL), True)), lambda _: F.size("ranking") < F.col("n_groups"))
    return filled.select("period", F.explode(F.concat(other, named)).alias("s")).select("period", "s.*")


def comparison_table(
    nc: DataFrame,
    current: CostFilter,
    previous: CostFilter,
    dimension: Dimension,
    n: int = 10,
    sort_by: str = "current",
    descending: bool = True,
) -> DataFrame:
    """Top ``n`` keys by current cost and the aggregated rest, with changes and share of total.

    Changes of the "Other" row are recomputed from its sums. The share is of the total over all
    keys. Rows with no percentage change sort last in either direction.
    """
    check_limit(n)
    rows = compared(nc, current, previous, dimension).select("key", "current", "previous")
    # Ordering by every measure keeps this branch's aggregate equal to the other one's, so that
    # both read one exchange.
    top = rows.orderBy(F.desc("current"), F.asc_nulls_last("key"), "previous").limit(n)
    top = top.select(F.col("key").alias("top_key"))
    # n rows at most, by the limit above.
    marked = rows.join(F.broadcast(top.withColumn("is_top", F.lit(True))), F.col("key").eqNullSafe(F.col("top_key")), "left")
    is_other = F.col("is_top").isNull()
    folded = marked.groupBy(is_other.alias("is_other"), F.when(~is_other, F.col("key")).alias("key")).agg(
        F.sum("current").alias("current"), F.sum("previous").alias("previous")
    )
    overall = F.sum("current").over(Window.partitionBy())  # over n + 1 rows
    share = F.when(F.col("overall") != 0, F.col("current") / F.col("overall") * 100).otherwise(0.0)
    table = folded.withColumn("overall", overall).select(
        F.when(F.col("is_other"), OTHER_LABEL).otherwise(display_label(F.col("key"))).alias("label"),
        "is_other",
        "current",
        "previous",
        (F.col("current") - F.col("previous")).alias("absolute_change"),
        percent_change(F.col("current"), F.col("previous")).alias("percentage_change"),
        share.alias("percentage_total"),
    )
    key = F.lower(F.col("label")) if sort_by == "label" else F.col(sort_by)
    ordered = F.desc_nulls_last if descending else F.asc_nulls_last
    return table.orderBy(ordered(key), F.asc("label"))


def biggest_movers(
    nc: DataFrame, current: CostFilter, previous: CostFilter, dimension: Dimension, n: int = 5
) -> DataFrame:
    """The ``n`` largest increases and decreases: direction, key, current, previous, changes."""
    rows = compared(nc, current, previous, dimension).drop("currency")
    tie = F.asc_nulls_last("key")
    up = rows.where("absolute_change > 0").orderBy(F.desc("absolute_change"), tie).limit(n)
    down = rows.where("absolute_change < 0").orderBy(F.asc("absolute_change"), tie).limit(n)
    return up.select(F.lit("increase").alias("direction"), "*").unionByName(
        down.select(F.lit("decrease").alias("direction"), "*")
    )


def _is_credit() -> Column:
    return F.coalesce(F.col("charge_category").isin(CREDIT_CATEGORIES), F.lit(False))


def _split_measures(cost: Column) -> list[Column]:
    zero = F.lit(0.0)
    credit = _is_credit()
    return [
        F.coalesce(F.sum(F.when(~credit, cost)), zero).alias("charges"),
        F.coalesce(F.sum(F.when(credit, cost)), zero).alias("credits"),
        F.count(F.when(credit, 1)).alias("credit_rows"),
        F.count("*").alias("row_count"),
    ]


def credits_split(nc: DataFrame, f: CostFilter) -> DataFrame:
    """Per period: charges, credits, net, row_count and has_credits."""
    cost = F.col(f.metric.column)
    grouped = (
        nc.where(matches(f))
        .groupBy(period_start(f.granularity, F.col("usage_start")).alias("period"), "currency")
        .agg(*_split_measures(cost))
    )
    rows = single_currency(grouped, "error", "charges", "credits", "credit_rows", "row_count")
    return rows.select(
        "period",
        "charges",
        "credits",
        (F.col("charges") + F.col("credits")).alias("net"),
        "row_count",
        (F.col("credit_rows") > 0).alias("has_credits"),
    ).orderBy("period")


def credit_categories(nc: DataFrame, f: CostFilter) -> DataFrame:
    """Credit totals per category, largest magnitude first."""
    rows = totals_by(nc, f, category=F.col("charge_category")).where(F.col("category").isin(CREDIT_CATEGORIES))
    return rows.select("category", "total").orderBy(F.desc(F.abs("total")), "category")


def credits_card(nc: DataFrame, f: CostFilter) -> DataFrame:
    """One row for the whole range: charges, credits, net and the share of charges credits cancel.

    The share is a whole percentage, NULL unless there are charges; ``visible`` is false without
    credits.
    """
    grouped = nc.where(matches(f)).groupBy("currency").agg(*_split_measures(F.col(f.metric.column)))
    rows = single_currency(grouped, "error", "charges", "credits", "credit_rows", "row_count")
    one = rows.groupBy().agg(
        F.coalesce(F.sum("charges"), F.lit(0.0)).alias("charges"),
        F.coalesce(F.sum("credits"), F.lit(0.0)).alias("credits"),
    )
    charges, credits = F.col("charges"), F.col("credits")
    return one.select(
        "charges",
        "credits",
        (charges + credits).alias("net"),
        F.when(charges > 0, F.floor(F.abs(credits) / charges * 100 + 0.5)).alias("share_pct"),
        (credits != 0).alias("visible"),
    )


def run_rate(nc: DataFrame, today: date, metric: CostMetric = CostMetric.AMORTIZED) -> DataFrame:
    """Month to date and its projection to the full month."""
    f = CostFilter.between(month_start(today), today + timedelta(days=1), metric=metric)
    return summary(nc, f).select(
        "currency",
        F.col("total").alias("month_to_date"),
        (F.col("total") / today.day * days_in_month(today)).alias("projected"),
        F.lit(today.day).alias("days_elapsed"),
        F.lit(days_in_month(today)).alias("days_in_month"),
    )


def year_boundaries(nc: DataFrame, f: CostFilter) -> DataFrame:
    """Where a series enters a new year: the point's position and period. None at year granularity."""
    points = nc.where(matches(f)).select(period_start(f.granularity, F.col("usage_start")).alias("period")).distinct()
    order = Window.orderBy("period")  # over the periods of the range, at most one for each day
    numbered = points.select(
        (F.row_number().over(order) - 1).alias("position"),
        "period",
        F.lag(F.year("period")).over(order).alias("previous_year"),
    )
    if f.granularity is Granularity.YEAR:
        numbered = numbered.where(F.lit(False))
    return numbered.where(F.year("period") != F.col("previous_year")).select("position", "period")


# The breakdowns shown for each kind of entity.
ENTITY_BREAKDOWNS = {
    "service": [Dimension.ACCOUNT, Dimension.REGION, Dimension.CHARGE_CATEGORY],
    "account": [Dimension.SERVICE, Dimension.REGION],
    "resource": [Dimension.CHARGE_CATEGORY, Dimension.PRICING_CATEGORY, Dimension.REGION],
    "tag": [Dimension.SERVICE, Dimension.ACCOUNT, Dimension.REGION],
}


def entity_filter(f: CostFilter, entity: str, value: str, tag_key: str | None = None) -> CostFilter:
    if entity == "tag":
        return replace(f, tags=(TagFilter(tag_key, TagOp.EQ, (value,)),))
    field = {"service": "services", "account": "accounts", "resource": "resource_ids"}[entity]
    return replace(f, **{field: (value,)})


def entity_detail(
    nc: DataFrame,
    f: CostFilter,
    entity: str,
    value: str,
    tag_key: str | None = None,
    breakdown_rows: int = 10,
    resource_rows: int = 15,
    min_share: float = 0.0,
) -> DataFrame:
    """Everything an entity page shows, from one scan: section, period, key, is_other, total, row_count.

    Sections: ``kpi`` (one row), ``trend`` (per period and charge category), ``by_<dimension>`` (the top
    ``breakdown_rows`` plus "Other", as in ``breakdown_with_other``) and ``resources`` (the top
    ``resource_rows``). Each line is entered once per section and one
    aggregate computes them all. Rows are limited by a row_number that Spark applies before the
    shuffle as well (window group limit), so no section is gathered whole.
    """
    scoped = entity_filter(f, entity, value, tag_key)
    breakdowns = {f"by_{d.value}": d for d in ENTITY_BREAKDOWNS[entity]}
    no_period, period = F.lit(None).cast("timestamp_ntz"), period_start(f.granularity, F.col("usage_start"))
    sections = [("kpi", no_period, F.lit(None).cast("string")), ("trend", period, F.col("charge_category"))]
    sections += [(name, no_period, F.col(d.column)) for name, d in breakdowns.items()]
    sections += [("resources", no_period, F.col(Dimension.RESOURCE.column))]
    entries = F.array(
        *[F.struct(F.lit(name).alias("section"), p.alias("period"), k.alias("key")) for name, p, k in sections]
    )
    grouped = (
        nc.where(matches(scoped))
        .select(F.inline(entries), "currency", F.col(f.metric.column).alias("cost"))
        .groupBy("section", "period", "key", "currency")
        .agg(F.sum("cost").alias("total"), F.count("*").alias("row_count"))
    )
    rows = single_currency(grouped, "error", *MEASURES).drop("currency")
    # Every trend row is a partition of its own, so the limit leaves the trend whole.
    trend_key = F.when(F.col("section") == "trend", F.col("key"))
    order = Window.partitionBy("section", "period", trend_key).orderBy(
        F.desc_nulls_last("total"), F.asc_nulls_last("key"), "row_count"
    )
    is_breakdown = F.startswith("section", F.lit("by_"))
    shown = (
        rows.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= max(check_limit(breakdown_rows), check_limit(resource_rows)))
        .where(F.col("rank") <= F.when(is_breakdown, breakdown_rows).otherwise(resource_rows))
    )
    kpi = F.sum(F.when(F.col("section") == "kpi", F.col("total")))
    lines = F.sum(F.when(F.col("section") == "kpi", F.col("row_count")))
    overall = grouped.agg(F.struct(kpi.alias("total"), lines.alias("n"), currency_names().alias("c")))
    # The conditions on sections sit on aggregated columns: a filter on the section itself would be
    # pushed into the scan and make it a different, second scan.
    rest = (
        shown.groupBy("section")
        .agg(F.sum("total").alias("shown"), F.max(is_breakdown).alias("is_breakdown"), F.sum("row_count").alias("n"))
        .withColumn("overall", F.coalesce(overall.scalar().getField("total"), F.lit(0.0)))
        .withColumn("rest", F.col("overall") - F.col("shown"))
        .where(F.col("is_breakdown") & (F.col("n") < overall.scalar().getField("n")))
        .where(F.abs("rest") >= F.abs("overall") * min_share)
        .select(
            "section",
            no_period.alias("period"),
            F.lit(OTHER_LABEL).alias("key"),
            F.lit(True).alias("is_other"),
            F.col("rest").alias("total"),
            F.lit(None).cast("bigint").alias("row_count"),
        )
    )
    named = shown.select("section", "period", "key", F.lit(False).alias("is_other"), "total", "row_count")
    return named.unionByName(rest)
