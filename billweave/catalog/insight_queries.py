"""Registered queries: "Other" buckets, trends, movers, credits, run rate, entity pages, presets."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from billweave.catalog.cost_queries import IN_97, IN_98, PCT, WHOLE, YEAR_97, YEAR_98, compare_cte, nc_for
from billweave.catalog.registry import register
from billweave.catalog.star import costs as star_costs
from billweave.catalog.star import present, r2, sql
from billweave.functions.periods import Preset, preset_range
from billweave.model import CostFilter, CostMetric, Dimension, Granularity
from billweave.operators import insights
from billweave.operators.predicates import in_range

NONE = "CASE WHEN coalesce({0}, '') = '' THEN '(none)' ELSE {0} END"

# --- breakdown with "Other" -----------------------------------------------------------------------


def _with_other(dimension, n, f=WHOLE, min_share=0.0):
    return lambda spark, d: present(
        insights.breakdown_with_other(nc_for(spark, d, dimension), f, dimension, n, min_share)
    )


def _with_other_sql(column, n, where="TRUE", min_share=0.0):
    return sql(
        f"""SELECT {NONE.format('key')} AS label, FALSE AS is_other, {r2('total')} AS total FROM top
        UNION ALL
        SELECT 'Other', TRUE, {r2('o - s')} FROM (SELECT (SELECT coalesce(sum(total), 0) FROM g) AS o,
          (SELECT coalesce(sum(total), 0) FROM top) AS s)
        WHERE (SELECT count(*) FROM g) > {n} AND abs(o - s) >= abs(o) * {min_share}""",
        f"g AS (SELECT {column} AS key, sum(amortized_cost) AS total FROM nc WHERE {where} GROUP BY {column})",
        f"top AS (SELECT key, total FROM g ORDER BY total DESC, key NULLS LAST LIMIT {n})",
    )


register("breakdown_with_other_service", _with_other(Dimension.SERVICE, 3), _with_other_sql("service_name", 3))
register("breakdown_with_other_account", _with_other(Dimension.ACCOUNT, 10), _with_other_sql("account_id", 10))
register("breakdown_with_other_resource", _with_other(Dimension.RESOURCE, 10), _with_other_sql("resource_id", 10))
register(
    "breakdown_with_other_negligible",
    _with_other(Dimension.SERVICE, 4, min_share=0.5),
    _with_other_sql("service_name", 4, min_share=0.5),
)
register(
    "breakdown_with_other_complete",
    _with_other(Dimension.REGION, 10, YEAR_98),
    _with_other_sql("region", 10, IN_98),
)

# --- stacked trend --------------------------------------------------------------------------------


def _trend(dimension, n, f):
    return lambda spark, d: present(insights.trend_with_other(nc_for(spark, d, dimension), f, dimension, n))


def _trend_sql(column, n, unit, where="TRUE"):
    return sql(
        f"""SELECT strftime(period, '%Y-%m-%d %H:%M:%S') AS period, CAST(rank AS INTEGER) AS rank, label, is_other,
          {r2('total')} AS total, CAST(row_count AS BIGINT) AS row_count FROM (
          SELECT p.period, t.rank, {NONE.format('t.key')} AS label, FALSE AS is_other,
            coalesce(sum(g.total), 0) AS total, coalesce(sum(g.n), 0) AS row_count
          FROM (SELECT DISTINCT period FROM g) p CROSS JOIN top t
          LEFT JOIN g ON g.period = p.period AND g.key IS NOT DISTINCT FROM t.key GROUP BY ALL
          UNION ALL
          SELECT p.period, 0, 'Other', TRUE, coalesce(sum(g.total), 0), coalesce(sum(g.n), 0)
          FROM (SELECT DISTINCT period FROM g) p
          LEFT JOIN (SELECT g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.key IS NOT DISTINCT FROM g.key)) g
            ON g.period = p.period
          WHERE (SELECT count(*) FROM (SELECT DISTINCT key FROM g)) > (SELECT count(*) FROM top)
          GROUP BY ALL)""",
        f"g AS (SELECT date_trunc('{unit}', usage_start) AS period, {column} AS key, sum(amortized_cost) AS total, "
        f"count(*) AS n FROM nc WHERE {where} GROUP BY ALL)",
        "top AS (SELECT key, row_number() OVER (ORDER BY total DESC, key NULLS LAST) AS rank FROM "
        f"(SELECT key, sum(total) AS total FROM g GROUP BY key) ORDER BY rank LIMIT {n})",
    )


register("trend_month_by_service", _trend(Dimension.SERVICE, 4, WHOLE), _trend_sql("service_name", 4, "month"))
register(
    "trend_year_by_account",
    _trend(Dimension.ACCOUNT, 50, replace(WHOLE, granularity=Granularity.YEAR)),
    _trend_sql("account_id", 50, "year"),
)
register(
    "trend_with_500",
    _trend(Dimension.RESOURCE, 500, replace(WHOLE, granularity=Granularity.YEAR)),
    _trend_sql("resource_id", 500, "year"),
)
register(
    "trend_day_by_region",
    _trend(Dimension.REGION, 8, replace(YEAR_98, granularity=Granularity.DAY)),
    _trend_sql("region", 8, "day", IN_98),
)

# --- comparison table and movers ------------------------------------------------------------------


def _table(dimension, n, sort_by="current", descending=True):
    return lambda spark, d: present(
        insights.comparison_table(nc_for(spark, d, dimension), YEAR_98, YEAR_97, dimension, n, sort_by, descending)
    )


def _table_sql(column, n):
    return sql(
        f"""SELECT CASE WHEN is_other THEN 'Other' ELSE {NONE.format('key')} END AS label, is_other,
          {r2('current')} AS current, {r2('previous')} AS previous, {r2('current - previous')} AS absolute_change,
          {PCT} AS percentage_change,
          {r2('current / (SELECT sum(current) FROM j) * 100', 4)} AS percentage_total
        FROM (SELECT rank > {n} AS is_other, CASE WHEN rank <= {n} THEN key END AS key,
            sum(current) AS current, sum(previous) AS previous
          FROM (SELECT *, row_number() OVER (ORDER BY current DESC, key NULLS LAST) AS rank FROM j) GROUP BY ALL)""",
        compare_cte(column, IN_98, IN_97),
    )


register("comparison_table_service", _table(Dimension.SERVICE, 3), _table_sql("service_name", 3))
register("comparison_table_account", _table(Dimension.ACCOUNT, 10, "percentage_change"), _table_sql("account_id", 10))
register("comparison_table_resource", _table(Dimension.RESOURCE, 20, "label", False), _table_sql("resource_id", 20))


def _movers(spark, d):
    now, before = CostFilter.between("1998-07-01", "1998-08-01"), CostFilter.between("1998-06-01", "1998-07-01")
    return present(insights.biggest_movers(nc_for(spark, d), now, before, Dimension.RESOURCE))


def _movers_part(direction, condition, order):
    return (
        f"(SELECT '{direction}' AS direction, key, {r2('current')} AS current, {r2('previous')} AS previous, "
        f"{r2('current - previous')} AS absolute_change, {PCT} AS percentage_change FROM j "
        f"WHERE current - previous {condition} ORDER BY current - previous {order}, key LIMIT 5)"
    )


register(
    "biggest_movers",
    _movers,
    sql(
        _movers_part("increase", "> 0", "DESC") + " UNION ALL " + _movers_part("decrease", "< 0", "ASC"),
        compare_cte(
            "resource_id",
            "usage_start >= TIMESTAMP '1998-07-01' AND usage_start < TIMESTAMP '1998-08-01'",
            "usage_start >= TIMESTAMP '1998-06-01' AND usage_start < TIMESTAMP '1998-07-01'",
        ),
    ),
)

# --- credits --------------------------------------------------------------------------------------

_CREDIT = "charge_category IN ('Credit', 'Refund', 'Discount', 'Adjustment')"
_CHARGES = f"coalesce(sum(amortized_cost) FILTER (NOT {_CREDIT}), 0)"
_CREDITS = f"coalesce(sum(amortized_cost) FILTER ({_CREDIT}), 0)"
register(
    "credits_split",
    lambda spark, d: present(insights.credits_split(nc_for(spark, d), WHOLE)),
    sql(
        f"""SELECT strftime(date_trunc('month', usage_start), '%Y-%m-%d %H:%M:%S') AS period,
        {r2(_CHARGES)} AS charges, {r2(_CREDITS)} AS credits, {r2('sum(amortized_cost)')} AS net,
        count(*) AS row_count, count(*) FILTER ({_CREDIT}) > 0 AS has_credits FROM nc GROUP BY 1"""
    ),
)
register(
    "credit_categories",
    lambda spark, d: present(insights.credit_categories(nc_for(spark, d), WHOLE)),
    sql(
        f"SELECT charge_category AS category, {r2('sum(amortized_cost)')} AS total FROM nc WHERE {_CREDIT} "
        "GROUP BY charge_category"
    ),
)
register(
    "credits_card",
    lambda spark, d: present(insights.credits_card(nc_for(spark, d), replace(YEAR_98, metric=CostMetric.BILLED))),
    sql(
        f"""SELECT {r2('charges')} AS charges, {r2('credits')} AS credits, {r2('charges + credits')} AS net,
        CASE WHEN charges > 0 THEN CAST(floor(abs(credits) / charges * 100 + 0.5) AS BIGINT) END AS share_pct,
        credits <> 0 AS visible FROM (
        SELECT {_CHARGES.replace('amortized', 'billed')} AS charges, {_CREDITS.replace('amortized', 'billed')} AS credits
        FROM nc WHERE {IN_98})"""
    ),
)

# --- dates ----------------------------------------------------------------------------------------

TODAY = date(1998, 8, 17)
register(
    "run_rate",
    lambda spark, d: present(insights.run_rate(nc_for(spark, d), TODAY)),
    sql(
        f"""SELECT 'USD' AS currency, {r2('t')} AS month_to_date, {r2('t / 17 * 31')} AS projected,
        17 AS days_elapsed, 31 AS days_in_month FROM (SELECT sum(amortized_cost) AS t FROM nc
        WHERE usage_start >= TIMESTAMP '1998-08-01' AND usage_start < TIMESTAMP '1998-08-18')"""
    ),
)
register(
    "year_boundaries",
    lambda spark, d: present(insights.year_boundaries(nc_for(spark, d), replace(WHOLE, granularity=Granularity.DAY))),
    sql(
        """SELECT CAST(position AS INTEGER) AS position, strftime(period, '%Y-%m-%d %H:%M:%S') AS period FROM (
        SELECT row_number() OVER (ORDER BY period) - 1 AS position, period,
          lag(year(period)) OVER (ORDER BY period) AS y FROM (SELECT DISTINCT date_trunc('day', usage_start) AS period FROM nc))
        WHERE y <> year(period)"""
    ),
)


def _presets(spark, d):
    # All presets in one scan: a line counts in every range that holds its day.
    ranges = {}
    for preset in Preset:
        first, last = preset_range(preset, TODAY)
        ranges[preset.value] = CostFilter.between(first, last + timedelta(days=1))
    sums = [F.coalesce(F.sum(F.when(in_range(f), F.col("amortized_cost"))), F.lit(0.0)) for f in ranges.values()]
    wanted = reduce(or_, map(in_range, ranges.values()))
    one = nc_for(spark, d).where(wanted).agg(*[s.alias(n) for n, s in zip(ranges, sums)])
    return present(
        one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("preset"), F.col(f"`{n}`").alias("total")) for n in ranges])).alias("p")).select("p.*")
    )


_PRESET_SQL = {
    "mtd": ("1998-08-01", "1998-08-17"),
    "last-month": ("1998-07-01", "1998-07-31"),
    "30d": ("1998-07-19", "1998-08-17"),
    "3m": ("1998-06-01", "1998-08-17"),
    "6m": ("1998-03-01", "1998-08-17"),
    "12m": ("1997-09-01", "1998-08-17"),
    "ytd": ("1998-01-01", "1998-08-17"),
    "last-year": ("1997-01-01", "1997-12-31"),
}
register(
    "date_presets",
    _presets,
    sql(
        " UNION ALL ".join(
            f"SELECT '{n}' AS preset, {r2('coalesce(sum(amortized_cost), 0)')} AS total FROM nc "
            f"WHERE CAST(usage_start AS DATE) BETWEEN DATE '{a}' AND DATE '{b}'"
            for n, (a, b) in _PRESET_SQL.items()
        )
    ),
)

# --- entity pages ---------------------------------------------------------------------------------


def _entity(entity, value, tag_key=None, f=WHOLE):
    return lambda spark, d: present(insights.entity_detail(star_costs(spark, d), f, entity, value, tag_key))


def _entity_sql(where, dims, pricing="pricing_category"):
    """``dims`` maps a breakdown's name to its column."""
    total, stamp = "sum(amortized_cost)", "strftime(date_trunc('month', usage_start), '%Y-%m-%d %H:%M:%S')"
    none = "CAST(NULL AS VARCHAR)"
    head = [
        f"SELECT 'kpi' AS section, {none} AS period, {none} AS key, FALSE AS is_other, {r2(total)} AS total, "
        "count(*) AS row_count FROM e",
        f"SELECT 'trend', {stamp}, charge_category, FALSE, {r2(total)}, count(*) FROM e GROUP BY ALL",
    ]
    tops = []
    for name, (column, n) in {**{k: (c, 10) for k, c in dims.items()}, "resources": ("resource_id", 15)}.items():
        tops.append(
            f"(SELECT '{name}' AS section, {column} AS key, {total} AS total, count(*) AS row_count FROM e "
            f"GROUP BY {column} ORDER BY total DESC, {column} NULLS LAST LIMIT {n})"
        )
    rest = (
        f"SELECT section, {none}, 'Other', TRUE, {r2('o - s')}, CAST(NULL AS BIGINT) FROM ("
        f"SELECT section, sum(total) AS s, sum(row_count) AS shown, (SELECT {total} FROM e) AS o FROM top "
        "WHERE section <> 'resources' GROUP BY section) WHERE shown < (SELECT count(*) FROM e)"
    )
    shown = f"SELECT section, {none}, key, FALSE, {r2('total')}, row_count FROM top"
    return sql(
        " UNION ALL ".join([*head, shown, rest]),
        f"e AS (SELECT * FROM nc WHERE {where})",
        "top AS (" + " UNION ALL ".join(tops) + ")",
    )


register(
    "entity_service",
    _entity("service", "ECONOMY"),
    _entity_sql(
        "service_name = 'ECONOMY'",
        {"by_account": "account_id", "by_region": "region", "by_charge_category": "charge_category"},
    ),
)
register(
    "entity_account",
    _entity("account", "NATION_7"),
    _entity_sql("account_id = 'NATION_7'", {"by_service": "service_name", "by_region": "region"}),
)
register(
    "entity_resource",
    _entity("resource", "part-42"),
    _entity_sql(
        "resource_id = 'part-42'",
        {"by_charge_category": "charge_category", "by_pricing_category": "CAST(NULL AS VARCHAR)", "by_region": "region"},
    ),
)
register(
    "entity_tag",
    _entity("tag", "BUILDING", "Segment"),
    _entity_sql(
        "tag_segment = 'BUILDING'", {"by_service": "service_name", "by_account": "account_id", "by_region": "region"}
    ),
)
