"""Registered queries: normalisers, filters, cost aggregates and lookups."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.catalog.registry import register
from billweave.catalog.star import (
    END_DAY,
    FIRST_DAY,
    cur_export,
    costs as star_costs,
    focus_costs,
    present,
    r2,
    sql,
)
from billweave.functions.periods import auto_granularity, months_overlapping, previous_period
from billweave.model import (
    CostFilter,
    CostMetric,
    Dimension,
    Granularity,
    TagFilter,
    TagOp,
    merge_page_filter,
)
from billweave.operators import costs
from billweave.sources.normalise import normalise, pick_source, union_sources

WHOLE = CostFilter.between(FIRST_DAY, END_DAY)
YEAR_98 = CostFilter.between("1998-01-01", "1999-01-01")
YEAR_97 = CostFilter.between("1997-01-01", "1998-01-01")
IN_98 = "usage_start >= TIMESTAMP '1998-01-01' AND usage_start < TIMESTAMP '1999-01-01'"
IN_97 = "usage_start >= TIMESTAMP '1997-01-01' AND usage_start < TIMESTAMP '1998-01-01'"

# --- normalisers ----------------------------------------------------------------------------------


def _by_category(nc):
    return present(
        nc.groupBy("charge_category", "commitment_type", "provider", "source_format").agg(
            F.sum("billed_cost").alias("billed"),
            F.sum("amortized_cost").alias("amortized"),
            F.sum("usage_quantity").alias("quantity"),
            F.count("*").alias("row_count"),
        )
    )


def _by_category_sql(source_format: str, commitment: str = "commitment_type") -> str:
    return sql(
        f"SELECT charge_category, {commitment} AS commitment_type, 'AWS' AS provider, "
        f"'{source_format}' AS source_format, {r2('sum(billed_cost)')} AS billed, "
        f"{r2('sum(amortized_cost)')} AS amortized, {r2('sum(usage_quantity)')} AS quantity, "
        "count(*) AS row_count FROM nc GROUP BY ALL"
    )


register(
    "normalise_cur2",
    lambda spark, d: _by_category(star_costs(spark, d, part=False, account=False, tags=False)),
    _by_category_sql("cur2"),
)
register(
    "normalise_focus12",
    lambda spark, d: _by_category(focus_costs(spark, d, "1.2", part=False, account=False, tags=False)),
    _by_category_sql("focus12"),
)
register(
    "normalise_focus10",
    lambda spark, d: _by_category(focus_costs(spark, d, "1.0", part=False, account=False, tags=False)),
    _by_category_sql("focus10", "CAST(NULL AS VARCHAR)"),
)


def _optional_columns(spark, d):
    # An account without savings plans or reservations: its export has none of their columns.
    raw = cur_export(spark, d, part=False, account=True, tags=False)
    kept = [c for c in raw.columns if not c.startswith(("savings_plan_", "reservation_"))]
    nc = normalise(raw.select(*kept), source_file=F.lit("x"))
    return present(
        nc.groupBy("charge_category").agg(
            F.sum("billed_cost").alias("billed"),
            F.sum("amortized_cost").alias("amortized"),
            F.count("commitment_id").alias("commitments"),
        )
    )


register(
    "normalise_missing_columns",
    _optional_columns,
    sql(
        f"""SELECT charge_category, {r2('sum(billed_cost)')} AS billed, {r2('''sum(CASE
          WHEN kind IN ('SavingsPlanCoveredUsage', 'SavingsPlanRecurringFee', 'SavingsPlanNegation',
            'SavingsPlanUpfrontFee', 'DiscountedUsage', 'RIFee') THEN 0
          ELSE unblended END)''')} AS amortized,
        CAST(0 AS BIGINT) AS commitments
        FROM (SELECT nc.*, CASE WHEN charge_category IN ('Credit', 'Refund', 'Adjustment', 'Discount')
          THEN usage_quantity * -3 ELSE NULL END AS reduction,
          coalesce(reduction, billed_cost + CASE WHEN two_sided THEN usage_quantity ELSE 0 END) AS unblended
          FROM (SELECT nc.*, tag_team IS NOT NULL AS two_sided FROM nc) nc) GROUP BY charge_category"""
    ),
)


def _parity(spark, d):
    frames = {
        "a": star_costs(spark, d),
        "b": focus_costs(spark, d, "1.2"),
        "c": focus_costs(spark, d, "1.0"),
    }
    return present(
        union_sources(frames)
        .groupBy("source_id", "source_format", "region")
        .agg(
            F.sum("billed_cost").alias("billed"),
            F.sum("amortized_cost").alias("amortized"),
            F.count("availability_zone").alias("zones"),
            F.count("list_cost").alias("list_prices"),
            F.count("tags").alias("tagged"),
            F.count("*").alias("row_count"),
        )
    )


def _parity_part(source, fmt, zones, prices, tagged):
    return (
        f"SELECT '{source}' AS source_id, '{fmt}' AS source_format, region, {r2('sum(billed_cost)')} AS billed, "
        f"{r2('sum(amortized_cost)')} AS amortized, {zones} AS zones, {prices} AS list_prices, "
        f"{tagged} AS tagged, count(*) AS row_count FROM nc GROUP BY region"
    )


_NO = "CAST(0 AS BIGINT)"
register(
    "union_of_formats",
    _parity,
    sql(
        " UNION ALL ".join(
            [
                _parity_part("a", "cur2", "count(*)", _NO, "count(tag_segment)"),
                _parity_part("b", "focus12", "count(*)", "count(*)", "count(tag_segment)"),
                _parity_part("c", "focus10", _NO, "count(*)", _NO),
            ]
        )
    ),
)


def _one_source(spark, d):
    sources = {"aws-main": star_costs(spark, d, part=False), "aws-focus": focus_costs(spark, d, "1.2", part=False)}
    return present(costs.breakdown(pick_source(sources, "aws-focus"), WHOLE, Dimension.REGION))


register(
    "one_source_by_id",
    _one_source,
    sql(
        f"SELECT region AS key, 'USD' AS currency, {r2('sum(amortized_cost)')} AS total, count(*) AS row_count "
        "FROM nc GROUP BY region"
    ),
)

# --- summary --------------------------------------------------------------------------------------


def _summary(f, **needs):
    def run(spark, d):
        return present(costs.summary(star_costs(spark, d, **{"part": False, "account": False, "tags": False, **needs}), f))

    return run


def _summary_sql(f: CostFilter, where: str = "TRUE") -> str:
    lo, hi = f.start, f.end
    return sql(
        f"""SELECT '{f.metric.value}' AS metric, coalesce(min(currency), '') AS currency,
        {r2(f'coalesce(sum({f.metric.column}), 0)')} AS total, count(*) AS row_count,
        (SELECT min('cur2') FROM nc WHERE usage_start >= TIMESTAMP '{lo}' AND usage_start < TIMESTAMP '{hi}')
          AS source_format,
        '{lo}' AS "start", '{hi}' AS "end"
        FROM nc WHERE usage_start >= TIMESTAMP '{lo}' AND usage_start < TIMESTAMP '{hi}' AND {where}"""
    )


register("summary", _summary(WHOLE), _summary_sql(WHOLE))
_BILLED = replace(YEAR_98, metric=CostMetric.BILLED)
register("summary_billed_year", _summary(_BILLED), _summary_sql(_BILLED))
_EMPTY = CostFilter.between("2010-01-01", "2011-01-01")
register("summary_empty_range", _summary(_EMPTY), _summary_sql(_EMPTY))
_NO_MATCH = replace(WHOLE, services=("no such service",))
register("summary_no_match", _summary(_NO_MATCH, part=True), _summary_sql(_NO_MATCH, "service_name = 'no such service'"))
register(
    "summary_per_currency",
    lambda spark, d: present(
        costs.summary(
            star_costs(spark, d, part=False, tags=False, two_currencies=True), WHOLE, on_mixed="split"
        ).drop("start", "end")
    ),
    sql(
        f"SELECT 'amortized' AS metric, two_currencies AS currency, {r2('sum(amortized_cost)')} AS total, "
        "count(*) AS row_count, 'cur2' AS source_format FROM nc GROUP BY two_currencies"
    ),
)


def _list_price(spark, d):
    f = replace(WHOLE, metric=CostMetric.LIST)
    return present(costs.summary(focus_costs(spark, d, "1.2", part=False, account=False, tags=False), f).select("metric", "total", "row_count", "source_format"))


register(
    "summary_list_price",
    _list_price,
    sql(
        f"SELECT 'list' AS metric, {r2('sum(billed_cost + usage_quantity * 2)')} AS total, "
        "count(*) AS row_count, 'focus12' AS source_format FROM nc"
    ),
)

# --- predicates -----------------------------------------------------------------------------------

FILTERS = {
    "filter_accounts": (
        dict(accounts=("NATION_3", "NATION_7", "NATION_11")),
        "account_id IN ('NATION_3', 'NATION_7', 'NATION_11')",
    ),
    "filter_services": (dict(services=("ECONOMY", "LARGE")), "service_name IN ('ECONOMY', 'LARGE')"),
    "filter_regions": (dict(regions=("ASIA",)), "region = 'ASIA'"),
    "filter_charge_categories": (dict(charge_categories=("Usage", "Tax")), "charge_category IN ('Usage', 'Tax')"),
    "filter_resource_ids": (dict(resource_ids=("part-7", "part-11")), "resource_id IN ('part-7', 'part-11')"),
    "filter_lists_and_tags": (
        dict(
            regions=("ASIA", "EUROPE"),
            services=("SMALL", "STANDARD"),
            tags=(TagFilter("Segment", TagOp.IN, ("BUILDING", "FURNITURE")), TagFilter("Team", TagOp.EXISTS)),
        ),
        "region IN ('ASIA', 'EUROPE') AND service_name IN ('SMALL', 'STANDARD') "
        "AND tag_segment IN ('BUILDING', 'FURNITURE') AND tag_team IS NOT NULL",
    ),
    "filter_tag_eq": (dict(tags=(TagFilter("Segment", TagOp.EQ, ("BUILDING", "ignored")),)), "tag_segment = 'BUILDING'"),
    "filter_tag_ne": (
        dict(tags=(TagFilter("Segment", TagOp.NE, ("BUILDING",)),)),
        "tag_segment IS DISTINCT FROM 'BUILDING'",
    ),
    "filter_tag_exists": (dict(tags=(TagFilter("Team", TagOp.EXISTS),)), "tag_team IS NOT NULL"),
    "filter_tag_not_exists": (dict(tags=(TagFilter("Team", TagOp.NOT_EXISTS),)), "tag_team IS NULL"),
    "filter_tag_in": (
        dict(tags=(TagFilter("Priority", TagOp.IN, ("1-URGENT", "2-HIGH")),)),
        "tag_priority IN ('1-URGENT', '2-HIGH')",
    ),
    "filter_tag_without_values": (dict(tags=(TagFilter("Priority", TagOp.IN), TagFilter("Team", TagOp.EQ))), "TRUE"),
}


def _filtered(fields):
    f = replace(WHOLE, **fields)
    needs = dict(
        part=bool(f.services),
        account=bool(f.accounts or f.regions),
        tags=bool(f.tags),
    )

    def run(spark, d):
        rows = costs.breakdown(star_costs(spark, d, **needs), f, Dimension.CHARGE_CATEGORY)
        return present(rows)

    return run


for _name, (_fields, _where) in FILTERS.items():
    register(
        _name,
        _filtered(_fields),
        sql(
            f"SELECT charge_category AS key, 'USD' AS currency, {r2('sum(amortized_cost)')} AS total, "
            f"count(*) AS row_count FROM nc WHERE {_where} GROUP BY charge_category"
        ),
    )


def _page_filter(spark, d):
    page = replace(WHOLE, services=("ECONOMY",), accounts=("NATION_5", "NATION_6"))
    own = replace(YEAR_98, services=("SMALL", "MEDIUM"))
    return present(costs.breakdown(star_costs(spark, d, tags=False), merge_page_filter(own, page), Dimension.SERVICE))


register(
    "page_filter_merge",
    _page_filter,
    sql(
        f"SELECT service_name AS key, 'USD' AS currency, {r2('sum(amortized_cost)')} AS total, count(*) AS row_count "
        f"FROM nc WHERE {IN_98} AND service_name IN ('SMALL', 'MEDIUM') AND account_id IN ('NATION_5', 'NATION_6') "
        "GROUP BY service_name"
    ),
)

# --- series ---------------------------------------------------------------------------------------


def _series(granularity, group_by=None, metric=CostMetric.AMORTIZED, f=WHOLE, **needs):
    f = replace(f, granularity=granularity, metric=metric)

    def run(spark, d):
        nc = star_costs(spark, d, **{"part": False, "account": False, "tags": False, **needs})
        return present(costs.timeseries(nc, f, group_by))

    return run


def _series_sql(unit, group=None, metric="amortized_cost", where="TRUE"):
    grouped = f'{group} AS "group", ' if group else ""
    return sql(
        f"SELECT strftime(date_trunc('{unit}', usage_start), '%Y-%m-%d %H:%M:%S') AS period, {grouped}"
        f"'USD' AS currency, {r2(f'sum({metric})')} AS total, count(*) AS row_count FROM nc WHERE {where} GROUP BY ALL"
    )


register("timeseries_day", _series(Granularity.DAY), _series_sql("day"))
register("timeseries_month", _series(Granularity.MONTH), _series_sql("month"))
register(
    "timeseries_year_billed",
    _series(Granularity.YEAR, metric=CostMetric.BILLED),
    _series_sql("year", metric="billed_cost"),
)
register(
    "timeseries_month_by_service",
    _series(Granularity.MONTH, Dimension.SERVICE, part=True),
    _series_sql("month", "service_name"),
)
register(
    "timeseries_day_by_resource",
    _series(Granularity.DAY, Dimension.RESOURCE),
    _series_sql("day", "resource_id"),
)


def _series_adds_up(spark, d):
    """The series, the breakdown and the summary of one request have one total and one line count."""
    nc = nc_for(spark, d)
    parts = {
        "series": costs.timeseries(nc, replace(WHOLE, granularity=Granularity.DAY), Dimension.RESOURCE),
        "breakdown": costs.breakdown(nc, WHOLE, Dimension.RESOURCE),
        "summary": costs.summary(nc, WHOLE),
    }
    sums = [F.sum("total").alias("total"), F.sum("row_count").alias("row_count")]
    rows = [df.agg(*sums).select(F.lit(name).alias("report"), "*") for name, df in parts.items()]
    return present(reduce(DataFrame.unionByName, rows))


register(
    "series_breakdown_summary_agree",
    _series_adds_up,
    sql(
        f"SELECT unnest(['series', 'breakdown', 'summary']) AS report, {r2('t')} AS total, n AS row_count "
        "FROM (SELECT sum(amortized_cost) AS t, count(*) AS n FROM nc)"
    ),
)
register(
    "timeseries_day_by_category",
    _series(Granularity.DAY, Dimension.CHARGE_CATEGORY, f=YEAR_98),
    _series_sql("day", "charge_category", where=IN_98),
)

# --- breakdowns -----------------------------------------------------------------------------------

NEEDS = {
    Dimension.SERVICE: dict(part=True),
    Dimension.ACCOUNT: dict(account=True),
    Dimension.REGION: dict(account=True),
    Dimension.AVAILABILITY_ZONE: dict(account=True),
    Dimension.CHARGE_CATEGORY: dict(),
    Dimension.PRICING_CATEGORY: dict(tags=True),
    Dimension.RESOURCE: dict(),
}


def nc_for(spark, d, *dimensions, **more):
    needs = {"part": False, "account": False, "tags": False}
    for dimension in dimensions:
        needs |= NEEDS[dimension]
    return star_costs(spark, d, **{**needs, **more})


def _breakdown(dimension, limit):
    def run(spark, d):
        if dimension is Dimension.PRICING_CATEGORY:
            nc = focus_costs(spark, d, "1.2", part=False, account=False, tags=True)
        else:
            nc = nc_for(spark, d, dimension)
        return present(costs.breakdown(nc, WHOLE, dimension, limit))

    return run


for _dimension, _limit in {
    Dimension.SERVICE: 50,
    Dimension.ACCOUNT: 10,
    Dimension.REGION: 50,
    Dimension.AVAILABILITY_ZONE: 50,
    Dimension.CHARGE_CATEGORY: 50,
    Dimension.PRICING_CATEGORY: 50,
    Dimension.RESOURCE: 100,
}.items():
    register(
        f"breakdown_{_dimension.value}",
        _breakdown(_dimension, _limit),
        sql(
            f"SELECT {_dimension.column} AS key, 'USD' AS currency, {r2('sum(amortized_cost)')} AS total, "
            f"count(*) AS row_count FROM nc GROUP BY {_dimension.column} ORDER BY total DESC, key LIMIT {_limit}"
        ),
    )

register(
    "breakdown_resource_all",
    _breakdown(Dimension.RESOURCE, None),
    sql(
        f"SELECT resource_id AS key, 'USD' AS currency, {r2('sum(amortized_cost)')} AS total, "
        "count(*) AS row_count FROM nc GROUP BY resource_id"
    ),
)

# --- compare --------------------------------------------------------------------------------------

PCT = f"CASE WHEN previous <> 0 THEN {r2('(current - previous) / previous * 100', 4)} END"


def compare_cte(key: str, now: str, before: str, cost: str = "amortized_cost") -> str:
    return f"""c AS (SELECT {key} AS key, sum({cost}) AS total FROM nc WHERE {now} GROUP BY {key}),
p AS (SELECT {key} AS key, sum({cost}) AS total FROM nc WHERE {before} GROUP BY {key}),
j AS (SELECT coalesce(c.key, p.key) AS key, coalesce(c.total, 0) AS current, coalesce(p.total, 0) AS previous
  FROM c FULL OUTER JOIN p ON c.key IS NOT DISTINCT FROM p.key)"""


COMPARED = (
    f"{r2('current')} AS current, {r2('previous')} AS previous, "
    f"{r2('current - previous')} AS absolute_change, {PCT} AS percentage_change"
)

register(
    "compare_total",
    lambda spark, d: present(costs.compare(nc_for(spark, d), YEAR_98, YEAR_97)),
    sql(
        f"SELECT CAST(NULL AS VARCHAR) AS key, 'USD' AS currency, {COMPARED} FROM ("
        f"SELECT sum(amortized_cost) FILTER ({IN_98}) AS current, sum(amortized_cost) FILTER ({IN_97}) AS previous "
        "FROM nc)"
    ),
)
register(
    "compare_by_service",
    lambda spark, d: present(costs.compare(nc_for(spark, d, Dimension.SERVICE), YEAR_98, YEAR_97, Dimension.SERVICE)),
    sql(f"SELECT key, 'USD' AS currency, {COMPARED} FROM j", compare_cte("service_name", IN_98, IN_97)),
)


def _compare_scoped(spark, d):
    now = replace(YEAR_98, regions=("ASIA", "EUROPE"), metric=CostMetric.BILLED)
    before = replace(previous_period(YEAR_98), regions=("EUROPE", "AFRICA"))
    return present(costs.compare(nc_for(spark, d, Dimension.ACCOUNT), now, before, Dimension.ACCOUNT))


register(
    "compare_different_filters",
    _compare_scoped,
    sql(
        f"SELECT key, 'USD' AS currency, {COMPARED} FROM j",
        compare_cte(
            "account_id",
            f"{IN_98} AND region IN ('ASIA', 'EUROPE')",
            f"{IN_97} AND region IN ('EUROPE', 'AFRICA')",
            "billed_cost",
        ),
    ),
)


def _compare_resources(spark, d):
    now, before = CostFilter.between("1998-06-01", "1998-09-01"), CostFilter.between("1998-03-01", "1998-06-01")
    return present(costs.compare(nc_for(spark, d), now, before, Dimension.RESOURCE))


register(
    "compare_by_resource",
    _compare_resources,
    sql(
        f"SELECT key, 'USD' AS currency, {COMPARED} FROM j",
        compare_cte(
            "resource_id",
            "usage_start >= TIMESTAMP '1998-06-01' AND usage_start < TIMESTAMP '1998-09-01'",
            "usage_start >= TIMESTAMP '1998-03-01' AND usage_start < TIMESTAMP '1998-06-01'",
        ),
    ),
)
register(
    "compare_one_empty_side",
    lambda spark, d: present(
        costs.compare(
            nc_for(spark, d, Dimension.REGION), YEAR_98, CostFilter.between("1980-01-01", "1981-01-01"), Dimension.REGION
        )
    ),
    sql(
        f"SELECT key, 'USD' AS currency, {COMPARED} FROM j",
        compare_cte("region", IN_98, "usage_start < TIMESTAMP '1981-01-01'"),
    ),
)
register(
    "compare_per_currency",
    lambda spark, d: present(
        costs.compare(
            star_costs(spark, d, part=False, tags=False, two_currencies=True),
            YEAR_98,
            YEAR_97,
            Dimension.CHARGE_CATEGORY,
            on_mixed="split",
        )
    ),
    sql(
        f"SELECT charge_category AS key, two_currencies AS currency, {COMPARED} FROM ("
        f"SELECT charge_category, two_currencies, coalesce(sum(amortized_cost) FILTER ({IN_98}), 0) AS current, "
        f"coalesce(sum(amortized_cost) FILTER ({IN_97}), 0) AS previous FROM nc WHERE {IN_98} OR {IN_97} GROUP BY ALL)"
    ),
)

# Everything that SQL text or a pattern could take for something else.
ODD = "it's 100%_of \\ \"x\"; -- "


def _odd_values(spark, d):
    """Filter values are literals, whatever characters they have."""
    nc = nc_for(spark, d, Dimension.SERVICE, Dimension.REGION, tags=True)
    odd = nc.withColumns(
        {
            "service_name": F.concat(F.lit(ODD), "service_name"),
            "tags": F.map_from_arrays(F.transform(F.map_keys("tags"), lambda k: F.concat(F.lit(ODD), k)), F.map_values("tags")),
        }
    )
    tag = TagFilter(ODD + "Segment", TagOp.IN, ("BUILDING", "' OR '1'='1"))
    f = replace(YEAR_98, services=(ODD + "LARGE", ODD + "SMALL", "%"), tags=(tag,))
    return present(costs.breakdown(odd, f, Dimension.REGION))


register(
    "filter_values_are_literals",
    _odd_values,
    sql(
        f"""SELECT region AS key, 'USD' AS currency, {r2('sum(amortized_cost)')} AS total, count(*) AS row_count FROM nc
        WHERE {IN_98} AND service_name IN ('LARGE', 'SMALL') AND tag_segment = 'BUILDING' GROUP BY region"""
    ),
)

# A range for each granularity: up to 90 days, up to three years, beyond.
_AUTO = {"day": ("1998-02-01", "1998-05-02"), "month": ("1997-01-01", "2000-01-02"), "year": ("1996-01-01", "2000-01-01")}


def _auto(spark, d):
    nc, out = nc_for(spark, d), None
    for start, end in _AUTO.values():
        f = CostFilter.between(start, end)
        f = replace(f, granularity=auto_granularity((f.end - f.start).days))
        rows = costs.timeseries(nc, f).select(F.lit(f.granularity.value).alias("granularity"), "*")
        out = rows if out is None else out.unionAll(rows)
    return present(out)


register(
    "timeseries_auto_granularity",
    _auto,
    sql(
        " UNION ALL ".join(
            f"""SELECT '{g}' AS granularity, strftime(date_trunc('{g}', usage_start), '%Y-%m-%d %H:%M:%S') AS period, 'USD' AS currency,
            {r2('sum(amortized_cost)')} AS total, count(*) AS row_count FROM nc
            WHERE usage_start >= TIMESTAMP '{a}' AND usage_start < TIMESTAMP '{b}' GROUP BY 2"""
            for g, (a, b) in _AUTO.items()
        )
    ),
)


def _null_order(spark, d):
    """Services by cost, with their places: those whose costs are all NULL come last, the one without a name
    after the others. There are a few services, so one task may number them."""
    nc = nc_for(spark, d, Dimension.SERVICE)
    nc = nc.withColumn("amortized_cost", F.when(F.col("service_name") != "LARGE", F.col("amortized_cost")))
    ordered = costs.breakdown(nc, YEAR_98, Dimension.SERVICE).coalesce(1)
    return present(ordered.withColumn("position", F.monotonically_increasing_id()))


register(
    "breakdown_null_order",
    _null_order,
    sql(
        f"""SELECT service_name AS key, 'USD' AS currency, {r2('total')} AS total, row_count,
          row_number() OVER (ORDER BY total DESC NULLS LAST, service_name NULLS LAST) - 1 AS position
        FROM (SELECT service_name, sum(CASE WHEN service_name <> 'LARGE' THEN amortized_cost END) AS total, count(*) AS row_count
          FROM nc WHERE {IN_98} GROUP BY service_name)"""
    ),
)

# --- lookups and search ---------------------------------------------------------------------------

for _dimension in (Dimension.SERVICE, Dimension.ACCOUNT, Dimension.REGION, Dimension.RESOURCE):
    register(
        f"distinct_{_dimension.value}s",
        lambda spark, d, dim=_dimension: costs.distinct_values(nc_for(spark, d, dim), dim),
        sql(
            f"SELECT DISTINCT {_dimension.column} AS value FROM nc WHERE {_dimension.column} IS NOT NULL"
        ),
    )
register(
    "distinct_tag_keys",
    lambda spark, d: costs.distinct_tag_keys(nc_for(spark, d, tags=True)),
    sql(
        "SELECT unnest(['Segment', 'Priority', 'Team']) AS value FROM (SELECT 1 FROM nc WHERE tag_segment IS NOT NULL LIMIT 1)"
    ),
)
register(
    "distinct_tag_values",
    lambda spark, d: costs.distinct_tag_values(nc_for(spark, d, tags=True), "Team"),
    sql("SELECT DISTINCT tag_team AS value FROM nc WHERE tag_team IS NOT NULL"),
)
register(
    "distinct_tag_values_unknown_key",
    lambda spark, d: costs.distinct_tag_values(nc_for(spark, d, tags=True), "CostCentre"),
    sql("SELECT DISTINCT tag_team AS value FROM nc WHERE tag_team = 'CostCentre'"),
)
register(
    "resource_search_all",
    lambda spark, d: present(costs.search_resources(nc_for(spark, d), WHOLE, "7")),
    sql(
        f"SELECT resource_id, {r2('sum(amortized_cost)')} AS total FROM nc WHERE contains(resource_id, '7') GROUP BY resource_id"
    ),
)
register(
    "resource_search",
    lambda spark, d: present(costs.search_resources(nc_for(spark, d), WHOLE, " PART-1 ", 200)),
    sql(
        f"""SELECT resource_id, {r2('sum(amortized_cost)')} AS total FROM nc
        WHERE contains(lower(resource_id), lower('PART-1')) GROUP BY resource_id
        ORDER BY total DESC, resource_id LIMIT 200"""
    ),
)


def _months(spark, d):
    span = star_costs(spark, d, part=False, account=False, tags=False).groupBy("charge_category").agg(
        F.min("usage_start").cast("date").alias("first"), F.max("usage_end").cast("date").alias("end")
    )
    months = span.select("charge_category", F.explode(months_overlapping(F.col("first"), F.col("end"))).alias("month"))
    return months


register(
    "billing_months_of_range",
    _months,
    sql(
        """SELECT charge_category, strftime(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi),
        INTERVAL 1 MONTH)), '%Y-%m') AS month
        FROM (SELECT charge_category, min(usage_start) AS lo, max(usage_start) AS hi FROM nc GROUP BY 1)"""
    ),
)
