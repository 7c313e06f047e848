from dataclasses import replace

import pytest
from pyspark.errors import PySparkException

from billweave.model import BadRequest, CostFilter, CostMetric, Dimension, Granularity, TagFilter, TagOp
from billweave.operators import costs, insights
from billweave.operators.series import daily_series

from .billing import lines

AUGUST = CostFilter.between("2026-08-01", "2026-09-01")
JULY = CostFilter.between("2026-07-01", "2026-08-01")

ROWS = [
    dict(day="2026-08-10", service_name="EC2", account_id="1", region="us", resource_id="i-Abc_1", cost=100.0, tags={"Env": "prod", "Team": "a"}),
    dict(day="2026-08-20", service_name="EC2", account_id="2", region="eu", resource_id="i-abcd1", cost=50.0, tags={"Env": "dev"}),
    dict(day="2026-08-31", service_name="S3", account_id="1", region="us", resource_id="bucket%", cost=30.0, tags=None),
    dict(day="2026-09-01", service_name="S3", account_id="1", region="us", resource_id="b", cost=7.0, tags={"Env": None}),
    dict(day="2026-07-31", service_name="EC2", account_id="1", region=None, resource_id=None, cost=90.0, tags={}),
    dict(day="2026-08-05", service_name=None, account_id="1", region="us", resource_id="x", cost=-20.0, charge_category="Credit"),
]


@pytest.fixture(scope="module")
def nc(spark):
    return lines(spark, ROWS).cache()


def total(nc, **fields):
    return costs.summary(nc, replace(AUGUST, **fields)).first().total


def test_summary(nc):
    row = costs.summary(nc, AUGUST).first()
    assert (row.metric, row.currency, row.total, row.row_count, row.source_format) == ("amortized", "USD", 160.0, 4, "focus12")


def test_summary_of_nothing(nc):
    row = costs.summary(nc, CostFilter.between("2020-01-01", "2020-02-01")).first()
    assert (row.currency, row.total, row.row_count, row.source_format) == ("", 0.0, 0, None)
    filtered = costs.summary(nc, replace(AUGUST, services=("nope",))).first()
    assert (filtered.row_count, filtered.source_format) == (0, "focus12")


def test_all_null_costs_are_null_not_an_error(nc):
    listed = replace(AUGUST, metric=CostMetric.LIST)
    assert costs.summary(nc, listed).first().total is None
    assert costs.breakdown(nc, listed, Dimension.ACCOUNT).first().total is None
    assert costs.compare(nc, listed, replace(JULY, metric=CostMetric.LIST)).first().current == 0.0


@pytest.mark.parametrize(
    "fields,expected",
    [
        (dict(accounts=("2",)), 50.0),
        (dict(services=("EC2", "S3")), 180.0),
        (dict(services=("EC2",), regions=("us",)), 100.0),
        (dict(charge_categories=("Credit",)), -20.0),
        (dict(resource_ids=("x", "bucket%")), 10.0),
        (dict(services=("EC2' OR '1'='1",)), 0.0),
        (dict(tags=(TagFilter("Env", TagOp.EQ, ("prod", "dev")),)), 100.0),
        (dict(tags=(TagFilter("Env", TagOp.NE, ("prod",)),)), 60.0),
        (dict(tags=(TagFilter("Team", TagOp.EXISTS),)), 100.0),
        (dict(tags=(TagFilter("Team", TagOp.NOT_EXISTS),)), 60.0),
        (dict(tags=(TagFilter("Env", TagOp.IN, ("prod", "dev")),)), 150.0),
        (dict(tags=(TagFilter("Env", TagOp.IN),)), 160.0),
        (dict(tags=(TagFilter("Env", TagOp.EQ),)), 160.0),
        (dict(tags=(TagFilter("Env", TagOp.EXISTS), TagFilter("Team", TagOp.NOT_EXISTS))), 50.0),
    ],
)
def test_predicates(nc, fields, expected):
    assert total(nc, **fields) == expected


def test_tag_with_null_value_counts_as_absent(nc):
    september = CostFilter.between("2026-09-01", "2026-10-01", tags=[TagFilter("Env", TagOp.EXISTS)])
    assert costs.summary(nc, september).first().row_count == 0
    assert [r.value for r in costs.distinct_tag_values(nc, "Env").collect()] == ["dev", "prod"]
    assert [r.value for r in costs.distinct_tag_keys(nc).collect()] == ["Env", "Team"]
    assert costs.distinct_tag_values(nc, "zzz").count() == 0


def test_timeseries(nc):
    whole = CostFilter.between("2026-07-01", "2026-10-01")
    rows = costs.timeseries(nc, whole).collect()
    assert [(f"{r.period:%Y-%m}", r.total, r.row_count) for r in rows] == [("2026-07", 90.0, 1), ("2026-08", 160.0, 4), ("2026-09", 7.0, 1)]
    daily = costs.timeseries(nc, replace(AUGUST, granularity=Granularity.DAY), Dimension.SERVICE).collect()
    assert [(f"{r.period:%d}", r.group) for r in daily] == [("05", None), ("10", "EC2"), ("20", "EC2"), ("31", "S3")]
    years = costs.timeseries(nc, replace(whole, granularity=Granularity.YEAR)).collect()
    assert [(r.period.year, r.total) for r in years] == [(2026, 257.0)]


def test_breakdown(nc):
    rows = costs.breakdown(nc, AUGUST, Dimension.SERVICE).collect()
    assert [(r.key, r.total) for r in rows] == [("EC2", 150.0), ("S3", 30.0), (None, -20.0)]
    assert len(costs.breakdown(nc, AUGUST, Dimension.SERVICE, 2).collect()) == 2
    with pytest.raises(BadRequest):
        costs.breakdown(nc, AUGUST, Dimension.SERVICE, 0)


def test_lookups_and_search(nc):
    assert [r.value for r in costs.distinct_values(nc, Dimension.REGION).collect()] == ["eu", "us"]
    hits = costs.search_resources(nc, AUGUST, " ABC ").collect()
    assert [(r.resource_id, r.total) for r in hits] == [("i-Abc_1", 100.0), ("i-abcd1", 50.0)]
    assert [r.resource_id for r in costs.search_resources(nc, AUGUST, "c_").collect()] == ["i-Abc_1"]
    assert [r.resource_id for r in costs.search_resources(nc, AUGUST, "%").collect()] == ["bucket%"]
    assert costs.search_resources(nc, AUGUST, "i", 1).count() == 1
    with pytest.raises(BadRequest):
        costs.search_resources(nc, AUGUST, "i", 0)
    with pytest.raises(BadRequest):
        costs.search_resources(nc, AUGUST, "  ")


def test_filter_values_are_remembered_until_the_data_changes(spark, nc):
    values = costs.FilterValues(nc, "one")
    assert values.of(Dimension.ACCOUNT) == ["1", "2"]
    other = lines(spark, [dict(day="2026-08-01", account_id="9", cost=1.0, tags={"K": "v"})])
    values.refresh(other, "one")
    assert values.of(Dimension.ACCOUNT) == ["1", "2"]
    values.refresh(other, "two")
    assert values.of(Dimension.ACCOUNT) == ["9"]
    assert values.tag_keys() == ["K"] and values.tag_values("K") == ["v"]


def test_compare(nc):
    row = costs.compare(nc, AUGUST, JULY).first()
    assert (row.key, row.current, row.previous, row.absolute_change) == (None, 160.0, 90.0, 70.0)
    assert row.percentage_change == pytest.approx(77.7777, abs=1e-3)
    rows = {r.key: r for r in costs.compare(nc, AUGUST, JULY, Dimension.SERVICE).collect()}
    assert (rows["S3"].current, rows["S3"].previous, rows["S3"].percentage_change) == (30.0, 0.0, None)
    assert (rows["EC2"].absolute_change, rows[None].current) == (60.0, -20.0)
    order = [r.key for r in costs.compare(nc, AUGUST, JULY, Dimension.SERVICE).collect()]
    assert order == ["EC2", "S3", None]


def test_compare_sides_have_their_own_filters(nc):
    row = costs.compare(nc, replace(AUGUST, services=("S3",)), replace(JULY, services=("EC2",))).first()
    assert (row.current, row.previous) == (30.0, 90.0)


def test_compare_of_nothing(nc):
    old = CostFilter.between("2019-01-01", "2019-02-01")
    row = costs.compare(nc, old, CostFilter.between("2018-01-01", "2018-02-01")).first()
    assert (row.currency, row.current, row.previous, row.percentage_change) == ("", 0.0, 0.0, None)
    assert costs.compare(nc, old, old, Dimension.SERVICE).count() == 0


MIXED = [
    dict(day="2026-08-10", service_name="EC2", account_id="1", currency="EUR", cost=100.0),
    dict(day="2026-08-11", service_name="S3", account_id="1", currency="USD", cost=200.0),
    dict(day="2026-07-11", service_name="S3", account_id="1", currency="USD", cost=20.0),
]


def test_mixed_currencies_fail(spark):
    nc = lines(spark, MIXED)
    jobs = [
        costs.summary(nc, AUGUST),
        costs.timeseries(nc, AUGUST),
        costs.breakdown(nc, AUGUST, Dimension.SERVICE),
        # The offending rows are not among the ones returned.
        costs.breakdown(nc, AUGUST, Dimension.SERVICE, 1).select("key"),
        costs.compare(nc, AUGUST, JULY),
        costs.compare(nc, replace(AUGUST, services=("EC2",)), JULY, Dimension.SERVICE),
        insights.breakdown_with_other(nc, AUGUST, Dimension.SERVICE),
        insights.credits_split(nc, AUGUST),
        insights.entity_detail(nc, AUGUST, "account", "1"),
        daily_series(nc, AUGUST.start.date(), AUGUST.end.date()),
    ]
    for job in jobs:
        with pytest.raises(Exception, match=r"EUR.*USD"):
            job.collect()


def test_one_currency_per_query_is_enough(spark):
    nc = lines(spark, MIXED)
    assert costs.summary(nc, replace(AUGUST, services=("EC2",))).first().currency == "EUR"
    # An empty side does not conflict with the other one's currency.
    empty = CostFilter.between("2019-01-01", "2019-02-01")
    assert costs.compare(nc, replace(AUGUST, services=("EC2",)), empty).first().currency == "EUR"
    split = costs.summary(nc, AUGUST, on_mixed="split").collect()
    assert {r.currency: r.total for r in split} == {"EUR": 100.0, "USD": 200.0}


def test_missing_currency(spark):
    rows = [dict(day="2026-08-10", account_id="1", currency=None, cost=1.0), dict(day="2026-08-10", account_id="1", cost=2.0)]
    nc = lines(spark, rows)
    with pytest.raises(PySparkException, match="no currency"):
        costs.summary(nc, AUGUST).collect()
    # The daily series does not count a missing currency as a second one.
    assert daily_series(nc, AUGUST.start.date(), AUGUST.end.date()).where("scope_kind = 'account'").first().cost == 3.0


def test_daily_series(spark):
    rows = [
        dict(day="2026-08-10", service_name=None, account_id="1", cost=5.0),
        dict(day="2026-08-10", service_name="(none)", account_id="1", cost=6.0),
        dict(day="2026-08-10T13:00:00", service_name="EC2", account_id=None, cost=7.0, charge_category="Discount"),
        dict(day="2026-08-10", service_name="EC2", account_id="1", cost=100.0, charge_category="Tax"),
        dict(day="2026-08-11", service_name="EC2", account_id="1", amortized_cost=None),
        dict(day="2026-08-12", service_name="EC2", account_id="1", cost=9.0),
    ]
    got = daily_series(lines(spark, rows), AUGUST.start.date(), at_day(12)).collect()
    found = {(r.scope_kind, r.scope_key, r.day.day): r.cost for r in got}
    assert found == {
        ("service", "(none)", 10): 11.0,
        ("service", "EC2", 10): 7.0,
        ("service", "EC2", 11): 0.0,
        ("account", "1", 10): 11.0,
        ("account", "(none)", 10): 7.0,
        ("account", "1", 11): 0.0,
    }


def at_day(day):
    from datetime import date

    return date(2026, 8, day)
