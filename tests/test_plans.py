"""What the plans must look like for the jobs to hold at scale."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from billweave.model import CostFilter, Dimension, TagFilter, TagOp
from billweave.operators import costs, insights
from billweave.operators.series import daily_series
from billweave.sources.exports import load_source

from .billing import focus_raw, write_month

AUGUST = CostFilter.between("2026-08-01", "2026-09-01")
JULY = CostFilter.between("2026-07-01", "2026-08-01")


@pytest.fixture(scope="module")
def nc(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("plans")
    for month in ("2026-07", "2026-08"):
        rows = [dict(day=f"{month}-{d:02}", service_name=f"s{d % 5}", account_id="1", resource_id=f"r{d}", region="us", cost=float(d), tags={"k": "v"}) for d in range(1, 28)]
        write_month(focus_raw(spark, rows), base, month)
    return load_source(spark, str(base))


def executed(df):
    """The plan that ran, without the initial plans it was made from."""
    df.collect()
    out, skip = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        column = len(line) - len(line.lstrip(" :|+-*"))
        if skip is not None and (not line.strip() or column >= skip):
            continue
        skip = column if "== Initial Plan ==" in line else None
        if skip is None:
            out.append(line)
    return "\n".join(out)


def scans(plan):
    return [line for line in plan.split("\n") if "FileScan" in line]


def read_columns(scan):
    return set(re.findall(r"(\w+):", scan.split("ReadSchema: ")[1]))


def test_date_range_reaches_the_reader(nc):
    (scan,) = scans(executed(costs.summary(nc, AUGUST)))
    assert "GreaterThanOrEqual(ChargePeriodStart,2026-08-01T00:00)" in scan
    assert "LessThan(ChargePeriodStart,2026-09-01T00:00)" in scan
    assert read_columns(scan) == {"ChargePeriodStart", "EffectiveCost", "BillingCurrency"}


def test_list_filters_reach_the_reader_and_tags_read_one_more_column(nc):
    f = replace(AUGUST, services=("s1",), tags=(TagFilter("k", TagOp.EQ, ("v",)),))
    (scan,) = scans(executed(costs.breakdown(nc, f, Dimension.REGION)))
    assert "EqualTo(ServiceName,s1)" in scan and "IsNotNull(Tags)" in scan
    assert read_columns(scan) == {"ChargePeriodStart", "EffectiveCost", "BillingCurrency", "ServiceName", "RegionName", "Tags"}


def test_both_ranges_of_a_comparison_reach_the_reader(nc):
    (scan,) = scans(executed(costs.compare(nc, AUGUST, JULY, Dimension.SERVICE)))
    assert "PushedFilters: [Or(And(" in scan


SINGLE_SCAN = {
    "summary": lambda nc: costs.summary(nc, AUGUST),
    "timeseries": lambda nc: costs.timeseries(nc, AUGUST, Dimension.SERVICE),
    "breakdown": lambda nc: costs.breakdown(nc, AUGUST, Dimension.RESOURCE),
    "compare": lambda nc: costs.compare(nc, AUGUST, JULY, Dimension.RESOURCE),
    "other": lambda nc: insights.breakdown_with_other(nc, AUGUST, Dimension.RESOURCE),
    "trend": lambda nc: insights.trend_with_other(nc, AUGUST, Dimension.SERVICE, 3),
    "table": lambda nc: insights.comparison_table(nc, AUGUST, JULY, Dimension.RESOURCE, 3),
    "movers": lambda nc: insights.biggest_movers(nc, AUGUST, JULY, Dimension.RESOURCE),
    "credits": lambda nc: insights.credits_split(nc, AUGUST),
    "entity": lambda nc: insights.entity_detail(nc, AUGUST, "account", "1"),
    "years": lambda nc: insights.year_boundaries(nc, AUGUST),
    "series": lambda nc: daily_series(nc, AUGUST.start.date(), AUGUST.end.date()),
}


@pytest.mark.parametrize("name", SINGLE_SCAN)
def test_one_scan_hash_aggregates_and_no_cross_join(nc, name):
    """The currency check and every branch of a report read one exchange of partial sums."""
    plan = executed(SINGLE_SCAN[name](nc))
    assert len(scans(plan)) == 1, plan
    assert "SortAggregate" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


LIMITED = {
    "breakdown": lambda nc: costs.breakdown(nc, AUGUST, Dimension.RESOURCE, 10),
    "compare": lambda nc: costs.compare(nc, AUGUST, JULY, Dimension.RESOURCE, limit=10),
    "movers": SINGLE_SCAN["movers"],
}


@pytest.mark.parametrize("name", LIMITED)
def test_top_rows_are_taken_without_a_global_sort(nc, name):
    assert "TakeOrderedAndProject" in executed(LIMITED[name](nc))


def test_entity_sections_are_limited_before_the_shuffle(nc):
    assert "WindowGroupLimit" in executed(SINGLE_SCAN["entity"](nc))


def test_source_filter_prunes_the_other_sources(spark, nc):
    from billweave.sources.normalise import union_sources

    both = union_sources({"a": nc, "b": nc}).where(F.col("source_id") == "a")
    assert len(scans(executed(costs.breakdown(both, AUGUST, Dimension.SERVICE)))) == 1
