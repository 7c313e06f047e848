from datetime import date

import pytest

from billweave.functions import periods as p
from billweave.model import (
    BadRequest,
    CostFilter,
    CostMetric,
    Dimension,
    Granularity,
    TagFilter,
    TagOp,
    check_limit,
    merge_page_filter,
    request_filter,
)


def test_defaults_and_parsing():
    f = request_filter("2026-08-01", "2026-09-01")
    assert (f.metric, f.granularity) == (CostMetric.AMORTIZED, Granularity.MONTH)
    assert request_filter("2026-08-01", "2026-09-01", metric="BILLED").metric is CostMetric.BILLED
    assert Granularity.parse("Day") is Granularity.DAY
    assert Dimension.parse("availability_zone").column == "availability_zone"
    assert Dimension.SERVICE.column == "service_name"
    for parse, text in ((CostMetric.parse, "x"), (Granularity.parse, "hour"), (Dimension.parse, "Service"), (Dimension.parse, None)):
        with pytest.raises(BadRequest):
            parse(text)


@pytest.mark.parametrize(
    "start,end,fields",
    [
        ("2026-08-01", "2026-08-01", {}),
        ("2026-09-01", "2026-08-01", {}),
        ("2020-01-01", "2026-01-01", {}),
        ("2026-08-01", "2026-09-01", {"accounts": ["x"] * 1001}),
        ("2026-08-01", "2026-09-01", {"colours": ["x"]}),
        ("2026-08-01", "2026-09-01", {"tags": [{"key": "k", "operator": "like", "values": []}]}),
    ],
)
def test_bad_requests(start, end, fields):
    with pytest.raises(BadRequest):
        request_filter(start, end, **fields)


def test_request_limits():
    assert request_filter("2021-01-01", "2026-01-01", accounts=["x"] * 1000)
    assert check_limit(10_000_000) == 10_000_000
    for limit in (0, -1):
        with pytest.raises(BadRequest):
            check_limit(limit)


def test_page_filter_fills_only_empty_fields():
    page = CostFilter.between("2026-01-01", "2026-02-01", services=["a"], accounts=["1"])
    own = CostFilter.between("2026-03-01", "2026-04-01", services=["b"], tags=[TagFilter("k", TagOp.EXISTS)])
    merged = merge_page_filter(own, page)
    assert merged.services == ("b",) and merged.accounts == ("1",)
    assert merged.start == own.start and merged.tags == own.tags


def test_presets():
    def starts(today):
        """First days by preset, where the range ends today."""
        ranges = {x: p.preset_range(x, today) for x in p.Preset}
        assert all(last == today for x, (_, last) in ranges.items() if x not in (p.Preset.LAST_MONTH, p.Preset.LAST_YEAR))
        return [f"{ranges[x][0]:%y-%m-%d}" for x in p.Preset]

    leap_day, january = date(2024, 2, 29), date(2025, 1, 7)
    assert starts(leap_day) == ["24-02-01", "24-01-01", "24-01-31", "23-12-01", "23-09-01", "23-03-01", "24-01-01", "23-01-01"]
    assert starts(january) == ["25-01-01", "24-12-01", "24-12-09", "24-11-01", "24-08-01", "24-02-01", "25-01-01", "24-01-01"]
    assert p.preset_range(p.Preset.LAST_MONTH, january)[1] == date(2024, 12, 31)
    assert p.preset_range(p.Preset.LAST_MONTH, date(2023, 3, 31))[1] == date(2023, 2, 28)
    assert p.preset_range(p.Preset.LAST_YEAR, leap_day)[1] == date(2023, 12, 31)
    assert p.matching_presets(date(2025, 1, 1), january, january) == [p.Preset.MTD, p.Preset.YTD]
    assert p.matching_presets(date(2025, 1, 2), january, january) == []


def test_periods():
    f = CostFilter.between("2026-08-01", "2026-09-01")
    before = p.previous_period(f)
    assert (before.start, before.end) == (CostFilter.between("2026-07-01", "2026-08-01").start, f.start)
    assert [p.auto_granularity(n).value for n in (90, 91, 1098, 1099)] == ["day", "month", "month", "year"]
    assert p.month_range(date(2025, 12, 15), date(2026, 2, 1)) == ["2025-12", "2026-01"]
    assert p.month_range(date(2026, 2, 1), date(2026, 2, 1)) == []
    assert p.discovery_window(date(2026, 12, 5)) == (date(2021, 12, 1), date(2027, 2, 1))
