"""Date arithmetic on query parameters: ranges, presets, granularity, months."""

from __future__ import annotations

import calendar
from datetime import date, timedelta
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from billweave.model import CostFilter, Granularity


class Preset(Enum):
    MTD = "mtd"
    LAST_MONTH = "last-month"
    DAYS_30 = "30d"
    MONTHS_3 = "3m"
    MONTHS_6 = "6m"
    MONTHS_12 = "12m"
    YTD = "ytd"
    LAST_YEAR = "last-year"


def month_start(day: date, back: int = 0) -> date:
    """First day of the month ``back`` months before the month of ``day``."""
    months = day.year * 12 + day.month - 1 - back
    return date(months // 12, months % 12 + 1, 1)


def preset_range(preset: Preset, today: date) -> tuple[date, date]:
    """Inclusive first and last day of a relative range."""
    if preset is Preset.LAST_MONTH:
        return month_start(today, 1), month_start(today) - timedelta(days=1)
    if preset is Preset.LAST_YEAR:
        return date(today.year - 1, 1, 1), date(today.year - 1, 12, 31)
    first = {
        Preset.MTD: month_start(today),
        Preset.DAYS_30: today - timedelta(days=29),
        Preset.MONTHS_3: month_start(today, 2),
        Preset.MONTHS_6: month_start(today, 5),
        Preset.MONTHS_12: month_start(today, 11),
        Preset.YTD: date(today.year, 1, 1),
    }
    return first[preset], today


def matching_presets(first: date, last: date, today: date) -> list[Preset]:
    return [p for p in Preset if preset_range(p, today) == (first, last)]


def previous_period(current: CostFilter) -> CostFilter:
    """The same-length window that ends where ``current`` starts."""
    return current.with_range(current.start - (current.end - current.start), current.start)


def auto_granularity(days: int) -> Granularity:
    if days <= 90:
        return Granularity.DAY
    return Granularity.MONTH if days <= 366 * 3 else Granularity.YEAR


def days_in_month(day: date) -> int:
    return calendar.monthrange(day.year, day.month)[1]


def months_overlapping(start: Column, end_exclusive: Column) -> Column:
    """Array of ``yyyy-MM`` for the calendar months that ``[start, end)`` touches."""
    last = F.date_sub(end_exclusive, 1)
    months = F.sequence(F.trunc(start, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
    none = F.array().cast("array<string>")
    return F.when(start < end_exclusive, F.transform(months, lambda m: F.date_format(m, "yyyy-MM"))).otherwise(none)


def month_range(start: date, end_exclusive: date) -> list[str]:
    """The same for parameters: the months a discovery call should look at."""
    months, month = [], month_start(start)
    while month < end_exclusive and start < end_exclusive:
        months.append(f"{month:%Y-%m}")
        month = month_start(month, -1)
    return months


def discovery_window(today: date, years: int = 5) -> tuple[date, date]:
    """Months looked at by default: from this month ``years`` ago to the end of next month."""
    return date(today.year - years, today.month, 1), month_start(today, -2)
