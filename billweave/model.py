"""Data model: the canonical cost schema, the closed enums and the query parameter object.

Users never pass raw column names: every metric, dimension and predicate field is a member of a
closed set that maps to one canonical column.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from datetime import date, datetime
from enum import Enum

from pyspark.sql import types as T

_STR, _DBL, _NTZ = T.StringType(), T.DoubleType(), T.TimestampNTZType()
TAG_MAP = T.MapType(T.StringType(), T.StringType())

# The canonical columns, in order.
CANONICAL_SCHEMA = T.StructType(
    [
        T.StructField("billing_period_start", _NTZ),
        T.StructField("billing_period_end", _NTZ),
        T.StructField("usage_start", _NTZ),
        T.StructField("usage_end", _NTZ),
        T.StructField("billing_account_id", _STR),
        T.StructField("billing_account_name", _STR),
        T.StructField("account_id", _STR),
        T.StructField("account_name", _STR),
        T.StructField("provider", _STR),
        T.StructField("publisher", _STR),
        T.StructField("service_name", _STR),
        T.StructField("service_code", _STR),
        T.StructField("service_category", _STR),
        T.StructField("service_subcategory", _STR),
        T.StructField("region", _STR),
        T.StructField("availability_zone", _STR),
        T.StructField("resource_id", _STR),
        T.StructField("resource_name", _STR),
        T.StructField("resource_type", _STR),
        T.StructField("charge_category", _STR),
        T.StructField("charge_class", _STR),
        T.StructField("charge_frequency", _STR),
        T.StructField("charge_description", _STR),
        T.StructField("pricing_category", _STR),
        T.StructField("usage_quantity", _DBL),
        T.StructField("usage_unit", _STR),
        T.StructField("billed_cost", _DBL),
        T.StructField("amortized_cost", _DBL),
        T.StructField("list_cost", _DBL),
        T.StructField("contracted_cost", _DBL),
        T.StructField("currency", _STR),
        T.StructField("tags", TAG_MAP),
        T.StructField("commitment_id", _STR),
        T.StructField("commitment_type", _STR),
        T.StructField("commitment_status", _STR),
        T.StructField("source_format", _STR),
        T.StructField("source_file", _STR),
    ]
)
CANONICAL_COLUMNS = CANONICAL_SCHEMA.fieldNames()
CANONICAL_TYPES = {f.name: f.dataType.simpleString() for f in CANONICAL_SCHEMA}

# What a request may ask for. Results are never cut short: a limit is the caller's.
MAX_RANGE_DAYS = 5 * 366
MAX_PREDICATE_VALUES = 1000

NONE_LABEL = "(none)"
OTHER_LABEL = "Other"


class BadRequest(ValueError):
    """A query parameter is outside the allowed set or range."""


class CostMetric(Enum):
    AMORTIZED = "amortized"
    BILLED = "billed"
    LIST = "list"
    CONTRACTED = "contracted"

    @property
    def column(self) -> str:
        return f"{self.value}_cost"

    @classmethod
    def parse(cls, text: str | None) -> CostMetric:
        """Any letter case; amortized when absent."""
        return _parse_enum(cls, text.lower() if text else None, cls.AMORTIZED, "metric")


class Granularity(Enum):
    DAY = "day"
    MONTH = "month"
    YEAR = "year"

    @classmethod
    def parse(cls, text: str | None) -> Granularity:
        """Any letter case; month when absent."""
        return _parse_enum(cls, text.lower() if text else None, cls.MONTH, "granularity")


class Dimension(Enum):
    SERVICE = "service"
    ACCOUNT = "account"
    REGION = "region"
    AVAILABILITY_ZONE = "availability_zone"
    CHARGE_CATEGORY = "charge_category"
    PRICING_CATEGORY = "pricing_category"
    RESOURCE = "resource"

    @property
    def column(self) -> str:
        renamed = {"service": "service_name", "account": "account_id", "resource": "resource_id"}
        return renamed.get(self.value, self.value)

    @classmethod
    def parse(cls, text: str) -> Dimension:
        """Exact spelling only."""
        return _parse_enum(cls, text, None, "dimension")


class TagOp(Enum):
    EQ = "eq"
    NE = "ne"
    EXISTS = "exists"
    NOT_EXISTS = "not_exists"
    IN = "in"


def _parse_enum(kind, text, default, what):
    if text is None:
        if default is None:
            raise BadRequest(f"{what} is required")
        return default
    try:
        return kind(text)
    except ValueError:
        raise BadRequest(f"unknown {what} '{text}'") from None


@dataclass(frozen=True)
class TagFilter:
    key: str
    op: TagOp
    values: tuple[str, ...] = ()


# Predicate list fields and the canonical column each one tests.
LIST_FIELDS = {
    "accounts": "account_id",
    "services": "service_name",
    "regions": "region",
    "charge_categories": "charge_category",
    "resource_ids": "resource_id",
}


@dataclass(frozen=True)
class CostFilter:
    """What a cost query reads: a half-open UTC range on ``usage_start`` plus predicates.

    An empty list means "no filter on this field".
    """

    start: datetime
    end: datetime
    metric: CostMetric = CostMetric.AMORTIZED
    granularity: Granularity = Granularity.MONTH
    accounts: tuple[str, ...] = ()
    services: tuple[str, ...] = ()
    regions: tuple[str, ...] = ()
    charge_categories: tuple[str, ...] = ()
    resource_ids: tuple[str, ...] = ()
    tags: tuple[TagFilter, ...] = field(default=())

    @classmethod
    def between(cls, start: date | datetime | str, end: date | datetime | str, **fields) -> CostFilter:
        for name in (*LIST_FIELDS, "tags"):
            if name in fields:
                fields[name] = tuple(fields[name])
        return cls(as_datetime(start), as_datetime(end), **fields)

    @property
    def has_predicates(self) -> bool:
        return bool(self.tags) or any(getattr(self, name) for name in LIST_FIELDS)

    def with_range(self, start, end) -> CostFilter:
        return replace(self, start=as_datetime(start), end=as_datetime(end))


def as_datetime(value: date | datetime | str) -> datetime:
    if isinstance(value, str):
        return datetime.fromisoformat(value)
    if isinstance(value, datetime):
        return value
    return datetime(value.year, value.month, value.day)


def request_filter(
    start: date | str,
    end: date | str,
    metric: str | None = None,
    granularity: str | None = None,
    tags: Iterable[TagFilter | Mapping] = (),
    **lists: Iterable[str],
) -> CostFilter:
    """A filter from untrusted request values, checked before any plan is built."""
    check_range(start, end)
    unknown = set(lists) - set(LIST_FIELDS)
    if unknown:
        raise BadRequest(f"unknown filter field(s) {sorted(unknown)}")
    tag_filters = tuple(t if isinstance(t, TagFilter) else _tag_from(t) for t in tags)
    for name, values in {**lists, "tags": tag_filters}.items():
        if len(tuple(values)) > MAX_PREDICATE_VALUES:
            raise BadRequest(f"{len(tuple(values))} values for {name}, {MAX_PREDICATE_VALUES} are possible")
    return CostFilter.between(
        start,
        end,
        metric=CostMetric.parse(metric),
        granularity=Granularity.parse(granularity),
        tags=tag_filters,
        **lists,
    )


def check_range(start, end) -> None:
    lo, hi = as_datetime(start), as_datetime(end)
    if lo >= hi:
        raise BadRequest(f"the range from {lo} to {hi} is empty")
    if (hi - lo).days > MAX_RANGE_DAYS:
        raise BadRequest(f"the range is longer than {MAX_RANGE_DAYS} days")


def check_limit(limit: int) -> int:
    if limit < 1:
        raise BadRequest(f"at least one row has to be asked for, not {limit}")
    return limit


def _tag_from(raw: Mapping) -> TagFilter:
    op = _parse_enum(TagOp, raw.get("operator"), None, "tag operator")
    return TagFilter(raw["key"], op, tuple(raw.get("values", ())))


def merge_page_filter(own: CostFilter, page: CostFilter) -> CostFilter:
    """Fill the predicate fields ``own`` leaves empty from ``page``; a field set on ``own`` wins."""
    names = (*LIST_FIELDS, "tags")
    return replace(own, **{n: getattr(own, n) or getattr(page, n) for n in names})
