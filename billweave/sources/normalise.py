"""Normalisers: a raw export frame in one of three layouts -> the canonical cost table.

Pure projections, so a query on the result still prunes columns and pushes its range filter into the
Parquet scan. A column that an export leaves out reads as a typed NULL.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.model import CANONICAL_COLUMNS, CANONICAL_TYPES


class UnsupportedExport(ValueError):
    """The columns belong to none of the known export layouts."""


# Canonical column <- FOCUS 1.2 column.
FOCUS_1_2_COLUMNS = {
    "billing_period_start": "BillingPeriodStart",
    "billing_period_end": "BillingPeriodEnd",
    "usage_start": "ChargePeriodStart",
    "usage_end": "ChargePeriodEnd",
    "billing_account_id": "BillingAccountId",
    "billing_account_name": "BillingAccountName",
    "account_id": "SubAccountId",
    "account_name": "SubAccountName",
    "provider": "ProviderName",
    "publisher": "PublisherName",
    "service_name": "ServiceName",
    "service_code": "x_ServiceCode",
    "service_category": "ServiceCategory",
    "service_subcategory": "ServiceSubcategory",
    "region": "RegionName",
    "availability_zone": "AvailabilityZone",
    "resource_id": "ResourceId",
    "resource_name": "ResourceName",
    "resource_type": "ResourceType",
    "charge_category": "ChargeCategory",
    "charge_class": "ChargeClass",
    "charge_frequency": "ChargeFrequency",
    "charge_description": "ChargeDescription",
    "pricing_category": "PricingCategory",
    "usage_quantity": "ConsumedQuantity",
    "usage_unit": "ConsumedUnit",
    "billed_cost": "BilledCost",
    "amortized_cost": "EffectiveCost",
    "list_cost": "ListCost",
    "contracted_cost": "ContractedCost",
    "currency": "BillingCurrency",
    "tags": "Tags",
    "commitment_id": "CommitmentDiscountId",
    "commitment_type": "CommitmentDiscountType",
    "commitment_status": "CommitmentDiscountStatus",
}

# Canonical columns a FOCUS 1.0 export does not carry.
NOT_IN_FOCUS_1_0 = [
    "service_code",
    "service_subcategory",
    "availability_zone",
    "resource_name",
    "resource_type",
    "charge_class",
    "charge_description",
    "pricing_category",
    "tags",
    "commitment_id",
    "commitment_type",
    "commitment_status",
]

# Canonical column <- CUR 2.0 column, for the columns that are copied unchanged.
CUR_2_COLUMNS = {
    "billing_period_start": "bill_billing_period_start_date",
    "billing_period_end": "bill_billing_period_end_date",
    "usage_start": "line_item_usage_start_date",
    "usage_end": "line_item_usage_end_date",
    "billing_account_id": "bill_payer_account_id",
    "billing_account_name": "bill_payer_account_name",
    "account_id": "line_item_usage_account_id",
    "account_name": "line_item_usage_account_name",
    "service_name": "product_product_name",
    "service_code": "product_servicecode",
    "region": "product_region_code",
    "availability_zone": "line_item_availability_zone",
    "resource_id": "line_item_resource_id",
    "resource_type": "product_instance_type",
    "charge_description": "line_item_line_item_description",
    "usage_quantity": "line_item_usage_amount",
    "usage_unit": "pricing_unit",
    "currency": "line_item_currency_code",
    "tags": "resource_tags",
    "commitment_id": "reservation_arn",
}

# CUR 2.0 line item type -> charge category; any other type is "Other".
CHARGE_CATEGORY_OF_LINE_ITEM = {
    "Usage": ["Usage", "DiscountedUsage", "SavingsPlanCoveredUsage"],
    "Tax": ["Tax"],
    "Credit": ["Credit"],
    "Refund": ["Refund"],
    "Purchase": ["Fee", "RIFee", "SavingsPlanRecurringFee", "SavingsPlanUpfrontFee"],
    "Adjustment": ["SavingsPlanNegation"],
    "Discount": ["EdpDiscount", "BundledDiscount", "PrivateRateDiscount", "DistributorDiscount"],
}

# Columns that identify each layout.
FOCUS_MARKERS = {"BilledCost", "EffectiveCost", "ChargePeriodStart", "SubAccountId"}
FOCUS_1_2_MARKER = "ServiceSubcategory"
CUR_2_MARKERS = {"bill_payer_account_id", "line_item_usage_start_date"}

FOCUS_1_2, FOCUS_1_0, CUR_2 = "focus12", "focus10", "cur2"


def detect_format(columns: Iterable[str]) -> str:
    names = set(columns)
    if names >= FOCUS_MARKERS:
        return FOCUS_1_2 if FOCUS_1_2_MARKER in names else FOCUS_1_0
    if names >= CUR_2_MARKERS:
        return CUR_2
    raise UnsupportedExport(f"unknown export layout with columns {sorted(names)}")


def normalise(raw: DataFrame, export_format: str | None = None, source_file: Column | None = None) -> DataFrame:
    """The canonical frame of one raw export; the layout is detected unless given."""
    export_format = export_format or detect_format(raw.columns)
    build = {FOCUS_1_2: focus_1_2, FOCUS_1_0: focus_1_0, CUR_2: cur_2}[export_format]
    return build(raw, F.input_file_name() if source_file is None else source_file)


def focus_1_2(raw: DataFrame, source_file: Column) -> DataFrame:
    return _project(raw, FOCUS_1_2_COLUMNS, {}, FOCUS_1_2, source_file)


def focus_1_0(raw: DataFrame, source_file: Column) -> DataFrame:
    columns = {k: v for k, v in FOCUS_1_2_COLUMNS.items() if k not in NOT_IN_FOCUS_1_0}
    return _project(raw, columns, {}, FOCUS_1_0, source_file)


def cur_2(raw: DataFrame, source_file: Column) -> DataFrame:
    present = set(raw.columns)
    arn = _read(present, "reservation_arn", "string")
    computed = {
        "provider": F.lit("AWS"),
        "publisher": F.lit("Amazon"),
        "charge_category": cur_charge_category(_read(present, "line_item_line_item_type", "string")),
        "billed_cost": cur_billed_cost(present),
        "amortized_cost": cur_amortized_cost(present),
        "commitment_type": F.when(arn.isNotNull(), "Reservation"),
    }
    return _project(raw, CUR_2_COLUMNS, computed, CUR_2, source_file)


def cur_charge_category(line_item_type: Column) -> Column:
    labels = [F.when(line_item_type.isin(types), F.lit(name)) for name, types in CHARGE_CATEGORY_OF_LINE_ITEM.items()]
    return F.coalesce(*labels, F.lit("Other"))


def cur_billed_cost(present: set[str]) -> Column:
    net = _read(present, "line_item_net_unblended_cost", "double")
    return F.coalesce(net, _money(present, "line_item_unblended_cost"))


def cur_amortized_cost(present: set[str]) -> Column:
    """Commitment fees spread over the usage they pay for; every missing operand is 0."""
    kind = _read(present, "line_item_line_item_type", "string")
    reserved_fee = (kind == "Fee") & _read(present, "reservation_arn", "string").isNotNull()
    unused_commitment = _money(present, "savings_plan_total_commitment_to_date") - _money(present, "savings_plan_used_commitment")
    unused_reservation = _money(present, "reservation_unused_amortized_upfront_fee_for_billing_period") + _money(
        present, "reservation_unused_recurring_fee"
    )
    return (
        F.when(kind == "SavingsPlanCoveredUsage", _money(present, "savings_plan_savings_plan_effective_cost"))
        .when(kind == "SavingsPlanRecurringFee", unused_commitment)
        .when(kind == "DiscountedUsage", _money(present, "reservation_effective_cost"))
        .when(kind == "RIFee", unused_reservation)
        .when(kind.isin("SavingsPlanNegation", "SavingsPlanUpfrontFee") | reserved_fee, F.lit(0.0))
        .otherwise(_money(present, "line_item_unblended_cost"))
    )


def _read(present: set[str], name: str | None, type_name: str) -> Column:
    """A column of the export, or a typed NULL when the export does not have it."""
    return F.col(name).cast(type_name) if name in present else F.lit(None).cast(type_name)


def _money(present: set[str], name: str) -> Column:
    return F.coalesce(_read(present, name, "double"), F.lit(0.0))


def _project(
    raw: DataFrame, copied: dict[str, str], computed: dict[str, Column], export_format: str, source_file: Column
) -> DataFrame:
    known = {**computed, "source_format": F.lit(export_format), "source_file": source_file}
    present, out = set(raw.columns), []
    for name, kind in CANONICAL_TYPES.items():
        column = known[name] if name in known else _read(present, copied.get(name), kind)
        out.append(column.alias(name))
    return raw.select(*out)


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources in one frame with a ``source_id`` column; a literal, so a filter on it prunes."""
    frames = [nc.select(F.lit(name).alias("source_id"), *CANONICAL_COLUMNS) for name, nc in sources.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def pick_source(sources: dict[str, DataFrame], source_id: str | None = None) -> DataFrame:
    """One source by id; the first configured one by default."""
    if not sources:
        raise KeyError("no source configured")
    if source_id is None:
        return next(iter(sources.values()))
    if source_id not in sources:
        raise KeyError(f"unknown source '{source_id}'")
    return sources[source_id]
