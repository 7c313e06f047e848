"""Billing-shaped views of the given star-schema tables, for the registered queries.

Each line item becomes one billing line. Costs have two decimals, so rounded sums agree between
engines. Only the joins a query needs are added: the foreign keys are complete, so leaving a join out
changes no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.session import use_utc
from billweave.sources.normalise import FOCUS_1_2_COLUMNS, NOT_IN_FOCUS_1_0, cur_2, focus_1_0, focus_1_2

# The line item types a row's key picks from.
LINE_ITEM_TYPES = [
    "Usage",
    "DiscountedUsage",
    "SavingsPlanCoveredUsage",
    "Tax",
    "Credit",
    "Refund",
    "Fee",
    "RIFee",
    "SavingsPlanRecurringFee",
    "SavingsPlanUpfrontFee",
    "SavingsPlanNegation",
    "EdpDiscount",
    "BundledDiscount",
    "PrivateRateDiscount",
    "DistributorDiscount",
    "Mystery",
]
REDUCTIONS = [
    "Credit",
    "Refund",
    "SavingsPlanNegation",
    "EdpDiscount",
    "BundledDiscount",
    "PrivateRateDiscount",
    "DistributorDiscount",
]
FIRST_DAY, END_DAY = "1995-01-01", "2002-01-01"


# Given schemas save a footer-reading job per table.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def cur_export(
    spark: SparkSession,
    sf_dir: str,
    part: bool = True,
    account: bool = True,
    tags: bool = True,
    two_currencies: bool = False,
    by_month: bool = False,
) -> DataFrame:
    """Line items as a CUR 2.0 export. ``by_month`` deals them out by billing month, as a delivery has them:
    before its columns are made, most of which follow from a few."""
    rows = table(spark, sf_dir, "lineitem")

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return rows.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))

    if account or tags:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        of_order, of_customer = F.col("l_orderkey") == F.col("o_orderkey"), F.col("o_custkey") == F.col("c_custkey")
        # A delivery moves all lines: orders, fewer than these, take their customers first.
        if by_month:
            rows = rows.join(orders.join(customer, of_customer), of_order)
        else:
            rows = rows.join(orders, of_order).join(customer, of_customer)
        if account and not by_month:
            rows = placed(rows)
    # Of the order's key only this is needed any further.
    rows = rows.withColumn("number", ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 16).cast("int"))
    if part:
        rows = rows.join(
            table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"),
            F.col("l_partkey") == F.col("p_partkey"),
        )
    month = F.date_trunc("month", "l_shipdate").cast("timestamp_ntz")
    if by_month:
        rows, month = rows.withColumn("month", month).hint("rebalance", "month"), F.col("month")
        if account:  # names of the few places are not moved with the lines
            rows = placed(rows)
    types = F.array(*map(F.lit, LINE_ITEM_TYPES))
    rows = rows.withColumn("kind", F.get(types, F.col("number")))
    quantity, price, flag = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_returnflag")
    unblended = F.when(F.col("kind").isin(REDUCTIONS), quantity * -3).otherwise(price)
    out = {
        "bill_billing_period_start_date": month,
        "bill_billing_period_end_date": month + F.expr("interval 1 month"),
        "line_item_usage_start_date": F.col("l_shipdate"),
        "line_item_usage_end_date": F.col("l_shipdate") + F.expr("interval 1 day"),
        "line_item_resource_id": F.concat(F.lit("part-"), F.col("l_partkey")),
        "line_item_line_item_type": F.col("kind"),
        "line_item_usage_amount": quantity,
        "pricing_unit": F.lit("Hrs"),
        "line_item_currency_code": F.lit("USD"),
        "line_item_net_unblended_cost": F.when(F.col("l_linestatus") == "O", unblended - quantity),
        "line_item_unblended_cost": unblended,
        "savings_plan_savings_plan_effective_cost": F.when(flag != "R", quantity * 20),
        "savings_plan_total_commitment_to_date": price,
        "savings_plan_used_commitment": F.when(flag != "A", quantity * 10),
        "reservation_effective_cost": quantity * 15,
        "reservation_unused_amortized_upfront_fee_for_billing_period": quantity / 4,
        "reservation_unused_recurring_fee": F.when(flag != "N", quantity / 2),
        "reservation_arn": F.when(F.col("l_linenumber") >= 4, F.concat(F.lit("arn:ri/"), F.col("l_suppkey"))),
    }
    if account:
        out |= {
            "bill_payer_account_id": F.col("r_name"),
            "bill_payer_account_name": F.concat(F.lit("Payer "), F.col("r_name")),
            "line_item_usage_account_id": F.col("n_name"),
            "line_item_usage_account_name": F.concat(F.lit("Account "), F.col("n_name")),
            "product_region_code": F.col("r_name"),
            "line_item_availability_zone": F.concat_ws("-", "r_name", F.col("n_nationkey")),
        }
        if two_currencies:
            out["line_item_currency_code"] = F.when(F.col("n_regionkey") == 3, "EUR").otherwise("USD")
    if part:
        out |= {
            "product_product_name": F.when(F.col("p_type") != "PROMO", F.col("p_type")),
            "product_servicecode": F.col("p_brand"),
            "line_item_line_item_description": F.col("p_name"),
        }
    if tags:
        out["product_instance_type"] = F.col("o_orderpriority")
        tag_map = F.create_map(
            F.lit("Segment"),
            F.col("c_mktsegment"),
            F.lit("Priority"),
            F.col("o_orderpriority"),
            F.lit("Team"),
            F.when(F.col("l_linestatus") == "O", F.concat(F.lit("team-"), F.col("l_linenumber"))),
        )
        out["resource_tags"] = F.when((flag != "N") | (F.col("l_linestatus") != "F"), tag_map)
    return rows.select(*[column.alias(name) for name, column in out.items()])


def costs(spark: SparkSession, sf_dir: str, **needs: bool) -> DataFrame:
    """The canonical table of the CUR 2.0 export."""
    return cur_2(cur_export(spark, sf_dir, **needs), F.lit("lineitem.parquet"))


def focus_export(spark: SparkSession, sf_dir: str, version: str = "1.2", **needs: bool) -> DataFrame:
    """The same charges as a FOCUS export; list and contracted prices sit above the billed cost."""
    nc = costs(spark, sf_dir, **needs)
    priced = {
        "list_cost": F.col("billed_cost") + F.col("usage_quantity") * 2,
        "contracted_cost": F.col("billed_cost") + F.col("usage_quantity"),
        "pricing_category": F.col("resource_type"),
        "charge_frequency": F.when(F.col("charge_category") == "Usage", "Usage-Based").otherwise("One-Time"),
        "service_category": F.lit("Compute"),
        "service_subcategory": F.col("service_code"),
    }
    columns = {k: v for k, v in FOCUS_1_2_COLUMNS.items() if version == "1.2" or k not in NOT_IN_FOCUS_1_0}
    return nc.select(*[priced.get(k, F.col(k)).alias(v) for k, v in columns.items()])


def focus_costs(spark: SparkSession, sf_dir: str, version: str = "1.2", **needs: bool) -> DataFrame:
    raw = focus_export(spark, sf_dir, version, **needs)
    build = focus_1_2 if version == "1.2" else focus_1_0
    return build(raw, F.lit("lineitem.parquet"))


def nudge(digits: int) -> float:
    """Added before rounding, so that exact halves such as 0.125 round alike in both engines."""
    return 1.2345678e-3 * 10.0**-digits


def present(df: DataFrame, digits: int = 2) -> DataFrame:
    """Comparable results: rounded doubles, dates and timestamps as text."""
    out = []
    for field in df.schema:
        column, kind = F.col(f"`{field.name}`"), field.dataType.simpleString()
        if kind == "double":
            wide = any(w in field.name for w in ("percentage", "share", "factor", "usd"))
            places = max(digits, 4) if wide else digits
            column = F.round(column + F.lit(nudge(places)), places) + F.lit(0.0)
        elif kind == "date":
            column = F.date_format(column, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        out.append(column.alias(field.name))
    return df.select(*out)


# --- the same views as SQL, for the side-by-side check -------------------------------------------

_TYPES_SQL = ", ".join(f"'{t}'" for t in LINE_ITEM_TYPES)
_REDUCTIONS_SQL = ", ".join(f"'{t}'" for t in REDUCTIONS)

COSTS_CTE = f"""
lines AS (
  SELECT *,
    list_extract([{_TYPES_SQL}], CAST((l_orderkey * 7 + l_linenumber) % 16 AS INTEGER) + 1) AS kind
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
),
priced AS (
  SELECT *, CASE WHEN kind IN ({_REDUCTIONS_SQL}) THEN l_quantity * -3 ELSE l_extendedprice END AS unblended,
    CASE WHEN l_linenumber >= 4 THEN 'arn:ri/' || l_suppkey END AS arn
  FROM lines
),
nc AS (
  SELECT
    date_trunc('month', l_shipdate) AS billing_period_start,
    l_shipdate AS usage_start,
    r_name AS billing_account_id,
    n_name AS account_id,
    CASE WHEN p_type <> 'PROMO' THEN p_type END AS service_name,
    p_brand AS service_code,
    r_name AS region,
    r_name || '-' || n_nationkey AS availability_zone,
    'part-' || l_partkey AS resource_id,
    o_orderpriority AS resource_type,
    o_orderpriority AS pricing_category,
    kind,
    CASE
      WHEN kind IN ('Usage', 'DiscountedUsage', 'SavingsPlanCoveredUsage') THEN 'Usage'
      WHEN kind IN ('Tax', 'Credit', 'Refund') THEN kind
      WHEN kind IN ('Fee', 'RIFee', 'SavingsPlanRecurringFee', 'SavingsPlanUpfrontFee') THEN 'Purchase'
      WHEN kind = 'SavingsPlanNegation' THEN 'Adjustment'
      WHEN kind LIKE '%Discount' THEN 'Discount'
      ELSE 'Other'
    END AS charge_category,
    l_quantity AS usage_quantity,
    CASE WHEN l_linestatus = 'O' THEN unblended - l_quantity ELSE unblended END AS billed_cost,
    CASE kind
      WHEN 'SavingsPlanCoveredUsage' THEN CASE WHEN l_returnflag <> 'R' THEN l_quantity * 20 ELSE 0 END
      WHEN 'SavingsPlanRecurringFee' THEN
        l_extendedprice - CASE WHEN l_returnflag <> 'A' THEN l_quantity * 10 ELSE 0 END
      WHEN 'SavingsPlanNegation' THEN 0
      WHEN 'SavingsPlanUpfrontFee' THEN 0
      WHEN 'DiscountedUsage' THEN l_quantity * 15
      WHEN 'RIFee' THEN l_quantity / 4 + CASE WHEN l_returnflag <> 'N' THEN l_quantity / 2 ELSE 0 END
      WHEN 'Fee' THEN CASE WHEN arn IS NULL THEN unblended ELSE 0 END
      ELSE unblended
    END AS amortized_cost,
    'USD' AS currency,
    CASE WHEN n_regionkey = 3 THEN 'EUR' ELSE 'USD' END AS two_currencies,
    CASE WHEN l_returnflag <> 'N' OR l_linestatus <> 'F' THEN c_mktsegment END AS tag_segment,
    CASE WHEN l_returnflag <> 'N' OR l_linestatus <> 'F' THEN o_orderpriority END AS tag_priority,
    CASE WHEN l_linestatus = 'O' THEN 'team-' || l_linenumber END AS tag_team,
    arn AS commitment_id,
    CASE WHEN arn IS NOT NULL THEN 'Reservation' END AS commitment_type
  FROM priced
)
"""


def sql(body: str, *ctes: str) -> str:
    """A query on ``nc``, the canonical table, with optional further CTEs."""
    return "WITH " + ",\n".join([COSTS_CTE.strip(), *ctes]) + "\n" + body


def r2(expression: str, digits: int = 2) -> str:
    return f"(round({expression} + {nudge(digits)!r}, {digits}) + 0.0)"
