"""Filters as Column predicates. Values enter as literals, never as SQL text."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from billweave.functions.scalars import ntz
from billweave.model import LIST_FIELDS, CostFilter, TagFilter, TagOp

# The charge categories the anomaly series look at (usage net of negotiated discounts).
DAILY_USAGE_CATEGORIES = ["Usage", "Discount"]


def in_range(f: CostFilter) -> Column:
    """Half-open and on the bare column, so it reaches the Parquet reader."""
    return (F.col("usage_start") >= ntz(f.start)) & (F.col("usage_start") < ntz(f.end))


def matches(f: CostFilter) -> Column:
    """The whole filter: range, then the list fields, then the tag filters, all AND-ed."""
    clauses = [in_range(f)]
    clauses += [F.col(c).isin(list(getattr(f, n))) for n, c in LIST_FIELDS.items() if getattr(f, n)]
    clauses += [clause for clause in map(tag_clause, f.tags) if clause is not None]
    return reduce(and_, clauses)


def tag_clause(t: TagFilter) -> Column | None:
    """None when the filter lists no value to compare with."""
    value = F.col("tags")[t.key]
    if t.op is TagOp.EXISTS:
        return value.isNotNull()
    if t.op is TagOp.NOT_EXISTS:
        return value.isNull()
    if not t.values:
        return None
    if t.op is TagOp.IN:
        return value.isin(list(t.values))
    if t.op is TagOp.EQ:
        return value == t.values[0]
    # A row without the tag is "not equal", so a plain != would lose it.
    return ~value.eqNullSafe(t.values[0])


def contains_text(column: Column, needle: str) -> Column:
    """Case-insensitive; ``%`` and ``_`` in the needle are plain characters."""
    return F.contains(F.lower(column), F.lower(F.lit(needle)))


def daily_usage_only() -> Column:
    return F.col("charge_category").isin(DAILY_USAGE_CATEGORIES)
