"""Spend anomaly detection over every daily series at once.

A day is anomalous when it is unusual against a robust baseline (weekday-adjusted median, MAD
spread) and materially large. A series too sparse for a baseline is compared with its recent past,
and an upward finding that repeats last month's same-day charge is dropped.

Each series becomes one dense array with one slot per calendar day, so the only shuffle is the
gathering of a series' days: a few thousand doubles at most, bounded by the calendar. Every
evaluated day then reads its window as a slice of that array, and the statistics are column
expressions on the slice; nothing is joined or grouped again.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.functions.scalars import median
from billweave.operators.rules import (
    DAYS_PER_MONTH,
    MAD_SCALE,
    MIN_HISTORY_DAYS,
    MIN_PRIOR_TOTAL,
    SPREAD_FLOOR,
    WEEKDAY_FACTOR_RANGE,
    Rules,
    resolve_rules,
)

SERIES_KEYS = ["scope_kind", "scope_key"]
FINDING_COLUMNS = [*SERIES_KEYS, "day", "expected", "actual", "delta", "kind", "direction", "severity"]


def last_settled_day(series: DataFrame, settling_days: int) -> Column:
    """Newest day with data minus the days still being revised, as a scalar subquery."""
    newest = series.agg(F.struct(F.max("day").alias("day"), F.sum("cost").alias("cost")).alias("s"))
    return F.date_sub(newest.scalar().getField("day"), settling_days)


def day_windows(
    series: DataFrame, check_from: date, check_to: date | Column, memory_days: int, by: tuple[str, ...] = ()
) -> DataFrame:
    """One row per series and evaluated day: keys, day, window.

    ``window`` holds the ``memory_days`` days before the day, oldest first, and the day itself last;
    a day without a row is NULL.
    """
    first = F.lit(check_from - timedelta(days=memory_days))
    last = check_to if isinstance(check_to, Column) else F.lit(check_to)
    # A fixed number of partitions: the rows are few but each one is a lot of work, so they must not
    # be coalesced by size.
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_reach = F.when(F.col("day") >= first, F.struct(F.datediff("day", first).alias("at"), "cost"))
    gathered = series.repartition(tasks, *by, *SERIES_KEYS).groupBy(*by, *SERIES_KEYS).agg(
        F.sort_array(F.collect_list(in_reach)).alias("points")
    )
    gathered = gathered.withColumn("last", last)
    n_days = F.datediff("last", first) + 1
    no_cost = F.lit(None).cast("double")

    def with_gap(point, i):
        before = F.when(i > 0, F.get(F.col("points"), i - 1)["at"]).otherwise(F.lit(-1))
        return F.concat(F.array_repeat(no_cost, point["at"] - before - 1), F.array(point["cost"]))

    dense = F.concat(F.flatten(F.transform("points", with_gap)), F.array_repeat(no_cost, F.greatest(n_days, F.lit(0))))
    arrays = gathered.withColumn("daily", dense)
    evaluated = F.when(
        F.col("last") >= F.lit(check_from),
        F.transform(
            F.sequence(F.lit(0), F.datediff("last", F.lit(check_from))),
            lambda i: F.struct(
                F.date_add(F.lit(check_from), i).alias("day"),
                F.slice("daily", i + 1, memory_days + 1).alias("window"),
            ),
        ),
    )
    return arrays.select(*by, *SERIES_KEYS, F.explode(evaluated).alias("w")).select(*by, *SERIES_KEYS, "w.*")


def bound(df: DataFrame, *names: str) -> DataFrame:
    """Fix the values of computed columns. Without it Spark copies their expressions into every
    later filter and evaluates the medians again for each mention."""
    kept = [c for c in df.columns if c not in names]
    return df.select(*kept, F.inline(F.array(F.struct(*names))))


def levels(windows: DataFrame, lookback_days: int, memory_days: int) -> DataFrame:
    """Add what one pass over the window gives.

    costs (the lookback days), actual, history (lookback days with a row), base (their median),
    has_base, factor (of the day's weekday), expected, prior_total, largest and echo (largest cost
    around the same date last month).
    """
    n, zero = lookback_days, F.lit(0.0)
    lookback = F.slice("window", memory_days - n + 1, n)
    prior = F.slice("window", 1, memory_days)
    # Days back to the same date last month, give or take a day; at most 32, inside the window.
    back = F.datediff("day", F.add_months("day", -1))
    first_pass = windows.select(
        *[c for c in windows.columns if c != "window"],
        F.transform(lookback, lambda c: F.coalesce(c, zero)).alias("costs"),
        F.coalesce(F.get("window", F.lit(memory_days)), zero).alias("actual"),
        F.size(F.array_compact(lookback)).alias("history"),
        F.aggregate(prior, zero, lambda a, c: a + F.coalesce(c, zero)).alias("prior_total"),
        F.greatest(F.array_max(prior), zero).alias("largest"),
        F.array_max(F.slice("window", F.lit(memory_days) - back, 3)).alias("echo"),
    )
    first_pass = bound(first_pass, "costs", "actual", "history", "prior_total", "largest", "echo")
    based = bound(first_pass.withColumn("base", median(F.col("costs"), F.lit(n))), "base")
    out = based.withColumn("has_base", (F.col("history") >= MIN_HISTORY_DAYS) & (F.col("base") > 0))
    out = bound(out.withColumn("factor", F.when(F.col("has_base"), weekday_factor(0, n))), "factor")
    return out.withColumn("expected", F.col("base") * F.col("factor"))


def weekday_factor(days_back: int, lookback_days: int) -> Column:
    """Median of the lookback days on one weekday relative to the base, clamped; 1 for none.

    Slot ``j`` of ``costs`` is ``lookback_days - j`` days back; slots whose distance agrees modulo 7
    share a weekday, 0 being the weekday of the evaluated day.
    """
    slots = [j for j in range(lookback_days) if (lookback_days - j) % 7 == days_back]
    if not slots:
        return F.lit(1.0)
    low, high = WEEKDAY_FACTOR_RANGE
    same = F.array(*[F.get("costs", F.lit(j)) for j in slots])
    ratio = F.try_divide(median(same, F.lit(len(slots))), F.col("base"))
    return F.least(F.greatest(ratio, F.lit(low)), F.lit(high))


def with_spread(days: DataFrame, lookback_days: int) -> DataFrame:
    """Add spread: the scaled median deviation from the weekday-adjusted base, with a floor."""
    n = lookback_days
    # One week of factors in slot order, repeated over the lookback.
    week = F.array(*[weekday_factor((n - j) % 7, n) for j in range(7)])
    weeks = F.slice(F.flatten(F.array_repeat(week, -(-n // 7))), 1, n)
    adjusted = bound(days.withColumn("weeks", F.when(F.col("has_base"), weeks)), "weeks")
    off = F.zip_with("costs", "weeks", lambda c, factor: F.abs(c - F.col("base") * factor))
    spread = F.greatest(median(off, F.lit(n)) * MAD_SCALE, F.col("expected") * SPREAD_FLOOR)
    out = adjusted.withColumn("spread", F.when(F.col("has_base"), spread)).drop("costs", "weeks")
    return bound(out, "spread")


def baselines(windows: DataFrame, lookback_days: int, memory_days: int) -> DataFrame:
    """All statistics of each evaluated day."""
    return with_spread(levels(windows, lookback_days, memory_days), lookback_days)


def worth_a_look(days: DataFrame) -> DataFrame:
    """Drop days that cannot be findings, before their spread is computed: the change or the cost is
    below the absolute floor, or below the multiple of the least possible spread."""
    size = F.abs(F.col("actual") - F.col("expected"))
    least = F.col("mad_multiplier") * (F.col("expected") * SPREAD_FLOOR)
    off_baseline = (size >= F.col("min_delta_usd")) & (size >= least)
    return days.where(F.when(F.col("has_base"), off_baseline).otherwise(F.col("actual") >= F.col("min_delta_usd")))


def severity_of(delta: Column) -> Column:
    monthly = F.abs(delta) * DAYS_PER_MONTH
    return (
        F.when(monthly >= F.col("severity_high_usd"), "high")
        .when(monthly >= F.col("severity_medium_usd"), "medium")
        .otherwise("low")
    )


def findings_of(days: DataFrame) -> DataFrame:
    """Apply the rule columns to the statistics: at most one finding per series and day."""
    actual, expected, largest = F.col("actual"), F.col("expected"), F.col("largest")
    min_usd, min_pct = F.col("min_delta_usd"), F.col("min_delta_pct")

    def material(delta):
        return (delta >= min_usd) & (delta * DAYS_PER_MONTH >= F.col("min_monthly_impact_usd"))

    change = actual - expected
    size = F.abs(change)
    off_baseline = (
        F.col("has_base")
        & (size > 0)
        & (size >= F.col("mad_multiplier") * F.col("spread"))
        & (F.try_divide(size, expected) >= min_pct)
        & material(size)
        & ((change > 0) | F.col("include_drops"))
    )
    new_spend = (
        ~F.col("has_base")
        & (actual > 0)
        & material(actual)
        & (F.col("prior_total") < F.greatest(min_usd, F.lit(MIN_PRIOR_TOTAL)))
    )
    above_largest = actual - largest
    sporadic = (
        ~F.col("has_base") & (largest > 0) & material(above_largest) & (F.try_divide(above_largest, largest) >= min_pct)
    )
    kind = (
        F.when(off_baseline & (change > 0), "spike")
        .when(off_baseline, "drop")
        .when(new_spend, "new_spend")
        .when(sporadic, "spike")
    )
    found = (
        days.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .withColumn(
            "expected",
            F.when(F.col("has_base"), expected).when(F.col("kind") == "new_spend", 0.0).otherwise(largest),
        )
        .withColumn("delta", actual - F.col("expected"))
        .withColumn("direction", F.when(F.col("kind") == "drop", "down").otherwise("up"))
        .withColumn("severity", severity_of(F.col("delta")))
    )
    # Without spend a day never echoes, even when the threshold is 0 or less.
    threshold = (F.lit(1.0) - min_pct) * actual
    echoes = F.coalesce((F.col("echo") > 0) & (F.col("echo") >= threshold), F.lit(False))
    return found.where((F.col("direction") == "down") | ~echoes)


def detect(
    series: DataFrame,
    check_from: date,
    check_to: date | Column,
    rules: Rules | None = None,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Findings for every day of ``[check_from, check_to]`` and every series.

    ``series`` is scope_kind, scope_key, day, cost with one row per series and day, reaching
    ``rules.memory_days`` before ``check_from``; a missing day is 0. ``by`` names further key
    columns, such as a source id. Returns keys, day, expected, actual, delta, kind, direction,
    severity.
    """
    rules = rules or Rules()
    if rules.lookback_days <= 0:
        return series.where(F.lit(False)).select(
            *by,
            *SERIES_KEYS,
            "day",
            *[F.lit(0.0).alias(n) for n in ("expected", "actual", "delta")],
            *[F.lit("").alias(n) for n in ("kind", "direction", "severity")],
        )
    windows = day_windows(series, check_from, check_to, rules.memory_days, by)
    days = resolve_rules(levels(windows, rules.lookback_days, rules.memory_days), rules)
    return findings_of(with_spread(worth_a_look(days), rules.lookback_days)).select(*by, *FINDING_COLUMNS)
