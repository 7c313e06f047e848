import random
import statistics
from dataclasses import replace
from datetime import date, timedelta

import pytest

from billweave.model import BadRequest
from billweave.operators.anomalies import detect, last_settled_day
from billweave.operators.rules import Override, Rules

DAY = date(2026, 9, 30)
SCHEMA = "scope_kind string, scope_key string, day date, cost double"


def ago(n, day=DAY):
    return day - timedelta(days=n)


def run(spark, series, rules=Rules(), start=DAY, end=DAY):
    """Findings for hand-built series: {key: {day: cost}}."""
    rows = [("service", key, day, float(cost)) for key, days in series.items() for day, cost in days.items()]
    got = detect(spark.createDataFrame(rows, SCHEMA), start, end, rules).collect()
    return {(r.scope_key, r.day): r for r in got}


def flat(cost, days=60, **changes):
    out = {ago(n): cost for n in range(1, days)}
    out |= {ago(int(n[1:])): c for n, c in changes.items()}
    return out


def test_hand_built_series(spark):
    weekly = {ago(n): 250.0 if ago(n).weekday() == 2 else 100.0 for n in range(1, 60)}  # the day is a Wednesday
    last_month = date(2026, 8, 30)
    series = {
        "spike": flat(100.0, d0=300.0),
        "flat": flat(100.0, d0=100.0),
        "small change": flat(100.0, d0=119.0),
        "below percentage": flat(1000.0, d0=1200.0),
        "cents": flat(0.1, d0=1.0),
        "drop": flat(100.0, d0=10.0),
        "weekly": {**weekly, DAY: 250.0},
        "weekly spike": {**weekly, DAY: 600.0},
        "new": {DAY: 60.0},
        "new but small": {DAY: 19.0},
        "second day": {ago(1): 60.0, DAY: 60.0},
        "sporadic": {ago(7): 30.0, ago(14): 30.0, DAY: 5000.0},
        "monthly": {last_month: 400.0, DAY: 400.0},
        "monthly, a day off": {last_month + timedelta(days=1): 400.0, DAY: 400.0},
        "monthly, two days off": {last_month - timedelta(days=2): 400.0, DAY: 600.0},
        "monthly, grown": {last_month: 400.0, DAY: 900.0},
        "short history": {ago(n): 100.0 for n in range(0, 14)},
        "zero days count": {ago(n): 0.0 for n in range(1, 30)} | {DAY: 50.0},
        "negative": {ago(n): -5.0 for n in range(1, 40)} | {DAY: 30.0},
    }
    got = {key: (r.kind, r.expected, r.severity) for (key, _), r in run(spark, series).items()}
    assert got == {
        "spike": ("spike", 100.0, "high"),
        "weekly spike": ("spike", 250.0, "high"),
        "new": ("new_spend", 0.0, "medium"),
        "sporadic": ("spike", 30.0, "high"),
        "monthly, two days off": ("spike", 400.0, "high"),
        "monthly, grown": ("spike", 400.0, "high"),
        "zero days count": ("new_spend", 0.0, "medium"),
        "negative": ("new_spend", 0.0, "medium"),
    }


def test_rules_change_what_is_found(spark):
    series = {"up": flat(100.0, d0=300.0), "down": flat(100.0, d0=10.0)}
    found = lambda rules: set(key for key, _ in run(spark, series, rules))
    assert found(Rules(include_drops=True)) == {"up", "down"}
    assert found(Rules(min_delta_usd=250)) == set()
    assert found(Rules(min_monthly_impact_usd=6001)) == set()
    assert found(Rules(min_delta_pct=2.5)) == set()
    assert found(Rules(mad_multiplier=41)) == set()
    drop = run(spark, series, Rules(include_drops=True))[("down", DAY)]
    assert (drop.kind, drop.direction, drop.delta) == ("drop", "down", -90.0)


def test_overrides(spark):
    series = {"a": flat(100.0, d0=300.0), "b": flat(100.0, d0=300.0), "c": flat(100.0, d0=20.0)}
    rules = Rules(
        overrides=(
            Override("service", " a ", min_delta_usd=1000),
            Override("account", "b", min_delta_usd=1000),
            Override("service", "b", severity_high_usd=1e6, severity_medium_usd=1e5),
            Override("service", "c", include_drops=True),
        )
    ).validate()
    assert {k: (r.kind, r.severity) for (k, _), r in run(spark, series, rules).items()} == {"b": ("spike", "low"), "c": ("drop", "high")}


def test_settling_days_come_from_the_data(spark):
    rows = [("service", "a", ago(n), 100.0 if n > 4 else 400.0) for n in range(3, 60)]
    series = spark.createDataFrame(rows, SCHEMA)
    got = detect(series, ago(10), last_settled_day(series, 1)).collect()
    assert [r.day for r in got] == [ago(4)]
    assert detect(series, ago(2), last_settled_day(series, 1)).count() == 0


def test_bad_rules():
    assert Rules().validate()
    bad = [
        dict(mad_multiplier=0.0),
        dict(min_delta_usd=-1.0),
        dict(min_delta_pct=float("nan")),
        dict(severity_high_usd=1.0),
        dict(lookback_days=13),
        dict(lookback_days=91),
        dict(settling_days=8),
        dict(check_interval_hours=0),
        dict(overrides=(Override("service", " "),)),
        dict(overrides=(Override("region", "x"),)),
        dict(overrides=(Override("service", "x"), Override("service", " x "))),
        dict(overrides=(Override("service", "x", severity_medium_usd=9e9),)),
    ]
    for fields in bad:
        with pytest.raises(BadRequest):
            Rules(**fields).validate()


def test_rules_fingerprint():
    same = [Rules(), Rules(enabled=False), Rules(check_interval_hours=1)]
    assert len({r.fingerprint() for r in same}) == 1
    other = [Rules(min_delta_usd=1), Rules(overrides=(Override("service", "x"),)), Rules(settling_days=3)]
    assert len({r.fingerprint() for r in [*same, *other]}) == 4


def by_hand(costs, day, rules):
    """One day of one series, straight from the definition."""
    cost = lambda n: costs.get(ago(n, day), 0.0)
    back = range(1, rules.lookback_days + 1)
    base = statistics.median(cost(n) for n in back)
    actual, memory = cost(0), [cost(n) for n in range(1, max(rules.lookback_days, 35) + 1)]
    floors = lambda delta: delta >= rules.min_delta_usd and delta * 30 >= rules.min_monthly_impact_usd
    if sum(ago(n, day) in costs for n in back) < 14 or base <= 0:
        if actual > 0 and floors(actual) and sum(memory) < max(rules.min_delta_usd, 0.01):
            kind, expected = "new_spend", 0.0
        else:
            expected, kind = max(0.0, *memory), "spike"
            delta = actual - expected
            if not (expected > 0 and floors(delta) and delta / expected >= rules.min_delta_pct):
                return None
    else:
        factor = {}
        for weekday in range(7):
            same = [cost(n) for n in back if n % 7 == weekday]
            factor[weekday] = min(max(statistics.median(same) / base, 0.2), 5.0)
        expected = base * factor[0]
        mad = statistics.median(abs(cost(n) - base * factor[n % 7]) for n in back)
        delta = actual - expected
        size = abs(delta)
        if size == 0 or size < rules.mad_multiplier * max(1.4826 * mad, 0.05 * expected):
            return None
        if not floors(size) or size / expected < rules.min_delta_pct or (delta < 0 and not rules.include_drops):
            return None
        kind = "spike" if delta > 0 else "drop"
    if kind != "drop":
        month, year = (day.month - 1, day.year) if day.month > 1 else (12, day.year - 1)
        last = (date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)).day
        center = date(year, month, min(day.day, last))
        near = [costs.get(center + timedelta(days=i)) for i in (-1, 0, 1)]
        if any(c is not None and c > 0 and c >= (1 - rules.min_delta_pct) * actual for c in near):
            return None
    return kind, round(expected, 6)


@pytest.mark.parametrize(
    "rules",
    [Rules(), Rules(lookback_days=60, include_drops=True, min_delta_pct=0.1), Rules(lookback_days=14, include_drops=True, min_delta_pct=1.2, min_delta_usd=5)],
)
def test_against_the_definition_on_random_series(spark, rules):
    rng = random.Random(rules.lookback_days)
    start, end = date(2026, 2, 20), date(2026, 4, 2)
    series = {}
    for i in range(60):
        level, fill = rng.choice([2.0, 60.0, 500.0]), rng.choice([0.1, 0.4, 0.97, 1.0])
        days = {}
        for n in range(140):
            day = date(2025, 11, 25) + timedelta(days=n)
            if rng.random() < fill:
                cost = level * rng.choice([1, 1, 1, 1.1, 0.9]) * (0.5 if day.weekday() > 4 and i % 2 else 1)
                if rng.random() < 0.06:
                    cost *= rng.choice([0, 0.1, 2, 6, -1])
                days[day] = round(cost, 2)
            if i % 5 == 0 and day.day in (1, 31):
                days[day] = 777.0
        series[f"s{i}"] = days
    expected = {}
    for key, costs in series.items():
        for n in range((end - start).days + 1):
            day = start + timedelta(days=n)
            found = by_hand(costs, day, rules)
            if found:
                expected[key, day] = found
    got = {k: (r.kind, round(r.expected, 6)) for k, r in run(spark, series, rules, start, end).items()}
    assert len(expected) > 5 and got == expected


def test_lookback_of_zero_finds_nothing(spark):
    assert run(spark, {"a": {DAY: 500.0}}, replace(Rules(), lookback_days=0)) == {}
