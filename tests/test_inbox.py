import random
from datetime import date, datetime, timedelta

import pytest

from billweave.model import BadRequest
from billweave.operators import inbox as box
from billweave.operators.inbox import InboxState

D0 = date(2026, 9, 1)
NOW = datetime(2026, 10, 1)
RANK = {"low": 0, "medium": 1, "high": 2}
FINDINGS = "source_id string, scope_kind string, scope_key string, day date, expected double, actual double, delta double, kind string, direction string, severity string"


def day(n):
    return D0 + timedelta(days=n)


def findings(spark, rows):
    """(key, day offset, delta, severity[, kind]) rows of one source."""
    out = []
    for key, n, delta, severity, *kind in rows:
        kind = kind[0] if kind else ("spike" if delta > 0 else "drop")
        out.append(("s", "service", key, day(n), 100.0, 100.0 + delta, float(delta), kind, "down" if kind == "drop" else "up", severity))
    return spark.createDataFrame(out, FINDINGS)


def keep(state):
    """Cut the plan between runs, as storing a snapshot does."""
    spark = state.anomalies.sparkSession
    return InboxState(*[spark.createDataFrame(f.collect(), f.schema) for f in (state.anomalies, state.mutes, state.runs)])


def run(spark, state, rows, checked=(0, 40), now=NOW, today=date(2026, 10, 1)):
    span = (day(checked[0]), day(checked[1])) if checked else None
    return keep(box.apply_run(state, "s", span, findings(spark, rows), today, now))


def view(state):
    return {r.id: r for r in state.anomalies.collect()}


def days_of(row):
    return [(p.day - D0).days for p in row.points]


@pytest.fixture
def empty(spark):
    return InboxState.empty(spark)


def test_gaps_directions_and_keys(spark, empty):
    rows = [("a", 0, 50, "low"), ("a", 3, 50, "high"), ("a", 7, 10, "low"), ("a", 1, -50, "low"), ("b", 1, 60, "medium", "new_spend")]
    got = view(run(spark, empty, rows))
    assert {k: days_of(r) for k, r in got.items()} == {
        "s:service:a:up:2026-09-01": [0, 3],
        "s:service:a:up:2026-09-08": [7],
        "s:service:a:down:2026-09-02": [1],
        "s:service:b:up:2026-09-02": [1],
    }
    first = got["s:service:a:up:2026-09-01"]
    assert (first.total_impact, first.severity, first.status, first.first_day, first.last_day) == (100.0, "high", "open", day(0), day(3))
    assert got["s:service:b:up:2026-09-02"].kind == "new_spend"


def test_revised_point_and_extension(spark, empty):
    state = run(spark, empty, [("a", 5, 50, "high")], (0, 10))
    state = run(spark, state, [("a", 5, 20, "low"), ("a", 8, 30, "low")], (0, 10), NOW + timedelta(days=1))
    (row,) = view(state).values()
    assert (row.id, days_of(row), row.total_impact, row.severity) == ("s:service:a:up:2026-09-06", [5, 8], 50.0, "low")
    assert row.detected_at < row.updated_at
    # An earlier finding extends it backwards; the id keeps the founding day.
    state = run(spark, state, [("a", 2, 30, "low"), ("a", 5, 20, "low"), ("a", 8, 30, "low")], (0, 10))
    (row,) = view(state).values()
    assert (row.id, row.first_day) == ("s:service:a:up:2026-09-06", day(2))


def test_a_finding_between_two_anomalies_joins_the_first_one(spark, empty):
    state = run(spark, empty, [("a", 0, 50, "low"), ("a", 5, 50, "low")], (0, 5))
    state = run(spark, state, [("a", 0, 50, "low"), ("a", 3, 50, "low"), ("a", 5, 50, "low")], (0, 5))
    # Day 5 is then in reach of both: it moves into the first and is retracted nowhere.
    got = {k: days_of(r) for k, r in view(state).items()}
    assert got == {"s:service:a:up:2026-09-01": [0, 3, 5], "s:service:a:up:2026-09-06": [5]}


def test_retraction(spark, empty):
    state = run(spark, empty, [("a", 0, 50, "low"), ("a", 2, 50, "high"), ("b", 2, 50, "low"), ("c", 2, 50, "low")], (0, 5))
    state = keep(box.acknowledge(state, "s:service:c:up:2026-09-03", NOW))
    state = run(spark, state, [], (1, 5))
    got = view(state)
    assert {k: (days_of(r), r.severity) for k, r in got.items()} == {
        "s:service:a:up:2026-09-01": ([0], "low"),
        "s:service:c:up:2026-09-03": ([2], "low"),
    }
    assert view(run(spark, state, [], None)).keys() == got.keys()
    assert view(run(spark, state, [], (5, 4))).keys() == got.keys()
    # The other direction firing on that day does not keep the point.
    assert "s:service:a:up:2026-09-01" not in view(run(spark, state, [("a", 0, -50, "low")], (0, 5)))


def test_other_sources_are_untouched(spark, empty):
    state = run(spark, empty, [("a", 2, 50, "low")], (0, 5))
    other = findings(spark, [("a", 2, 70, "low")]).drop("source_id")
    state = keep(box.apply_run(state, "t", (day(0), day(5)), other, date(2026, 10, 1), NOW))
    assert set(view(state)) == {"s:service:a:up:2026-09-03", "t:service:a:up:2026-09-03"}
    state = keep(box.forget_source(state, "s"))
    assert set(view(state)) == {"t:service:a:up:2026-09-03"} and state.runs.count() == 1


def test_escalation_follows_each_finding(spark, empty):
    state = run(spark, empty, [("a", 2, 50, "medium"), ("b", 2, 50, "high")], (0, 5))
    for key in "ab":
        state = keep(box.acknowledge(state, f"s:service:{key}:up:2026-09-03", NOW))
    same = view(run(spark, state, [("a", 2, 50, "medium"), ("a", 3, 50, "medium")], (0, 5)))
    assert same["s:service:a:up:2026-09-03"].status == "acknowledged"
    # a rises; b first falls to low on its revised day and then rises to medium.
    risen = run(spark, state, [("a", 3, 50, "high"), ("b", 2, 5, "low"), ("b", 3, 50, "medium")], (0, 5))
    got = view(risen)
    assert [(got[f"s:service:{k}:up:2026-09-03"].status, got[f"s:service:{k}:up:2026-09-03"].escalated) for k in "ab"] == [("open", True)] * 2
    again = view(box.acknowledge(risen, "s:service:a:up:2026-09-03", NOW))["s:service:a:up:2026-09-03"]
    assert (again.status, again.escalated) == ("acknowledged", False)
    with pytest.raises(KeyError):
        box.acknowledge(state, "nope", NOW)


def test_mutes(spark, empty):
    today = date(2026, 10, 1)
    state = run(spark, empty, [("a", 2, 50, "low"), ("b", 2, 90, "high"), ("c", 4, 90, "high")], (0, 5))
    state = keep(box.mute(state, "s", "service", " a ", 7, today))
    assert state.mutes.first().until == date(2026, 10, 7)
    assert {r.scope_key: r.muted for r in view(state).values()} == {"a": True, "b": False, "c": False}
    assert box.open_count(state, ["s"], today) == 2 and box.open_count(state, ["other"], today) == 0
    assert [r.scope_key for r in box.inbox(state, ["s"], today).collect()] == ["c", "b", "a"]
    later = box.apply_mutes(state, date(2026, 10, 8))
    assert later.mutes.count() == 0 and not any(r.muted for r in view(later).values())
    assert box.mute(state, "s", "service", "a", 1, today).mutes.collect()[0].until == today
    for args in (("s", "service", "a", 0), ("s", "service", "a", 366), ("s", "service", " ", 5), (" ", "service", "a", 5)):
        with pytest.raises(BadRequest):
            box.mute(state, *args, today)


def test_retention_and_run_history(spark, empty):
    state = run(spark, empty, [("a", 0, 50, "low"), ("b", 1, 50, "low")], (0, 5))
    assert set(r.scope_key for r in view(box.prune(state, D0 + timedelta(days=91))).values()) == {"b"}
    state = box.record_run(empty, "s", NOW, "ok", "f1", date(2026, 9, 20))
    state = keep(box.record_run(state, "s", NOW, "ok", "f2", date(2026, 9, 10), estimate_usd=0.5))
    row = state.runs.first()
    assert (row.fingerprint, row.last_checked_day, row.outcome, row.estimate_usd) == ("f2", date(2026, 9, 20), "ok", 0.5)
    failed = box.record_run(state, "s", NOW, "error", "f2", None, "boom").runs.first()
    assert (failed.last_checked_day, failed.message) == (date(2026, 9, 20), "boom")


class ByHand:
    """The inbox rules one finding at a time."""

    def __init__(self):
        self.list = []

    def run(self, rows, lo, hi):
        for a in self.list:
            if a["status"] == "open":
                fired = {n for key, n, delta, _ in rows if key == a["key"] and (delta > 0) == a["up"]}
                a["points"] = {n: p for n, p in a["points"].items() if not lo <= n <= hi or n in fired}
        self.list = [a for a in self.list if a["points"]]
        for key, n, delta, severity in sorted(rows, key=lambda r: r[1]):
            for a in self.list:
                near = min(a["points"]) - 3 <= n <= max(a["points"]) + 3
                if a["key"] == key and a["up"] == (delta > 0) and near:
                    worst = max(RANK[s] for _, s in a["points"].values())
                    a["points"][n] = (delta, severity)
                    if a["status"] == "acknowledged" and max(RANK[s] for _, s in a["points"].values()) > worst:
                        a["status"], a["escalated"] = "open", True
                    break
            else:
                up = delta > 0
                self.list.append(dict(id=f"s:service:{key}:{'up' if up else 'down'}:{day(n)}", key=key, up=up, points={n: (delta, severity)}, status="open", escalated=False))

    def view(self):
        return sorted((a["id"], sorted(a["points"]), a["status"], a["escalated"], sum(d for d, _ in a["points"].values())) for a in self.list)


def test_random_histories_against_the_rules(spark):
    rng = random.Random(7)
    state, by_hand = InboxState.empty(spark), ByHand()
    for step in range(5):
        lo, hi = step * 4, step * 4 + 9
        rows = []
        for key in "abcdefgh":
            for n in range(lo, hi + 1):
                if rng.random() < 0.3:
                    rows.append((key, n, rng.choice([50, 50, 70, -40]), rng.choice(list(RANK))))
        by_hand.run(rows, lo, hi)
        state = run(spark, state, rows, (lo, hi), NOW + timedelta(days=step))
        got = sorted((r.id, days_of(r), r.status, r.escalated, r.total_impact) for r in state.anomalies.collect())
        assert got == by_hand.view()
        for a in rng.sample(by_hand.list, 5):
            if sum(x["id"] == a["id"] for x in by_hand.list) == 1:
                a["status"], a["escalated"] = "acknowledged", False
                state = box.acknowledge(state, a["id"], NOW)
        state = keep(state)
