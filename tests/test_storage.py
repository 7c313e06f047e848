import json
from datetime import date, datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from billweave.functions.periods import months_overlapping
from billweave.model import BadRequest
from billweave.operators import footers, inbox
from billweave.operators.inbox import InboxState
from billweave.sinks.state import StateConflict, StateStore
from billweave.sources.exports import (
    billing_periods,
    discover,
    listing_fingerprints,
    load_source,
    read_months,
    resolve_path,
)

from .billing import CUR_SCENARIOS, cur_raw, focus_raw, write_month


def focus(spark, day, cost, **more):
    return focus_raw(spark, [dict(day=day, service_name="EC2", account_id="1", cost=cost)], **more)


def totals(nc):
    return {r.source_format: r.total for r in nc.groupBy("source_format").agg(F.sum("amortized_cost").alias("total")).collect()}


def test_months_are_found_in_any_spelling(spark, tmp_path):
    for name in ("BILLING_PERIOD=2026-08", "billing_period=2026-07", "BILLING_PERIOD=2026-13", "BILLING_PERIOD=x", "other=2026-08"):
        (tmp_path / name).mkdir()
    (tmp_path / "BILLING_PERIOD=2026-09").write_text("a file")
    assert [p.month for p in billing_periods(spark, str(tmp_path))] == ["2026-07", "2026-08"]
    assert billing_periods(spark, str(tmp_path / "missing")) == []


def test_a_source_that_changed_format(spark, tmp_path):
    write_month(focus(spark, "2026-07-10", 5.0, version="1.0"), tmp_path, "2026-07")
    write_month(focus(spark, "2026-08-10", 7.0), tmp_path, "2026-08", name="billing_period")
    write_month(cur_raw(spark, [(r, f) for r, f, _, _ in CUR_SCENARIOS], "2026-09-15"), tmp_path, "2026-09")
    nc = load_source(spark, str(tmp_path))
    assert totals(nc) == {"focus10": 5.0, "focus12": 7.0, "cur2": 234.0}
    assert totals(load_source(spark, str(tmp_path), date(2026, 8, 1), date(2026, 9, 1))) == {"focus12": 7.0}
    assert all("billing_period=2026-08" in r.source_file for r in nc.where("source_format = 'focus12'").collect())


def test_an_empty_source_is_valid(spark, tmp_path):
    assert load_source(spark, str(tmp_path)).count() == 0


def test_manifests(spark, tmp_path):
    base = tmp_path / "base"
    folder = write_month(focus(spark, "2026-08-10", 1.0), base, "2026-08")
    (part,) = folder.glob("*.parquet")
    elsewhere = tmp_path / "elsewhere"
    focus(spark, "2026-08-11", 10.0).coalesce(1).write.parquet(str(elsewhere))
    (far,) = elsewhere.glob("*.parquet")
    focus(spark, "2026-08-12", 100.0).coalesce(1).write.parquet(str(folder / "unlisted"))
    (folder / "Manifest.json").write_text(json.dumps({"dataFiles": [part.name], "files": [{"key": str(far)}, {"dataFile": None}]}))
    (found,) = discover(spark, str(base))
    assert found.files == (f"{folder}/{part.name}", str(far))
    assert totals(load_source(spark, str(base))) == {"focus12": 11.0}
    # A broken manifest skips its month only; one that lists nothing reads nothing.
    write_month(focus(spark, "2026-09-01", 1.0), base, "2026-09", manifest="{not json")
    write_month(focus(spark, "2026-10-01", 1.0), base, "2026-10", manifest='{"billingPeriod": {"start": "x"}}')
    assert [(p.month, len(p.files)) for p in discover(spark, str(base))] == [("2026-08", 2), ("2026-10", 0)]


def test_files_of_one_month_that_differ(spark, tmp_path):
    folder = tmp_path / "BILLING_PERIOD=2026-08"
    folder.mkdir()
    raws = [
        focus(spark, "2026-08-10", 1.0),
        focus(spark, "2026-08-11", 10.0).drop("Tags"),
        focus(spark, "2026-08-12", 100.0, decimals=True),
        focus(spark, "2026-08-13", 1000.0, service_code=False),
        cur_raw(spark, [("r", CUR_SCENARIOS[0][1])], "2026-08-14"),
    ]
    for i, raw in enumerate(raws):
        raw.coalesce(1).write.parquet(str(tmp_path / f"raw{i}"))
        (part,) = (tmp_path / f"raw{i}").glob("*.parquet")
        part.rename(folder / f"{i}.parquet")
    nc = load_source(spark, str(tmp_path))
    assert totals(nc) == {"focus12": 1111.0, "cur2": float(CUR_SCENARIOS[0][3])}
    assert nc.where("usage_start IS NULL OR amortized_cost IS NULL").count() == 0
    assert sorted(r.n for r in nc.select(F.size(F.map_keys("tags")).alias("n")).where("n > 0").collect()) == sorted(
        r.n for r in nc.where("tags IS NOT NULL AND size(map_keys(tags)) > 0").select(F.size(F.map_keys("tags")).alias("n")).collect()
    )
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "odd"))
    (part,) = (tmp_path / "odd").glob("*.parquet")
    part.rename(folder / "odd.parquet")
    with pytest.raises(Exception):
        load_source(spark, str(tmp_path))


def test_files_in_subfolders_and_elsewhere_keep_their_month(spark, tmp_path):
    base = tmp_path / "base"
    folder = write_month(focus(spark, "2026-08-10", 1.0), base, "2026-08")
    focus(spark, "2026-08-11", 10.0).coalesce(1).write.parquet(str(folder / "run1"))
    focus(spark, "2026-08-12", 100.0).coalesce(1).write.parquet(str(tmp_path / "far"))
    (near,), (far,) = (folder / "run1").glob("*.parquet"), (tmp_path / "far").glob("*.parquet")
    (folder / "Manifest.json").write_text(json.dumps({"dataFiles": [f"run1/{near.name}", str(far)]}))
    lines = read_months(spark, discover(spark, str(base)))
    assert {(r.billing_period, r.amortized_cost) for r in lines.collect()} == {("2026-08", 10.0), ("2026-08", 100.0)}
    before = listing_fingerprints(spark, str(base))
    focus(spark, "2026-08-12", 9.0).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "again"))
    (again,) = (tmp_path / "again").glob("*.parquet")
    far.write_bytes(again.read_bytes())
    assert listing_fingerprints(spark, str(base)) != before


def test_paths_in_manifests(spark):
    cases = {"a/b.parquet": "/base/a/b.parquet", "/abs/x": "/abs/x", "s3://b/k": "s3://b/k", "C:\\x": "C:\\x", "D:/x": "D:/x"}
    rows = spark.createDataFrame([(p,) for p in cases], "p string")
    got = {r.p: r.q for r in rows.select("p", resolve_path(F.col("p"), F.lit("/base//")).alias("q")).collect()}
    assert got == cases


def test_months_overlapping(spark):
    pairs = [("2026-01-15", "2026-03-01"), ("2026-01-31", "2026-02-01"), ("2026-02-01", "2026-02-01"), ("2026-03-01", "2026-02-01")]
    df = spark.createDataFrame(pairs, "a string, b string").select(months_overlapping(F.to_date("a"), F.to_date("b")).alias("m"))
    assert [r.m for r in df.collect()] == [["2026-01", "2026-02"], ["2026-01"], [], []]


def test_listing_fingerprints(spark, tmp_path):
    write_month(focus(spark, "2026-07-10", 5.0), tmp_path, "2026-07")
    write_month(focus(spark, "2026-08-10", 5.0), tmp_path, "2026-08")
    before = listing_fingerprints(spark, str(tmp_path))
    assert before == listing_fingerprints(spark, str(tmp_path)) and len(before) == 2
    write_month(focus(spark, "2026-08-10", 6.0), tmp_path, "2026-08")
    after = listing_fingerprints(spark, str(tmp_path))
    assert after["2026-07"] == before["2026-07"] and after["2026-08"] != before["2026-08"]


INDEX = [
    ("jul", 0, datetime(2026, 7, 1), datetime(2026, 7, 31), 100, 4),
    ("aug", 0, datetime(2026, 8, 1), datetime(2026, 8, 15), 200, 4),
    ("aug", 1, datetime(2026, 8, 16), datetime(2026, 8, 31), 300, 4),
]


def estimate(spark, rows, *scans):
    index = spark.createDataFrame(rows, footers.INDEX_SCHEMA)
    return [tuple(r) for r in footers.scan_estimate(index, list(scans)).orderBy("scan").collect()]


def test_scan_estimate(spark):
    august, july = ("2026-08-01", "2026-09-01"), ("2026-07-01", "2026-08-01")
    assert estimate(spark, INDEX, [august], [july], [july, august], [august, ("2026-08-10", "2026-08-20")]) == [
        (0, 500, 10, 2, 1, False),
        (1, 100, 6, 1, 1, False),
        (2, 600, 16, 3, 2, False),
        (3, 500, 10, 2, 1, False),
    ]
    # The end is exclusive, the last statistic inclusive.
    assert estimate(spark, INDEX, [("2026-07-31", "2026-08-01")])[0][1] == 100
    blind = [*INDEX, ("x", 0, None, None, 7, 4)]
    assert estimate(spark, blind, [("2020-01-01", "2020-02-01")]) == [(0, 7, 6, 1, 1, True)]


def test_page_cost(spark):
    index = spark.createDataFrame([("a", 0, datetime(2026, 8, 1), datetime(2026, 8, 2), 10_000_000_000, 8)], footers.INDEX_SCHEMA)
    scans = [[("2026-08-01", "2026-09-01")]] * 2
    row = footers.page_cost(index, scans, spark).first()
    assert (row.bytes, row.requests, row.tier) == (20_000_000_000, 20, "hard")
    assert row.usd == pytest.approx(20 * 0.09 + 20 / 1000 * 0.0004)
    tier = lambda **o: footers.page_cost(index, scans, spark, **o).first().tier
    assert [tier(guard={"hard_limit_usd": 10.0}), tier(guard={"hard_limit_usd": 10.0, "soft_limit_usd": 5.0})] == ["soft", "none"]
    assert [tier(guard={"enabled": False}), tier(remote=False)] == ["none", "none"]
    unknown = footers.page_cost(None, scans, spark).first()
    assert (unknown.known, unknown.bytes, unknown.usd, unknown.tier) == (False, 0, 0.0, "none")
    for bad in ([], [[]], [[("2026-08-01", "2026-09-01")] * 5], [[("2026-09-01", "2026-08-01")]], scans * 17):
        with pytest.raises(BadRequest):
            footers.page_cost(index, bad, spark)


def test_footer_index(spark, tmp_path):
    table = pa.table(
        {
            "ChargePeriodStart": pa.array([datetime(2026, 8, d) for d in range(1, 7)], pa.timestamp("us", tz="UTC")),
            "EffectiveCost": [1.0] * 6,
            "Other": ["x"] * 6,
            "Tags": pa.array([[("k", "v")]] * 6, pa.map_(pa.string(), pa.string())),
        }
    )
    good, bare = str(tmp_path / "good.parquet"), str(tmp_path / "bare.parquet")
    pq.write_table(table, good, row_group_size=3)
    pq.write_table(table, bare, write_statistics=False)
    columns = ["ChargePeriodStart", "effectivecost", "tags"]
    rows = {(r.file, r.row_group): r for r in footers.footer_index(spark, [good, "file://" + bare], columns).collect()}
    first, second, none = rows[good, 0], rows[good, 1], rows["file://" + bare, 0]
    assert (first.min_ts, first.max_ts) == (datetime(2026, 8, 1), datetime(2026, 8, 3))
    assert (second.min_ts, second.max_ts) == (datetime(2026, 8, 4), datetime(2026, 8, 6))
    assert first.chunks == 4 and first.bytes > 0  # the map has a key and a value chunk
    assert (none.min_ts, none.max_ts) == (None, None)


def test_numbers_are_no_dates(spark, tmp_path):
    pq.write_table(pa.table({"start": [20260801, 20260802], "day": ["2026-08-01", "2026-08-02"]}), str(tmp_path / "x.parquet"))
    index = footers.footer_index(spark, [str(tmp_path / "x.parquet")], ["start"])
    assert index.first().min_ts is None
    assert footers.scan_estimate(index, [[("2026-08-01", "2026-09-01")]]).first().stats_missing
    assert footers.footer_index(spark, [str(tmp_path / "x.parquet")], ["day"]).first().max_ts == datetime(2026, 8, 2)


def test_data_fingerprint(spark):
    frame = lambda rows: spark.createDataFrame(rows, footers.INDEX_SCHEMA).repartition(3)
    print_of = lambda rows: footers.data_fingerprint(frame(rows)).first().fingerprint
    changed = [*INDEX[:2], (*INDEX[2][:4], 301, 4)]
    assert print_of(INDEX) == print_of(INDEX[::-1])
    assert len({print_of(INDEX), print_of(changed), print_of(INDEX[:2]), print_of(INDEX + INDEX[:1]), print_of([])}) == 5


def files_of(folder):
    return {str(f.relative_to(folder)): f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}


def run_of(store, source_id, fingerprint):
    return store.update(lambda s: inbox.record_run(s, source_id, datetime(2026, 10, 1), "ok", fingerprint), [source_id])


def prints(store):
    return {r.source_id: r.fingerprint for r in store.load().runs.collect()}


def test_state_store(spark, tmp_path):
    store, now = StateStore(spark, str(tmp_path / "state")), datetime(2026, 10, 1)
    log = tmp_path / "state" / "log"
    assert store.load().anomalies.count() == 0 and store.entry().version == 0
    store.update(lambda s: inbox.record_run(s, "s", now, "ok", "f"))
    store.update(lambda s: inbox.mute(s, "s", "service", "a", 5, now.date()))
    state = store.load()
    assert (state.runs.first().fingerprint, state.mutes.count(), store.entry().version) == ("f", 1, 2)
    # A log file that a writer died on is not read, and its number is not used again.
    (log / "3.json").write_text('{"form')
    assert store.entry().version == 2
    assert store.save(state) == 4 and prints(store) == {"s": "f"}
    # A commit of another format is left alone.
    (log / "4.json").write_text('{"format": 99}')
    (log / ".4.json.crc").unlink(missing_ok=True)
    assert store.load().runs.count() == 0
    assert store.save(InboxState.empty(spark)) == 5 and store.entry().parts == {}
    run_of(store, "t", "g")
    store.vacuum(keep=1)
    assert len(list((tmp_path / "state" / "parts").iterdir())) == 5
    store.vacuum(keep=1, older_than=timedelta(0))
    assert [p.name for p in log.glob("*.json")] == ["6.json"]
    assert [p.name for p in (tmp_path / "state" / "parts").iterdir()] == [store.entry().parts["t"]]
    assert prints(store) == {"t": "g"}


def test_a_commit_leaves_other_sources_alone(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    state = InboxState.empty(spark)
    for s in ("a", "b", "", "c d/é"):
        state = inbox.record_run(state, s, datetime(2026, 10, 1), "ok", f"1{s}")
    store.save(state)
    before, parts = files_of(tmp_path / "state" / "parts"), store.entry().parts
    assert len(set(parts.values())) == 1 and set(parts) == {"a", "b", "", "c d/é"}
    run_of(store, "b", "2")
    assert prints(store) == {"a": "1a", "b": "2", "": "1", "c d/é": "1c d/é"}
    after = files_of(tmp_path / "state" / "parts")
    assert before.items() <= after.items()
    assert {s for s, p in store.entry().parts.items() if p != parts[s]} == {"b"}
    # Rows of one source are read from its own folder only.
    plan = store.load(["a"]).runs._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_part" in plan
    assert [r.source_id for r in store.load(["a"]).runs.collect()] == ["a"]
    forgotten = store.update(lambda s: inbox.forget_source(s, "a"))
    assert forgotten.runs.count() == 3 and set(store.entry().parts) == {"b", "", "c d/é"}


def test_a_lost_race_is_made_good(spark, tmp_path):
    """Another writer commits between a change's load and its commit, once or more."""
    mine, theirs = StateStore(spark, str(tmp_path / "state")), StateStore(spark, str(tmp_path / "state"))
    run_of(theirs, "a", "0")
    calls = []

    def slowly(source_id, others):
        def change(state):
            calls.append(source_id)
            if others:
                run_of(theirs, *others.pop())
            return inbox.record_run(state, source_id, datetime(2026, 10, 1), "ok", f"{[r.fingerprint for r in state.runs.collect()]}")

        return change

    # The other writer changed another source: what is written already holds.
    mine.update(slowly("a", [("b", "1")]), ["a"])
    assert calls == ["a"] and prints(mine) == {"a": "['0']", "b": "1"}
    # It changed the same one: the change is applied again, to the newest state, as often as needed.
    mine.update(slowly("a", [("a", "4"), ("a", "3")]), ["a"])
    assert calls == ["a"] * 4 and prints(mine) == {"a": "['4']", "b": "1"}
    # A change of the whole state meets any commit.
    mine.update(lambda s: inbox.mute(slowly("c", [])(s), "c", "service", "x", 3, date(2026, 10, 1)))
    assert set(prints(mine)) == {"a", "b", "c"}
    with pytest.raises(StateConflict):
        mine.update(slowly("a", [("a", str(i)) for i in range(20)]), ["a"])
    assert prints(mine)["a"].isdigit()
