from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from billweave.model import BadRequest, CostMetric
from billweave.operators import inbox
from billweave.operators.footers import INDEX_SCHEMA
from billweave.operators.rules import Rules
from billweave.plans.monitor import CheckWindow, Source, billing_source, check_window, run_check, run_checks
from billweave.sinks.state import StateStore
from billweave.sources.exports import load_source
from billweave.streaming.daily_spend import daily_spend
from billweave.streaming.ingest import SeriesTable, check_available, check_table, ingest_available
from billweave.streaming.window import SeriesWindow

from .billing import anomaly_lines, focus_raw, lines, write_month

NOW = datetime(2026, 10, 1, 8)
EXPECTED = {
    ("account", "acct-media", "spike"): (25, 27),
    ("account", "acct-lab", "new_spend"): (25, 25),
    ("service", "Render farm", "spike"): (25, 27),
    ("service", "Vector search", "new_spend"): (25, 25),
}


def found(store):
    rows = store.load().anomalies.where("status = 'open'").collect()
    return {(r.scope_kind, r.scope_key, r.kind): (r.first_day.day, r.last_day.day) for r in rows}


def write_anomaly_export(spark, base, **changes):
    rows = anomaly_lines(**changes)
    for month in sorted({r["day"][:7] for r in rows}):
        write_month(focus_raw(spark, [r for r in rows if r["day"][:7] == month]), base, month)


def test_check_window():
    rules = Rules()
    assert check_window(date(2026, 10, 1), None, rules) == CheckWindow(date(2026, 8, 16), date(2026, 10, 2), date(2026, 9, 22))
    from_days = [date(2026, 9, 28), date(2026, 9, 10), date(2026, 1, 1)]
    assert [check_window(date(2026, 10, 1), d, rules).check_from for d in from_days] == [date(2026, 9, 22), date(2026, 9, 11), date(2026, 1, 2)]
    assert check_window(date(2026, 10, 1), date(2026, 1, 1), rules, longest=31).check_from == date(2026, 8, 29)
    assert check_window(date(2026, 10, 1), None, Rules(lookback_days=60)).query_start == date(2026, 7, 22)


def test_exactly_four_anomalies_from_files(spark, tmp_path):
    write_anomaly_export(spark, tmp_path / "data")
    store = StateStore(spark, str(tmp_path / "state"))
    source = Source("s", lambda *_: load_source(spark, str(tmp_path / "data")), "v1")
    out = run_check(store, source, Rules(), NOW)
    assert (out.kind, out.checked_from, out.checked_to, out.new_anomalies) == ("ok", date(2026, 9, 22), date(2026, 9, 28), 4)
    assert found(store) == EXPECTED
    assert not list(Path(spark.conf.get("spark.checkpoint.dir")).glob("check-*"))
    assert run_check(store, source, Rules(), NOW).kind == "unchanged"
    manual = run_check(store, source, Rules(), NOW + timedelta(hours=1), automatic=False)
    assert (manual.kind, manual.new_anomalies) == ("ok", 0) and found(store) == EXPECTED
    assert run_check(store, source, Rules(min_delta_usd=21), NOW + timedelta(hours=2)).kind == "ok"
    # The provider takes the spike back: the open anomalies go, the acknowledged one stays as seen.
    store.update(lambda s: inbox.acknowledge(s, "s:account:acct-media:up:2026-09-25", NOW))
    write_anomaly_export(spark, tmp_path / "data", render_peak=400.0)
    again = Source("s", source.load, "v2")
    assert run_check(store, again, Rules(), NOW + timedelta(hours=3)).kind == "ok"
    assert set(found(store)) == {("account", "acct-lab", "new_spend"), ("service", "Vector search", "new_spend")}
    assert store.load().anomalies.where("status = 'acknowledged'").count() == 1


def test_outcomes(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    nc = lines(spark, anomaly_lines())

    def fail(*_):
        raise RuntimeError("no access")

    kinds = [o.kind for o in run_checks(store, [Source("bad", fail, "f"), Source("none", lambda *_: None, "f"), Source("good", lambda *_: nc, "f")], Rules(), NOW)]
    assert kinds == ["error", "ok", "ok"]
    runs = {r.source_id: r for r in store.load().runs.collect()}
    assert "no access" in runs["bad"].message and runs["bad"].fingerprint is None
    assert runs["good"].last_checked_day == date(2026, 9, 28) and runs["none"].last_checked_day is None
    # After an error the next run tries again.
    assert run_check(store, Source("bad", lambda *_: nc, "f"), Rules(), NOW).new_anomalies == 4
    assert run_check(store, Source("good", lambda *_: nc, "f"), Rules(enabled=False), NOW).kind == "disabled"
    assert "lookback_days" in run_check(store, Source("good", lambda *_: nc, "g"), Rules(lookback_days=1), NOW).message
    mixed = nc.withColumn("currency", F.when(F.col("account_id") == "acct-office", "EUR").otherwise("USD"))
    out = run_check(store, Source("good", lambda *_: mixed, "h"), Rules(), NOW)
    assert out.kind == "error" and "several currencies" in out.message
    assert store.load().runs.where("source_id = 'good'").first().last_checked_day == date(2026, 9, 28)


def test_all_sources_are_one_commit(spark, tmp_path):
    """Sources last checked on different days, one without data and one that fails: one commit, and the same
    result as checks one by one."""
    nc = lines(spark, anomaly_lines())
    mixed = nc.withColumn("currency", F.when(F.col("account_id") == "acct-office", "EUR").otherwise("USD"))

    def sources(version):
        return [Source("a", lambda *_: nc, version), Source("bad", lambda *_: mixed, version), Source("none", lambda *_: None, version), Source("c", lambda *_: nc, version)]

    def rows(store):
        state = store.load()
        anomalies = state.anomalies.select("id", "first_day", "last_day", "points", "severity", "status").collect()
        runs = state.runs.select("source_id", "outcome", "last_checked_day", "fingerprint").collect()
        return sorted(anomalies), sorted(map(str, runs))

    together, alone = (StateStore(spark, str(tmp_path / name)) for name in ("together", "alone"))
    for store in (together, alone):
        store.update(lambda s: inbox.record_run(s, "c", NOW, "ok", "old", date(2026, 8, 30)))
    out = run_checks(together, sources("v1"), Rules(), NOW)
    assert [(o.kind, o.checked_from, o.new_anomalies) for o in out] == [("ok", date(2026, 9, 22), 4), ("error", None, 0), ("ok", date(2026, 9, 22), 0), ("ok", date(2026, 8, 31), 4)]
    assert "several currencies" in out[1].message
    assert together.entry().version == 2
    for source in sources("v1"):
        run_check(alone, source, Rules(), NOW)
    assert alone.entry().version == 5 and rows(together) == rows(alone)
    # Nothing changed but that the failed one is tried again: only its rows are written.
    parts = together.entry().parts
    assert [o.kind for o in run_checks(together, sources("v1"), Rules(), NOW + timedelta(hours=1))] == ["unchanged", "error", "unchanged", "unchanged"]
    assert {s for s, p in together.entry().parts.items() if p != parts[s]} == {"bad"}
    with pytest.raises(BadRequest):
        run_checks(together, sources("v1") * 2, Rules(), NOW)


def test_interleaved_checks_keep_both_results(spark, tmp_path):
    """A check of another source is stored while one is at work: both end ok with all findings."""
    nc, path = lines(spark, anomaly_lines()), str(tmp_path / "state")
    inner = []

    def load(*_):
        if not inner:
            inner.append(run_check(StateStore(spark, path), Source("b", lambda *_: nc, "f"), Rules(), NOW))
        return nc

    store = StateStore(spark, path)
    out = run_check(store, Source("a", load, "f"), Rules(), NOW)
    assert [(o.kind, o.new_anomalies) for o in (out, *inner)] == [("ok", 4), ("ok", 4)]
    assert {(r.source_id, r["count"]) for r in store.load().anomalies.groupBy("source_id").count().collect()} == {("a", 4), ("b", 4)}


def test_cost_guard(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    nc = lines(spark, anomaly_lines())
    index = spark.createDataFrame([("f", 0, datetime(2026, 9, 1), datetime(2026, 9, 2), 20_000_000_000, 4)], INDEX_SCHEMA)
    source = Source("s", lambda *_: nc, "f", lambda *_: index, remote=True)
    out = run_check(store, source, Rules(), NOW)
    assert (out.kind, out.estimate_usd) == ("skipped_cost_guard", pytest.approx(1.8, abs=1e-4))
    # The skipped run keeps the old fingerprint, so it does not count as having seen the data.
    assert store.load().runs.first().fingerprint is None
    assert run_check(store, source, Rules(), NOW, automatic=False).kind == "needs_confirmation"
    done = run_check(store, source, Rules(), NOW, automatic=False, confirmed=True)
    assert (done.kind, done.new_anomalies) == ("ok", 4)
    assert run_check(store, Source("t", lambda *_: nc, "f", lambda *_: index), Rules(), NOW).kind == "ok"


def test_source_at_a_location(spark, tmp_path):
    base, store = str(tmp_path / "data"), StateStore(spark, str(tmp_path / "state"))
    assert run_check(store, billing_source(spark, "s", base), Rules(), NOW).kind == "ok"
    write_anomaly_export(spark, base)
    source = billing_source(spark, "s", base, remote=True)
    assert source.index(date(2026, 8, 1), date(2026, 10, 1)).count() == 2
    assert source.load(date(2026, 8, 1), date(2026, 10, 1)).selectExpr("regexp_extract(source_file, '=([^/]+)/', 1)").distinct().count() == 3
    # Only the months around the window are read.
    assert source.load(date(2026, 12, 1), date(2026, 12, 2)) is None
    assert source.load(date(2026, 10, 5), date(2026, 10, 20)).selectExpr("regexp_extract(source_file, '=([^/]+)/', 1)").distinct().count() == 1
    dear = {"egress_usd_per_gb": 1e6}
    assert run_check(store, source, Rules(), NOW, guard=dear).kind == "skipped_cost_guard"
    out = run_check(store, source, Rules(), NOW)
    assert (out.kind, out.new_anomalies) == ("ok", 4) and out.estimate_usd > 0
    assert billing_source(spark, "s", base).fingerprint == source.fingerprint


def test_sources_may_have_different_currencies(spark):
    from billweave.operators.anomalies import detect
    from billweave.operators.series import daily_series
    from billweave.sources.normalise import union_sources

    nc = lines(spark, anomaly_lines())
    both = union_sources({"us": nc, "eu": nc.withColumn("currency", F.lit("EUR"))})
    series = daily_series(both, by=("source_id",))
    rows = detect(series, date(2026, 9, 22), date(2026, 9, 28), by=("source_id",)).collect()
    assert {s: sum(r.source_id == s for r in rows) for s in ("us", "eu")} == {"us": 8, "eu": 8}
    mixed = nc.withColumn("currency", F.when(F.col("account_id") == "acct-office", "EUR").otherwise("USD"))
    with pytest.raises(Exception, match="EUR, USD"):
        daily_series(union_sources({"us": nc, "eu": mixed}), by=("source_id",)).collect()


def series_of(table):
    return {(r.scope_kind, r.scope_key, r.day.isoformat()): r.cost for r in table.read().collect()}


def test_ingest_follows_rewritten_files(spark, tmp_path):
    base, checkpoint = str(tmp_path / "data"), str(tmp_path / "checkpoint")
    write_month(focus_raw(spark, [dict(day="2026-08-10", service_name="EC2", account_id="1", cost=5.0)]), base, "2026-08")
    # A month's folder may hold usage of the month before.
    write_month(focus_raw(spark, [dict(day=d, service_name="EC2", account_id="1", cost=7.0) for d in ("2026-08-10", "2026-09-02")]), base, "2026-09", name="billing_period")
    table = SeriesTable(spark, str(tmp_path / "series"))
    ingest_available(table, base, checkpoint).awaitTermination()
    assert series_of(table)["account", "1", "2026-08-10"] == 12.0 and len(series_of(table)) == 4
    first = table.fingerprint()
    assert table.refresh(base) == [] and table.fingerprint() == first
    write_month(focus_raw(spark, [dict(day="2026-08-10", service_name="EC2", account_id="1", cost=50.0)]), base, "2026-08")
    write_month(focus_raw(spark, [dict(day="2026-10-01", service_name="S3", account_id="1", cost=1.0)]), base, "2026-10")
    assert table.changed_months(base) == ["2026-08", "2026-10"]
    ingest_available(table, base, checkpoint).awaitTermination()
    got = series_of(table)
    assert got["account", "1", "2026-08-10"] == 57.0 and got["service", "S3", "2026-10-01"] == 1.0
    # A month whose lines all stop counting leaves nothing behind.
    write_month(focus_raw(spark, [dict(day="2026-10-01", service_name="S3", account_id="1", cost=1.0, charge_category="Tax")]), base, "2026-10")
    table.refresh(base)
    assert ("service", "S3", "2026-10-01") not in series_of(table)
    assert table.read(date(2026, 9, 1), date(2026, 10, 1)).count() == 2
    kept = series_of(table)
    table.vacuum()
    assert series_of(table) == kept


def test_continuous_check(spark, tmp_path):
    base = str(tmp_path / "data")
    write_anomaly_export(spark, base)
    table, store = SeriesTable(spark, str(tmp_path / "series")), StateStore(spark, str(tmp_path / "state"))
    check_available(table, base, store, "s", Rules(), NOW, str(tmp_path / "checkpoint")).awaitTermination()
    assert found(store) == EXPECTED
    assert check_table(table, store, "s", Rules(), NOW).kind == "unchanged"


def test_a_rewritten_month_is_checked_again(spark, tmp_path):
    base, checkpoint = str(tmp_path / "data"), str(tmp_path / "checkpoint")
    write_anomaly_export(spark, base)
    table, store = SeriesTable(spark, str(tmp_path / "series")), StateStore(spark, str(tmp_path / "state"))
    check_available(table, base, store, "s", Rules(), NOW, checkpoint).awaitTermination()
    # The same file names with other amounts: the stream reports nothing.
    changed = anomaly_lines(render_peak=400.0)
    (old,) = (tmp_path / "data" / "BILLING_PERIOD=2026-09").glob("*.parquet")
    other = tmp_path / "other"
    focus_raw(spark, [r for r in changed if r["day"][:7] == "2026-09"]).coalesce(1).write.parquet(str(other))
    (new,) = other.glob("*.parquet")
    old.write_bytes(new.read_bytes())
    (old.parent / f".{old.name}.crc").unlink(missing_ok=True)
    check_available(table, base, store, "s", Rules(), NOW + timedelta(hours=6), checkpoint).awaitTermination()
    assert ("service", "Render farm", "spike") not in found(store)
    assert table.changed_months(base) == []


def test_a_kept_window_reads_changed_months_only(spark, tmp_path, monkeypatch):
    base, start, end = str(tmp_path / "data"), date(2026, 8, 1), date(2026, 10, 1)
    write_anomaly_export(spark, base)
    # Usage of a window day that is delivered in another month's folder.
    late = [dict(day="2026-09-02", service_name="Mail relay", account_id="acct-office", cost=5.0)]
    write_month(focus_raw(spark, late), base, "2026-10")
    table, window = SeriesTable(spark, str(tmp_path / "series")), SeriesWindow(spark, str(tmp_path / "window"))
    read, rows = [], table.rows
    monkeypatch.setattr(table, "rows", lambda months=None: read.append(months) or rows(months))

    def same(start):
        got = window.series(table, start, end).collect()
        return sorted(got) == sorted(table.read(start, end).collect()) and read.pop() is None

    table.refresh(base)
    assert same(start) and read == [["2026-07", "2026-08", "2026-09", "2026-10"]]
    assert same(start) and len(read) == 1
    # A month is rewritten, one is emptied and a new one comes; the window moves on.
    write_month(focus_raw(spark, [r for r in anomaly_lines(render_peak=400.0) if r["day"][:7] == "2026-09"]), base, "2026-09")
    for f in (tmp_path / "data" / "BILLING_PERIOD=2026-10").iterdir():
        f.unlink()
    write_month(focus_raw(spark, [dict(late[0], cost=7.0)]), base, "2026-11")
    table.refresh(base)
    assert same(date(2026, 8, 20)) and read[1:] == [["2026-09", "2026-10", "2026-11"]]
    days = window.advance(table, date(2026, 8, 20)).select(F.explode("days.day").alias("day"))
    assert days.agg(F.min("day")).first()[0] == date(2026, 8, 20)
    # Nothing changed, but days before those kept are asked for.
    assert same(date(2026, 8, 10)) and read[2:] == [["2026-07", "2026-08", "2026-09", "2026-10", "2026-11"]]
    window.vacuum(keep=1)
    assert same(date(2026, 8, 10)) and len(read) == 3


def test_continuous_check_with_a_kept_window(spark, tmp_path):
    base, checkpoint = str(tmp_path / "data"), str(tmp_path / "checkpoint")
    write_anomaly_export(spark, base)
    table, store = SeriesTable(spark, str(tmp_path / "series")), StateStore(spark, str(tmp_path / "state"))
    window = SeriesWindow(spark, str(tmp_path / "window"))
    check_available(table, base, store, "s", Rules(), NOW, checkpoint, window).awaitTermination()
    assert found(store) == EXPECTED
    write_month(focus_raw(spark, [r for r in anomaly_lines(render_peak=400.0) if r["day"][:7] == "2026-09"]), base, "2026-09")
    check_available(table, base, store, "s", Rules(), NOW + timedelta(hours=6), checkpoint, window).awaitTermination()
    assert ("service", "Render farm", "spike") not in found(store) and ("service", "Vector search", "new_spend") in found(store)


def test_rules_for_another_metric_are_refused(spark, tmp_path):
    table, store = SeriesTable(spark, str(tmp_path / "series")), StateStore(spark, str(tmp_path / "state"))
    with pytest.raises(BadRequest):
        check_table(table, store, "s", Rules(metric=CostMetric.BILLED), NOW)


def test_a_long_gap_is_evaluated_whole(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    nc = lines(spark, anomaly_lines())
    store.update(lambda s: inbox.record_run(s, "s", NOW, "ok", "old", date(2026, 8, 20)))
    out = run_check(store, Source("s", lambda *_: nc, "new"), Rules(), NOW)
    assert (out.kind, out.checked_from) == ("ok", date(2026, 8, 21))


def test_daily_spend_stream_equals_batch_for_settled_days(spark, tmp_path):
    rows = [("a", datetime(2026, 1, d, h), float(d)) for d in range(1, 9) for h in (0, 12, 23)]
    schema = "key string, ts timestamp, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = daily_spend(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts", "key", "value")
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    batch = daily_spend(spark.read.schema(schema).parquet(str(tmp_path / "in")), "ts", "key", "value").collect()
    settled = {r.day: (r.total, r.row_count) for r in batch if r.day <= date(2026, 1, 5)}
    assert {r.day: (r.total, r.row_count) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == settled
    assert len(batch) == 8 and len(settled) == 5
