"""The anomaly check: one run over any number of sources, from the data fingerprint to the stored inbox."""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.functions.periods import month_range
from billweave.functions.scalars import instant
from billweave.model import BadRequest
from billweave.operators import inbox
from billweave.operators.anomalies import detect
from billweave.operators.footers import ESTIMATE_COLUMNS, footer_index, page_cost
from billweave.operators.rules import Rules
from billweave.operators.series import daily_series
from billweave.session import scratch_dir, written
from billweave.sinks.state import StateStore
from billweave.sources import exports, storage
from billweave.sources.file_index import FileIndex, load_indexed, row_group_index

log = logging.getLogger(__name__)

# Settled days that each check looks at again; days read before those that are needed.
RECHECK_DAYS = 7
READ_SLACK_DAYS = 2
MONTH = timedelta(days=31)


@dataclass(frozen=True)
class CheckWindow:
    query_start: date
    query_end: date  # exclusive
    check_from: date


def check_window(today: date, last_checked: date | None, rules: Rules, longest: int | None = None) -> CheckWindow:
    """What a check reads and the first day it evaluates. The last day follows from the data.

    All days since the last check are evaluated, however many; ``longest`` bounds them where a caller
    wants only the newest."""
    latest = today - timedelta(days=1 + rules.settling_days)
    recent = latest - timedelta(days=RECHECK_DAYS - 1)
    check_from = recent
    if last_checked is not None:
        check_from = min(last_checked + timedelta(days=1), recent)
    if longest is not None:
        check_from = max(check_from, latest - timedelta(days=longest - 1))
    reach = rules.memory_days + READ_SLACK_DAYS
    return CheckWindow(check_from - timedelta(days=reach), today + timedelta(days=1), check_from)


@dataclass(frozen=True)
class Source:
    """A billing source as a check sees it. ``load`` is called only when data must be read, with the range of
    days to read; None from it means that the source has no files yet. It may return more than the range.
    ``series`` replaces the scan of the cost table where daily series are already kept. ``index`` is called
    only for an estimate."""

    source_id: str
    load: Callable[[date, date], DataFrame | None]
    fingerprint: str
    index: Callable[[date, date], DataFrame | None] | None = None
    remote: bool = False
    series: Callable[[date, date], DataFrame] | None = None


def billing_source(
    spark: SparkSession, source_id: str, base: str, remote: bool = False, kept_index: str | None = None
) -> Source:
    """A source at a storage location. Making it reads no more than listings, which an unchanged
    source needs; footers are read for the months of a check's window only.

    ``kept_index`` names a folder for an index of the files: a check then reads the footers of new and
    rewritten files only, and scans only files that can hold days of its window."""
    resolved = exports.resolve(spark, base)
    prints = sorted(exports.fingerprints_of(resolved).items())

    def months(start: date, end: date) -> list[exports.PeriodFiles]:
        wanted = set(month_range(start, end))
        return [p for p in resolved if p.readable and p.month in wanted]

    def kept(start: date, end: date) -> DataFrame:
        return FileIndex(spark, kept_index).refresh(base, start - MONTH, end + MONTH)

    def index(start: date, end: date) -> DataFrame | None:
        if kept_index is not None:
            return row_group_index(kept(start, end))
        out = None
        for x in exports.layouts(spark, months(start, end)):
            part = footer_index(spark, list(x.files), ESTIMATE_COLUMNS[exports.detect_format(x.columns)])
            out = part if out is None else out.unionByName(part)
        return out

    def load(start: date, end: date) -> DataFrame | None:
        # Usage may be delivered in the folder of the month before or after its own.
        if kept_index is not None:
            return load_indexed(spark, kept(start, end), [(start, end)]) if resolved else None
        periods = months(start - MONTH, end + MONTH)
        return exports.read_periods(spark, periods) if any(p.files for p in periods) else None

    return Source(
        source_id,
        load,
        hashlib.sha256(repr(prints).encode()).hexdigest(),
        index,
        remote,
    )


@dataclass(frozen=True)
class Outcome:
    """``kind``: ok, unchanged, disabled, skipped_cost_guard, needs_confirmation or error."""

    source_id: str
    kind: str
    checked_from: date | None = None
    checked_to: date | None = None
    new_anomalies: int = 0
    estimate_usd: float | None = None
    message: str | None = None


@dataclass(frozen=True)
class _Due:
    """A source whose check has to be carried out."""

    source: Source
    window: CheckWindow
    fingerprint: str
    usd: float | None


def run_check(store: StateStore, source: Source, rules: Rules, now: datetime, **options) -> Outcome:
    """Check one source and store the result; see ``run_checks``."""
    return run_checks(store, [source], rules, now, **options)[0]


def run_checks(
    store: StateStore,
    sources: list[Source],
    rules: Rules,
    now: datetime,
    automatic: bool = True,
    confirmed: bool = False,
    guard: dict | None = None,
) -> list[Outcome]:
    """Check sources and store the results, all of them in one commit.

    An automatic check is skipped when neither data nor rules changed since the last completed run,
    or when the scan would cost more than the guard's hard limit; after an error it is tried again.
    A manual check always runs, above the hard limit only when confirmed. The sources that have to be
    checked are evaluated by the same jobs. If these fail, each source is evaluated for itself: a failing
    one is recorded and does not stop the others.
    """
    ids = [s.source_id for s in sources]
    if len(set(ids)) < len(ids):
        raise BadRequest("two sources with one id")
    if not rules.enabled:
        return [Outcome(i, "disabled") for i in ids]
    previous = {r.source_id: r for r in store.load(ids).runs.collect()}
    outcomes: dict[str, Outcome] = {}
    runs: list[inbox.Run] = []
    due: list[_Due] = []

    def failed(source_id: str, error: Exception, usd: float | None = None) -> None:
        log.warning("check of %s failed: %s", source_id, error)
        seen, last = _seen(previous.get(source_id))
        runs.append(inbox.Run(source_id, "error", seen, last, str(error), usd))
        outcomes[source_id] = Outcome(source_id, "error", message=str(error))

    for source in sources:
        try:
            step = _gate(store.spark, source, previous.get(source.source_id), rules, now.date(), automatic, confirmed, guard)
        except Exception as error:  # one failing source must not stop the others
            failed(source.source_id, error)
            continue
        if isinstance(step, _Due):
            due.append(step)
            continue
        outcomes[source.source_id] = step
        if step.kind == "skipped_cost_guard":
            # The old fingerprint stays, so the check runs once the scan is affordable.
            seen, last = _seen(previous.get(source.source_id))
            runs.append(inbox.Run(source.source_id, step.kind, seen, last, None, step.estimate_usd))
    scratch = scratch_dir(store.spark, "check")
    try:
        found, series = [], {}
        groups = [due] if due else []
        while groups:
            group = groups.pop()
            try:
                findings, spans = _evaluate(store.spark, group, rules, f"{scratch}/{len(series)}-{len(groups)}")
            except Exception as error:
                if len(group) > 1:
                    groups += [[d] for d in group]
                else:
                    failed(group[0].source.source_id, error, group[0].usd)
                continue
            found.append(findings)
            series |= spans
            for d in group:
                # Without a settled day nothing is retracted either.
                to = spans[d.source.source_id]
                checked = (d.window.check_from, to or d.window.check_from - timedelta(days=1))
                runs.append(inbox.Run(d.source.source_id, "ok", d.fingerprint, to, None, d.usd, checked))
        if runs:
            _store(store, runs, found, now, outcomes)
    finally:
        # The stored rows do not depend on it any more.
        storage.delete_folder(store.spark, scratch)
    return [outcomes[i] for i in ids]


def _seen(previous) -> tuple[str | None, date | None]:
    return (previous.fingerprint, previous.last_checked_day) if previous else (None, None)


def _gate(spark, source: Source, previous, rules, today, automatic, confirmed, guard) -> Outcome | _Due:
    """Whether a source has to be checked: what to read, or the outcome without a check."""
    sid = source.source_id
    seen, last_checked = _seen(previous)
    rules.validate()
    fingerprint = f"{source.fingerprint}:{rules.fingerprint()}"
    completed = previous is not None and previous.outcome in ("ok", "skipped_cost_guard")
    if automatic and completed and seen == fingerprint:
        return Outcome(sid, "unchanged")
    window, usd = check_window(today, last_checked, rules), None
    estimate = _estimate(spark, source, window, guard)
    if estimate is not None:
        usd = estimate.usd if estimate.remote and estimate.known else None
        if estimate.tier == "hard" and automatic:
            return Outcome(sid, "skipped_cost_guard", estimate_usd=estimate.usd)
        if estimate.tier == "hard" and not confirmed:
            return Outcome(sid, "needs_confirmation", estimate_usd=estimate.usd)
    return _Due(source, window, fingerprint, usd)


def _estimate(spark, source: Source, window: CheckWindow, guard: dict | None):
    """An estimate that cannot be made never blocks a check."""
    if source.index is None:
        return None
    try:
        index = source.index(window.query_start, window.query_end)
        scans = [[(window.query_start, window.query_end)]]
        return page_cost(index, scans, spark, source.remote, guard).first()
    except BadRequest as error:
        log.warning("no estimate for %s: %s", source.source_id, error)
        return None


def _evaluate(spark: SparkSession, due: list[_Due], rules: Rules, scratch: str) -> tuple[DataFrame, dict[str, date | None]]:
    """The findings of several sources, and each source's last settled day. Daily series are written out
    once: they are small (series x days) and read for that day and again for the detection."""
    frames = []
    for d in due:
        span = (d.window.query_start, d.window.query_end)
        if d.source.series is not None:
            series = d.source.series(*span)
        else:
            nc = d.source.load(*span)
            series = daily_series(nc, *span, rules.metric) if nc is not None else None
        if series is not None:
            frames.append(series.select(F.lit(d.source.source_id).alias("source_id"), "scope_kind", "scope_key", "day", "cost"))
    settled: dict[str, date | None] = {d.source.source_id: None for d in due}
    findings = detect_nothing(spark)
    if not frames:
        return findings, settled
    series = written(reduce(DataFrame.unionAll, frames), f"{scratch}/series")
    for r in series.groupBy("source_id").agg(F.max("day").alias("day")).collect():
        settled[r.source_id] = r.day - timedelta(days=rules.settling_days) if r.day else None
    # Sources that were last checked on the same day, most of them, share a detection.
    by_start: dict[date, dict[str, date]] = {}
    for d in due:
        to = settled[d.source.source_id]
        if to is not None and to >= d.window.check_from:
            by_start.setdefault(d.window.check_from, {})[d.source.source_id] = to
    found = []
    for check_from, ends in by_start.items():
        to = F.try_element_at(F.create_map(*[F.lit(x) for pair in ends.items() for x in pair]), F.col("source_id"))
        found.append(detect(series.where(F.col("source_id").isin(list(ends))), check_from, to, rules, by=("source_id",)))
    if found:
        findings = written(reduce(DataFrame.unionAll, found), f"{scratch}/findings")
    return findings, settled


def _store(store: StateStore, runs: list[inbox.Run], found: list[DataFrame], now: datetime, outcomes: dict[str, Outcome]) -> None:
    """Commit the runs and findings, and add the outcomes of completed checks."""
    findings = reduce(DataFrame.unionAll, found, detect_nothing(store.spark))
    today = now.date()
    ids = [r.source_id for r in runs]
    state = store.update(lambda s: inbox.prune(inbox.apply_runs(s, runs, findings, today, now), today), ids)
    fresh = state.anomalies.where(F.col("detected_at") == instant(now)).groupBy("source_id").count()
    created = {r["source_id"]: r["count"] for r in fresh.collect()}
    for r in runs:
        if r.checked is not None:
            n = created.get(r.source_id, 0)
            outcomes[r.source_id] = Outcome(r.source_id, "ok", r.checked[0], r.last_checked_day, n, r.estimate_usd)


def detect_nothing(spark) -> DataFrame:
    schema = (
        "source_id string, scope_kind string, scope_key string, day date, expected double, actual double, delta double, "
        "kind string, direction string, severity string"
    )
    return spark.createDataFrame([], schema)
