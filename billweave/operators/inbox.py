"""The anomaly inbox: findings merged into anomalies across runs.

State is three tables (anomalies, mutes, runs). Every operation is DataFrame -> DataFrame; the state
sink stores the result as the next snapshot. Work is keyed by (source, scope, direction). A key holds
few rows: findings are one per day and anomalies are kept for 90 days.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from billweave.functions.scalars import instant, severity_name, severity_rank
from billweave.model import BadRequest

# Days without a finding that an anomaly may bridge; days a closed anomaly is kept;
# longest mute.
MAX_GAP_DAYS = 2
RETENTION_DAYS = 90
MAX_MUTE_DAYS = 365

SERIES = ["source_id", "scope_kind", "scope_key"]
KEYS = [*SERIES, "direction"]
POINT = "struct<day:date,expected:double,actual:double,severity:string>"
ANOMALY_SCHEMA = (
    "id string, source_id string, scope_kind string, scope_key string, kind string, direction string, "
    f"first_day date, last_day date, points array<{POINT}>, total_impact double, severity string, status string, "
    "escalated boolean, muted boolean, detected_at timestamp, updated_at timestamp, position int"
)
MUTE_SCHEMA = "source_id string, scope_kind string, scope_key string, until date"
RUN_SCHEMA = (
    "source_id string, fingerprint string, last_checked_day date, last_run_at timestamp, outcome string, "
    "message string, estimate_usd double"
)
# What the fold below carries per anomaly.
_CARRIED = (
    f"struct<id:string,kind:string,points:array<{POINT}>,first_day:date,last_day:date,worst:int,status:string,"
    "escalated:boolean,detected_at:timestamp,updated_at:timestamp>"
)


@dataclass(frozen=True)
class InboxState:
    anomalies: DataFrame
    mutes: DataFrame
    runs: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> InboxState:
        return cls(*[spark.createDataFrame([], s) for s in (ANOMALY_SCHEMA, MUTE_SCHEMA, RUN_SCHEMA)])


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _first_day(points: Column) -> Column:
    return F.array_min(F.transform(points, lambda p: p["day"]))


def _last_day(points: Column) -> Column:
    return F.array_max(F.transform(points, lambda p: p["day"]))


def _worst(points: Column) -> Column:
    return F.array_max(F.transform(points, lambda p: severity_rank(p["severity"])))


def _carry(a: Column, points: Column, **changes: Column) -> Column:
    """``a`` with other points and what follows from them; ``points`` must be a bound value."""
    derived = {
        "points": points,
        "first_day": _first_day(points),
        "last_day": _last_day(points),
        "worst": _worst(points),
        **changes,
    }
    names = [field.split(":")[0] for field in _CARRIED.replace(POINT, "p")[7:-1].split(",")]
    return F.struct(*[derived.get(n, a[n]).alias(n) for n in names]).cast(_CARRIED)


def _absorb(a: Column, finding: Column, now: Column) -> Column:
    """One finding added to an anomaly; a point of the same day is replaced. An acknowledged anomaly
    whose severity rises through it opens again as escalated."""
    others = F.filter(a["points"], lambda p: p["day"] != finding["day"])

    def absorbed(points):
        rises = (a["status"] == "acknowledged") & (_worst(points) > a["worst"])
        status = F.when(rises, "open").otherwise(a["status"])
        return _carry(a, points, status=status, escalated=a["escalated"] | rises, updated_at=now)

    return _let(F.array_sort(F.concat(others, F.array(finding["point"]))), absorbed)


def _founded(finding: Column, id_prefix: Column, now: Column) -> Column:
    day = finding["day"]
    return F.struct(
        F.concat(id_prefix, F.date_format(day, "yyyy-MM-dd")),
        finding["kind"],
        F.array(finding["point"]),
        day,
        day,
        severity_rank(finding["point"]["severity"]),
        F.lit("open"),
        F.lit(False),
        now,
        now,
    ).cast(_CARRIED)


def _merge_one(anomalies: Column, finding: Column, id_prefix: Column, now: Column) -> Column:
    """The list of anomalies after one finding: it joins the first one within reach, or starts one."""
    reach = MAX_GAP_DAYS + 1
    in_reach = F.transform(
        anomalies,
        lambda a: (finding["day"] >= F.date_sub(a["first_day"], reach))
        & (finding["day"] <= F.date_add(a["last_day"], reach)),
    )

    def merged(at):  # 1-based position, 0 for none
        joined = F.concat(
            F.slice(anomalies, F.lit(1), at - 1),
            F.array(_absorb(F.get(anomalies, at - 1), finding, now)),
            F.slice(anomalies, at + 1, F.size(anomalies)),
        )
        founded = F.concat(anomalies, F.array(_founded(finding, id_prefix, now)))
        return F.when(at > 0, joined).otherwise(founded)

    return _let(F.array_position(in_reach, F.lit(True)).cast("int"), merged)


def _keep_fired(a: Column, fired: Column, checked_from: Column, checked_to: Column, now: Column) -> Column:
    """Points of an open anomaly inside the checked range stay only if they fired again."""
    kept = F.filter(
        a["points"],
        lambda p: (p["day"] < checked_from) | (p["day"] > checked_to) | F.array_contains(fired, p["day"]),
    )

    def retracted(points):
        changed = F.size(points) != F.size(a["points"])
        return _carry(a, points, updated_at=F.when(changed, now).otherwise(a["updated_at"]))

    return F.when(a["status"] == "open", _let(kept, retracted)).otherwise(a)


def _islands(findings: DataFrame) -> DataFrame:
    """Findings of a key that lie within reach of each other, as the anomaly that they would found:
    first_day, last_day, kind, points, worst, total_impact and ``findings``, one for each day. Of several
    findings for a day the last one by kind and values counts."""
    point = F.struct("day", "expected", "actual", "severity").cast(POINT).alias("point")
    days = findings.groupBy(*KEYS, "day").agg(F.max(F.struct("kind", point)).alias("f")).select(*KEYS, "day", "f.kind", "f.point")
    in_order = Window.partitionBy(*KEYS).orderBy("day")
    gap = F.datediff("day", F.lag("day").over(in_order))
    begins = F.coalesce(gap > MAX_GAP_DAYS + 1, F.lit(True)).cast("int")
    numbered = days.withColumn("begins", begins).withColumn("island", F.sum("begins").over(in_order))
    return numbered.groupBy(*KEYS, "island").agg(
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.min_by("kind", "day").alias("kind"),
        F.array_sort(F.collect_list("point")).alias("points"),
        F.max(severity_rank(F.col("point.severity"))).alias("worst"),
        F.sum(F.col("point.actual") - F.col("point.expected")).alias("total_impact"),
        F.array_sort(F.collect_list(F.struct("day", "kind", "point"))).alias("findings"),
    )


Checked = tuple[date, date] | dict[str, tuple[date, date]]


def _by_source(checked: Checked, at: int, sources: list[str] | None) -> Column:
    """The first or last checked day for a row's source; NULL where the source was not checked."""
    if isinstance(checked, dict):
        entries = [x for s, span in checked.items() for x in (F.lit(s), F.lit(span[at]))]
        return F.try_element_at(F.create_map(*entries), F.col("source_id")) if entries else F.lit(None).cast("date")
    day = F.lit(checked[at])
    return day if sources is None else F.when(F.col("source_id").isin(sources), day)


def merge_run(
    anomalies: DataFrame,
    findings: DataFrame,
    now: datetime,
    checked: Checked | None = None,
    sources: list[str] | None = None,
) -> DataFrame:
    """Retract, then merge the findings of one run over one or more sources.

    ``findings`` has source_id and the detector's columns. With ``checked`` (inclusive, for all of ``sources``
    or by source), points of open anomalies in that range that did not fire again are dropped; an open
    anomaly left without points disappears. Findings join an anomaly of the same key within three days of it,
    in day order; the rest start new ones.

    Findings are first put into islands, by the gaps between their days. An island that no known anomaly
    is within reach of is a new anomaly as it stands. Only the others are folded into what is known: no
    anomaly can grow into the reach of an island that is out of reach of the findings it grows by.
    """
    stamp = instant(now)
    reach = MAX_GAP_DAYS + 1
    islands = _islands(findings)
    spans = anomalies.select(*[F.col(k).alias(f"of_{k}") for k in KEYS], F.col("first_day").alias("known_from"), F.col("last_day").alias("known_to"))
    same_key = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in KEYS]
    touches = (F.col("first_day") <= F.date_add("known_to", reach)) & (F.col("last_day") >= F.date_sub("known_from", reach))
    near = islands.join(spans, [*same_key, touches], "left_semi")
    far = islands.join(spans, [*same_key, touches], "left_anti")

    fresh = near.groupBy(*KEYS).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first_day", "findings"))), lambda i: i["findings"])).alias("findings"))
    worst = severity_rank(F.col("severity")).alias("worst")
    carried = F.struct(
        "id", "kind", "points", "first_day", "last_day", worst, "status", "escalated", "detected_at", "updated_at"
    )
    known = anomalies.groupBy(*KEYS).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("position", carried.cast(_CARRIED).alias("a")))), lambda e: e["a"]
        ).alias("known")
    )
    # Islands near an anomaly have its key.
    both = known.join(fresh, KEYS, "left").select(
        *KEYS,
        "known",
        F.coalesce("findings", F.array().cast(fresh.schema["findings"].dataType)).alias("findings"),
        F.concat_ws(":", *KEYS, F.lit("")).alias("id_prefix"),
    )
    if checked is not None:
        fired = F.transform("findings", lambda f: f["day"])
        both = both.withColumns({"lo": _by_source(checked, 0, sources), "hi": _by_source(checked, 1, sources)})
        kept = F.filter(
            F.transform("known", lambda a: _keep_fired(a, fired, F.col("lo"), F.col("hi"), stamp)), lambda a: F.size(a["points"]) > 0
        )
        both = both.withColumn("known", F.when(F.col("lo").isNotNull(), kept).otherwise(F.col("known"))).drop("lo", "hi")
    merged = both.select(
        *KEYS,
        F.size("known").alias("n_known"),
        F.posexplode(
            F.aggregate("findings", F.col("known"), lambda acc, f: _merge_one(acc, f, F.col("id_prefix"), stamp))
        ).alias("position", "a"),
    )
    joined = merged.select(
        *KEYS,
        F.when(F.col("position") < F.col("n_known"), F.col("position")).alias("place"),
        "a.*",
        F.aggregate("a.points", F.lit(0.0), lambda s, p: s + (p["actual"] - p["expected"])).alias("total_impact"),
    )
    founded = far.select(
        *KEYS,
        F.lit(None).cast("int").alias("place"),
        F.concat_ws(":", *KEYS, F.date_format("first_day", "yyyy-MM-dd")).alias("id"),
        "kind",
        "points",
        "first_day",
        "last_day",
        "worst",
        F.lit("open").alias("status"),
        F.lit(False).alias("escalated"),
        stamp.alias("detected_at"),
        stamp.alias("updated_at"),
        "total_impact",
    )
    # Known ones keep their order, new ones follow by day.
    order = Window.partitionBy(*KEYS).orderBy(F.col("place").asc_nulls_last(), "first_day")
    given = {
        "severity": severity_name(F.col("worst")),
        "muted": F.lit(False),
        "position": F.row_number().over(order) - 1,
    }
    columns = [c.split(" ")[0] for c in ANOMALY_SCHEMA.replace(POINT, "p").split(", ")]
    return joined.unionByName(founded).select(*[given.get(c, F.col(c)).alias(c) for c in columns])


def apply_mutes(state: InboxState, today: date) -> InboxState:
    """Drop expired mutes; an anomaly is muted while a live mute names its series."""
    live = state.mutes.where(F.col("until") >= F.lit(today))
    flags = live.select(*SERIES, F.lit(True).alias("is_muted")).distinct()
    anomalies = (
        state.anomalies.drop("muted")
        .join(flags, SERIES, "left")
        .withColumn("muted", F.coalesce("is_muted", F.lit(False)))
        .select(*state.anomalies.columns)
    )
    return replace(state, anomalies=anomalies, mutes=live)


def prune(state: InboxState, today: date, keep_days: int | None = RETENTION_DAYS) -> InboxState:
    """Without anomalies whose last day is more than ``keep_days`` ago; None keeps all."""
    if keep_days is None:
        return state
    cutoff = today - timedelta(days=keep_days)
    return replace(state, anomalies=state.anomalies.where(F.col("last_day") >= F.lit(cutoff)))


@dataclass(frozen=True)
class Run:
    """What is recorded of a check of one source. ``checked`` are the days that were evaluated (inclusive)
    if the check was completed."""

    source_id: str
    outcome: str
    fingerprint: str | None = None
    last_checked_day: date | None = None
    message: str | None = None
    estimate_usd: float | None = None
    checked: tuple[date, date] | None = None


def record_runs(state: InboxState, runs: list[Run], now: datetime) -> InboxState:
    """Replace the runs of these sources; a source's last checked day never moves back."""
    spark = state.runs.sparkSession
    values = [(r.source_id, r.fingerprint, r.last_checked_day, r.outcome, r.message, r.estimate_usd) for r in runs]
    schema = ", ".join(c for c in RUN_SCHEMA.split(", ") if not c.startswith("last_run_at"))
    rows = spark.createDataFrame(values, schema).withColumn("last_run_at", instant(now))
    ours = F.col("source_id").isin([r.source_id for r in runs])
    before = state.runs.where(ours).select("source_id", F.col("last_checked_day").alias("before"))
    new = rows.join(before, "source_id", "left").withColumn("last_checked_day", F.greatest("last_checked_day", "before"))
    return replace(state, runs=state.runs.where(~ours).unionByName(new.select(*state.runs.columns)))


def record_run(
    state: InboxState,
    source_id: str,
    now: datetime,
    outcome: str,
    fingerprint: str | None = None,
    last_checked_day: date | None = None,
    message: str | None = None,
    estimate_usd: float | None = None,
) -> InboxState:
    """Replace the source's run; its last checked day never moves back."""
    return record_runs(state, [Run(source_id, outcome, fingerprint, last_checked_day, message, estimate_usd)], now)


def apply_runs(state: InboxState, runs: list[Run], findings: DataFrame, today: date, now: datetime) -> InboxState:
    """The effect of checks of several sources: retract, merge, record the runs, apply mutes. ``findings`` has
    a source_id; those of sources without a completed check are not expected."""
    done = {r.source_id: r.checked for r in runs if r.checked is not None}
    mine = F.col("source_id").isin(list(done))
    merged = merge_run(state.anomalies.where(mine), findings, now, done)
    state = replace(state, anomalies=state.anomalies.where(~mine).unionByName(merged))
    return apply_mutes(record_runs(state, runs, now), today)


def apply_run(
    state: InboxState,
    source_id: str,
    checked: tuple[date, date] | None,
    findings: DataFrame,
    today: date,
    now: datetime,
    **run,
) -> InboxState:
    """One check's effect: retract, merge, record the run, apply mutes."""
    tagged = findings.select(F.lit(source_id).alias("source_id"), *[c for c in findings.columns if c != "source_id"])
    mine = state.anomalies.where(F.col("source_id") == source_id)
    others = state.anomalies.where(F.col("source_id") != source_id)
    merged = merge_run(mine, tagged, now, checked)
    state = replace(state, anomalies=others.unionByName(merged))
    return apply_mutes(record_run(state, source_id, now, "ok", **run), today)


def acknowledge(state: InboxState, anomaly_id: str, now: datetime) -> InboxState:
    hit = F.col("id") == anomaly_id
    if state.anomalies.where(hit).isEmpty():
        raise KeyError(f"unknown anomaly '{anomaly_id}'")
    changed = {
        "status": F.when(hit, "acknowledged").otherwise(F.col("status")),
        "escalated": ~hit & F.col("escalated"),
        "updated_at": F.when(hit, instant(now)).otherwise(F.col("updated_at")),
    }
    return replace(state, anomalies=state.anomalies.withColumns(changed))


def mute(state: InboxState, source_id: str, scope_kind: str, scope_key: str, days: int, today: date) -> InboxState:
    """Mute one series of a source for ``days`` days including today, replacing its earlier mute."""
    if not 1 <= days <= MAX_MUTE_DAYS:
        raise BadRequest(f"days must be between 1 and {MAX_MUTE_DAYS}")
    source_id, scope_key = source_id.strip(), scope_key.strip()
    if not source_id or not scope_key:
        raise BadRequest("source_id and scope_key are required")
    row = (source_id, scope_kind, scope_key, today + timedelta(days=days - 1))
    added = state.mutes.sparkSession.createDataFrame([row], MUTE_SCHEMA)
    mutes = state.mutes.join(added.select(*SERIES), SERIES, "left_anti").unionByName(added)
    return apply_mutes(replace(state, mutes=mutes), today)


def forget_source(state: InboxState, source_id: str) -> InboxState:
    keep = F.col("source_id") != source_id
    return InboxState(state.anomalies.where(keep), state.mutes.where(keep), state.runs.where(keep))


def inbox(state: InboxState, source_ids: list[str], today: date, show_all: bool = True) -> DataFrame:
    """Anomalies of the configured sources, most severe and then most recent first.

    ``show_all=False`` leaves only those that are open and not muted.
    """
    rows = apply_mutes(state, today).anomalies.where(F.col("source_id").isin(source_ids))
    if not show_all:
        rows = rows.where(is_visible())
    return rows.orderBy(F.desc(severity_rank(F.col("severity"))), F.desc("last_day"), "id")


def is_visible() -> Column:
    return (F.col("status") == "open") & ~F.col("muted")


def open_count(state: InboxState, source_ids: list[str], today: date) -> int:
    return inbox(state, source_ids, today, show_all=False).count()
