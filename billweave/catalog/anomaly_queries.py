"""Registered queries: daily series, anomaly statistics and findings, the inbox over all history."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from billweave.catalog.cost_queries import nc_for
from billweave.catalog.registry import register
from billweave.catalog.star import END_DAY, FIRST_DAY, focus_costs, present, r2, sql
from billweave.model import Dimension
from billweave.operators import anomalies, inbox
from billweave.operators.rules import OVERRIDABLE, Override, Rules, resolve_rules
from billweave.operators.series import daily_series
from billweave.session import scratch_dir, written
from billweave.sources.normalise import union_sources

START, END = date.fromisoformat(FIRST_DAY), date.fromisoformat(END_DAY)
FROM_DAY = date(1995, 4, 1)
NOW = datetime(2002, 1, 1)
LATER = NOW + timedelta(days=1)
SETTLING = 2


def star_series(spark, d):
    """Daily cost with cents made exact, so that every later comparison sees the same numbers."""
    nc = nc_for(spark, d, Dimension.SERVICE, Dimension.ACCOUNT)
    return daily_series(nc, START, END).withColumn("cost", F.round("cost", 2))


SERIES_CTE = """series AS (
  SELECT scope_kind, scope_key, day, round(sum(cost), 2) AS cost FROM (
    SELECT 'service' AS scope_kind, coalesce(service_name, '(none)') AS scope_key,
      CAST(usage_start AS DATE) AS day, amortized_cost AS cost FROM nc WHERE charge_category IN ('Usage', 'Discount')
    UNION ALL
    SELECT 'account', coalesce(account_id, '(none)'), CAST(usage_start AS DATE), amortized_cost
    FROM nc WHERE charge_category IN ('Usage', 'Discount'))
  GROUP BY scope_kind, scope_key, day)"""


def grid_ctes(lookback: int, memory: int) -> list[str]:
    """Every series and evaluated day joined with the days before it, one row per offset."""
    return [
        SERIES_CTE,
        f"""cand AS (SELECT scope_kind, scope_key, CAST(unnest(generate_series(TIMESTAMP '{FROM_DAY}',
            (SELECT CAST(max(day) - {SETTLING} AS TIMESTAMP) FROM series), INTERVAL 1 DAY)) AS DATE) AS day
          FROM (SELECT DISTINCT scope_kind, scope_key FROM series))""",
        f"""grid AS (SELECT c.scope_kind, c.scope_key, c.day, o.off, coalesce(s.cost, 0) AS c,
            s.cost IS NOT NULL AS present, s.cost AS raw
          FROM cand c CROSS JOIN (SELECT unnest(generate_series(0, {memory})) AS off) o
          LEFT JOIN series s ON s.scope_kind = c.scope_kind AND s.scope_key = c.scope_key AND s.day = c.day - CAST(off AS INTEGER))""",
        f"""base AS (SELECT scope_kind, scope_key, day,
            max(c) FILTER (off = 0) AS actual,
            count(*) FILTER (present AND off BETWEEN 1 AND {lookback}) AS history,
            median(c) FILTER (off BETWEEN 1 AND {lookback}) AS base,
            sum(c) FILTER (off >= 1) AS prior_total,
            greatest(0, max(c) FILTER (off >= 1)) AS largest,
            max(raw) FILTER (abs(date_diff('day', CAST(day - INTERVAL 1 MONTH AS DATE), CAST(day - CAST(off AS INTEGER) AS DATE))) <= 1) AS echo
          FROM grid GROUP BY scope_kind, scope_key, day)""",
        f"""factors AS (SELECT g.scope_kind, g.scope_key, g.day, g.off % 7 AS weekday,
            least(greatest(median(g.c) / any_value(b.base), 0.2), 5.0) AS factor
          FROM grid g JOIN base b USING (scope_kind, scope_key, day)
          WHERE g.off BETWEEN 1 AND {lookback} AND b.history >= 14 AND b.base > 0
          GROUP BY g.scope_kind, g.scope_key, g.day, g.off % 7)""",
        f"""mads AS (SELECT g.scope_kind, g.scope_key, g.day, median(abs(g.c - b.base * f.factor)) AS mad
          FROM grid g JOIN base b USING (scope_kind, scope_key, day)
          JOIN factors f ON f.scope_kind = g.scope_kind AND f.scope_key = g.scope_key AND f.day = g.day
            AND f.weekday = g.off % 7
          WHERE g.off BETWEEN 1 AND {lookback} GROUP BY g.scope_kind, g.scope_key, g.day)""",
        """stats AS (SELECT b.*, f.factor IS NOT NULL AS has_base, f.factor, b.base * f.factor AS expected,
            greatest(1.4826 * m.mad, 0.05 * b.base * f.factor) AS spread
          FROM base b
          LEFT JOIN factors f ON f.scope_kind = b.scope_kind AND f.scope_key = b.scope_key AND f.day = b.day AND f.weekday = 0
          LEFT JOIN mads m ON m.scope_kind = b.scope_kind AND m.scope_key = b.scope_key AND m.day = b.day)""",
    ]


def findings_cte(rules: Rules) -> str:
    def pick(name):
        cases = [
            f"WHEN scope_kind = '{o.scope_kind}' AND scope_key = '{o.scope_key.strip()}' THEN {getattr(o, name)}"
            for o in rules.overrides
            if getattr(o, name) is not None
        ]
        value = getattr(rules, name)
        return f"CASE {' '.join(cases)} ELSE {value} END" if cases else f"{value}"

    columns = ", ".join(f"{pick(n)} AS {n}" for n in OVERRIDABLE)
    return f"""found AS (
      SELECT *, CASE WHEN kind = 'drop' THEN 'down' ELSE 'up' END AS direction,
        CASE WHEN abs(delta) * 30 >= severity_high_usd THEN 'high'
          WHEN abs(delta) * 30 >= severity_medium_usd THEN 'medium' ELSE 'low' END AS severity
      FROM (SELECT *, CASE WHEN has_base THEN expected WHEN kind = 'new_spend' THEN 0 ELSE largest END AS exp2,
          actual - exp2 AS delta
        FROM (SELECT *, CASE
            WHEN has_base THEN CASE WHEN abs(actual - expected) > 0
              AND abs(actual - expected) >= mad_multiplier * spread AND abs(actual - expected) >= min_delta_usd
              AND abs(actual - expected) / expected >= min_delta_pct
              AND abs(actual - expected) * 30 >= min_monthly_impact_usd
              THEN CASE WHEN actual > expected THEN 'spike' WHEN include_drops THEN 'drop' END END
            WHEN actual > 0 AND actual >= min_delta_usd AND actual * 30 >= min_monthly_impact_usd
              AND prior_total < greatest(min_delta_usd, 0.01) THEN 'new_spend'
            WHEN largest > 0 AND actual - largest >= min_delta_usd AND (actual - largest) / largest >= min_delta_pct
              AND (actual - largest) * 30 >= min_monthly_impact_usd THEN 'spike' END AS kind
          FROM (SELECT *, {columns} FROM stats)))
      WHERE kind IS NOT NULL
        AND (kind = 'drop' OR NOT coalesce(echo > 0 AND echo >= (1 - min_delta_pct) * actual, FALSE)))"""


FINDING_COLUMNS = (
    f"scope_kind, scope_key, strftime(day, '%Y-%m-%d') AS day, {r2('exp2')} AS expected, {r2('actual')} AS actual, "
    f"{r2('delta')} AS delta, kind, direction, severity"
)

register(
    "daily_series",
    lambda spark, d: present(star_series(spark, d)),
    sql(f"SELECT scope_kind, scope_key, strftime(day, '%Y-%m-%d') AS day, {r2('cost')} AS cost FROM series", SERIES_CTE),
)


def _statistics(spark, d):
    series = star_series(spark, d)
    to = anomalies.last_settled_day(series, SETTLING)
    rules = Rules()
    days = anomalies.baselines(
        anomalies.day_windows(series, FROM_DAY, to, rules.memory_days), rules.lookback_days, rules.memory_days
    )
    shown = days.select(
        "scope_kind",
        "scope_key",
        "day",
        "actual",
        F.col("history").cast("bigint").alias("history"),
        "base",
        "has_base",
        "factor",
        F.col("expected"),
        "spread",
        "prior_total",
        "largest",
        "echo",
    )
    return present(shown, 4)


def _round(*names):
    return ", ".join(f"{r2(n, 4)} AS {n}" for n in names)


register(
    "anomaly_statistics",
    _statistics,
    sql(
        "SELECT scope_kind, scope_key, strftime(day, '%Y-%m-%d') AS day, history, has_base, "
        + _round("actual", "base", "factor", "expected", "spread", "prior_total", "largest", "echo")
        + " FROM stats",
        *grid_ctes(28, 35),
    ),
)

RULE_SETS = {
    "default": Rules(),
    "drops_lookback_60": Rules(lookback_days=60, include_drops=True, min_delta_pct=0.1, mad_multiplier=2.0),
    "floors_lookback_14": Rules(lookback_days=14, min_monthly_impact_usd=300_000.0, severity_high_usd=1e6, severity_medium_usd=5e5),
    "overrides": Rules(
        overrides=(
            Override("service", " ECONOMY ", include_drops=True, mad_multiplier=1.0),
            Override("account", "NATION_4", min_delta_usd=40_000.0),
            Override("account", "NATION_9", severity_medium_usd=1e6, severity_high_usd=2e6, min_delta_pct=1.5),
        )
    ),
}


def _findings(spark, d, rules):
    series = star_series(spark, d)
    return anomalies.detect(series, FROM_DAY, anomalies.last_settled_day(series, SETTLING), rules)


for _name, _rules in RULE_SETS.items():
    register(
        f"anomalies_{_name}",
        lambda spark, d, rules=_rules.validate(): present(_findings(spark, d, rules)),
        sql(
            f"SELECT {FINDING_COLUMNS} FROM found",
            *grid_ctes(_rules.lookback_days, _rules.memory_days),
            findings_cte(_rules),
        ),
    )


def _all_sources(spark, d):
    # One job over every source: a currency and a set of series per source.
    sources = {
        "cur": nc_for(spark, d, Dimension.SERVICE, Dimension.ACCOUNT),
        "focus": focus_costs(spark, d, "1.2", tags=False).withColumn("currency", F.lit("EUR")),
    }
    series = daily_series(union_sources(sources), START, END, by=("source_id",)).withColumn("cost", F.round("cost", 2))
    to = anomalies.last_settled_day(series, SETTLING)
    return anomalies.detect(series, FROM_DAY, to, Rules(), by=("source_id",))


register(
    "anomalies_all_sources",
    lambda spark, d: present(_all_sources(spark, d)),
    sql(
        f"SELECT source_id, {FINDING_COLUMNS} FROM found CROSS JOIN (VALUES ('cur'), ('focus')) s(source_id)",
        *grid_ctes(28, 35),
        findings_cte(Rules()),
    ),
)


def _resolved(spark, d):
    series = star_series(spark, d).groupBy("scope_kind", "scope_key").agg(F.count("*").alias("days"))
    return present(resolve_rules(series, RULE_SETS["overrides"]))


register(
    "rule_overrides",
    _resolved,
    sql(
        """SELECT scope_kind, scope_key, count(*) AS days,
        CAST(CASE WHEN scope_key = 'ECONOMY' THEN 1.0 ELSE 3.0 END AS DOUBLE) AS mad_multiplier,
        CAST(CASE WHEN scope_key = 'NATION_4' THEN 40000 ELSE 20 END AS DOUBLE) AS min_delta_usd,
        CAST(CASE WHEN scope_key = 'NATION_9' THEN 1.5 ELSE 0.25 END AS DOUBLE) AS min_delta_pct,
        CAST(0 AS DOUBLE) AS min_monthly_impact_usd, scope_key = 'ECONOMY' AS include_drops,
        CAST(CASE WHEN scope_key = 'NATION_9' THEN 1000000 ELSE 500 END AS DOUBLE) AS severity_medium_usd,
        CAST(CASE WHEN scope_key = 'NATION_9' THEN 2000000 ELSE 2000 END AS DOUBLE) AS severity_high_usd
        FROM series GROUP BY scope_kind, scope_key""",
        SERIES_CTE,
    ),
)

# --- inbox ----------------------------------------------------------------------------------------


def _inbox_rows(rows):
    return present(
        rows.select(
            "id",
            "scope_kind",
            "scope_key",
            "kind",
            "direction",
            "first_day",
            "last_day",
            F.size("points").cast("bigint").alias("points"),
            "total_impact",
            "severity",
            "status",
            "muted",
        )
    )


def _merged(spark, d):
    found = _findings(spark, d, RULE_SETS["drops_lookback_60"])
    tagged = found.select(F.lit("star").alias("source_id"), "*")
    return inbox.merge_run(inbox.InboxState.empty(spark).anomalies, tagged, NOW)


ISLANDS_CTE = """islands AS (
  SELECT *, sum(CASE WHEN gap IS NULL OR gap > 3 THEN 1 ELSE 0 END)
    OVER (PARTITION BY scope_kind, scope_key, direction ORDER BY day) AS island
  FROM (SELECT *, date_diff('day', lag(day) OVER (PARTITION BY scope_kind, scope_key, direction ORDER BY day), day) AS gap
    FROM found)),
merged AS (
  SELECT 'star:' || scope_kind || ':' || scope_key || ':' || direction || ':' || strftime(min(day), '%Y-%m-%d') AS id,
    scope_kind, scope_key, arg_min(kind, day) AS kind, direction, min(day) AS first_day, max(day) AS last_day,
    count(*) AS points, sum(actual - exp2) AS total_impact,
    max(CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS rank
  FROM islands GROUP BY scope_kind, scope_key, direction, island)"""


def _merged_sql(muted="FALSE", where="TRUE", more=""):
    rules = RULE_SETS["drops_lookback_60"]
    return sql(
        f"""SELECT id, scope_kind, scope_key, kind, direction, strftime(first_day, '%Y-%m-%d') AS first_day,
        strftime(last_day, '%Y-%m-%d') AS last_day, points, {r2('total_impact')} AS total_impact,
        CASE rank WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, 'open' AS status,
        {muted} AS muted{more} FROM merged WHERE {where}""",
        *grid_ctes(rules.lookback_days, rules.memory_days),
        findings_cte(rules),
        ISLANDS_CTE,
    )


register("inbox_merge", lambda spark, d: _inbox_rows(_merged(spark, d)), _merged_sql())


def _sources(spark, d):
    """Three sources with the same findings: one is configured, one is no longer, one is forgotten. The
    position shows the order of the list."""
    found = _findings(spark, d, RULE_SETS["drops_lookback_60"])
    names = F.explode(F.array(*map(F.lit, ("star", "orphan", "gone"))))
    state = inbox.InboxState.empty(spark)
    state = inbox.InboxState(inbox.merge_run(state.anomalies, found.select(names.alias("source_id"), "*"), NOW), state.mutes, state.runs)
    state = inbox.forget_source(state, "gone")
    kept = state.anomalies.groupBy().agg(F.sort_array(F.collect_set("source_id")).alias("sources"))
    listed = _inbox_rows(inbox.inbox(state, ["star"], NOW.date()).coalesce(1)).withColumn("position", F.monotonically_increasing_id())
    return listed.withColumn("sources", F.array_join(kept.scalar(), ","))


register(
    "inbox_sources",
    _sources,
    _merged_sql(more=", row_number() OVER (ORDER BY rank DESC, last_day DESC, id) - 1 AS position, 'orphan,star' AS sources"),
)


def _retracted(spark, d):
    # A second run over the same days that finds only the large ones again.
    found = written(_findings(spark, d, RULE_SETS["drops_lookback_60"]), scratch_dir(spark, "findings"))
    tagged = found.select(F.lit("star").alias("source_id"), "*")
    first = inbox.merge_run(inbox.InboxState.empty(spark).anomalies, tagged, NOW)
    again = tagged.where("abs(delta) >= 30000")
    return _inbox_rows(inbox.merge_run(first, again, NOW, checked=(START, END), sources=["star"]))


def _retracted_sql():
    rules = RULE_SETS["drops_lookback_60"]
    return sql(
        f"""SELECT 'star:' || scope_kind || ':' || scope_key || ':' || direction || ':' || strftime(min(day), '%Y-%m-%d') AS id,
        scope_kind, scope_key, arg_min(kind, day) AS kind, direction,
        strftime(min(day) FILTER (abs(delta) >= 30000), '%Y-%m-%d') AS first_day,
        strftime(max(day) FILTER (abs(delta) >= 30000), '%Y-%m-%d') AS last_day,
        count(*) FILTER (abs(delta) >= 30000) AS points,
        {r2("sum(actual - exp2) FILTER (abs(delta) >= 30000)")} AS total_impact,
        'high' AS severity, 'open' AS status, FALSE AS muted
        FROM islands GROUP BY scope_kind, scope_key, direction, island HAVING count(*) FILTER (abs(delta) >= 30000) > 0""",
        *grid_ctes(rules.lookback_days, rules.memory_days),
        findings_cte(rules),
        ISLANDS_CTE,
    )


register("inbox_retraction", _retracted, _retracted_sql())


def _visible(spark, d):
    # Mute one account, prune what is older than the retention, keep what the default view shows.
    today = date(2001, 11, 15)
    state = inbox.InboxState.empty(spark)
    state = inbox.InboxState(_merged(spark, d), state.mutes, state.runs)
    state = inbox.mute(state, "star", "account", "NATION_3", 30, today)
    state = inbox.mute(state, "star", "service", "LARGE", 30, date(2001, 9, 1))  # expired by then
    state = inbox.prune(state, today)
    return _inbox_rows(inbox.inbox(state, ["star"], today, show_all=False))


register(
    "inbox_visible",
    _visible,
    _merged_sql(where="last_day >= DATE '2001-08-17' AND NOT (scope_kind = 'account' AND scope_key = 'NATION_3')"),
)


ACKNOWLEDGED = 3


def _escalated(spark, d):
    """The first check sees accounts' findings as low ones; the first few anomalies of each kind of series are
    acknowledged then. The second check gives all findings their severity: acknowledged anomalies that rise by
    it open again as escalated. It comes with an earlier last day, which does not move the history back."""
    rules, today = RULE_SETS["floors_lookback_14"], NOW.date()
    found = written(_findings(spark, d, rules), scratch_dir(spark, "findings"))
    low = F.when(F.col("scope_kind") == "account", "low").otherwise(F.col("severity"))
    first = inbox.apply_run(
        inbox.InboxState.empty(spark), "star", (START, END), found.withColumn("severity", low), today, NOW, fingerprint="a", last_checked_day=END
    )
    folder = scratch_dir(spark, "state")
    state = inbox.InboxState(
        *[written(t, f"{folder}/{name}") for name, t in (("a", first.anomalies), ("m", first.mutes), ("r", first.runs))]
    )
    for kind in ("account", "service"):
        ids = state.anomalies.where(F.col("scope_kind") == kind).orderBy("id").select("id").limit(ACKNOWLEDGED)
        for row in ids.collect():
            state = inbox.acknowledge(state, row.id, NOW)
    state = inbox.apply_run(state, "star", (START, END), found, today, LATER, fingerprint="b", last_checked_day=START)
    runs = state.runs.select("source_id", "last_checked_day", "outcome", "fingerprint", "last_run_at")
    listed = state.anomalies.join(runs, "source_id")
    columns = ["id", "severity", "status", "escalated", "last_checked_day", "outcome", "fingerprint", "last_run_at"]
    return present(listed.select(*columns))


def _escalated_sql():
    rules = RULE_SETS["floors_lookback_14"]
    return sql(
        f"""SELECT id, CASE rank WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity,
        CASE WHEN place > {ACKNOWLEDGED} OR rises THEN 'open' ELSE 'acknowledged' END AS status,
        place <= {ACKNOWLEDGED} AND rises AS escalated, '{END:%Y-%m-%d}' AS last_checked_day, 'ok' AS outcome, 'b' AS fingerprint,
        '{LATER:%Y-%m-%d %H:%M:%S}' AS last_run_at
        FROM (SELECT *, row_number() OVER (PARTITION BY scope_kind ORDER BY id) AS place,
          scope_kind = 'account' AND rank > 0 AS rises FROM merged)""",
        *grid_ctes(rules.lookback_days, rules.memory_days),
        findings_cte(rules),
        ISLANDS_CTE,
    )


register("inbox_escalation", _escalated, _escalated_sql())
