"""Registered queries: exports on storage, CSV, scan estimates, streams, the whole check pipeline."""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.catalog.anomaly_queries import ISLANDS_CTE, SERIES_CTE, findings_cte, grid_ctes
from billweave.catalog.cost_queries import IN_97, IN_98, PCT, YEAR_97, YEAR_98, compare_cte, nc_for
from billweave.catalog.registry import register
from billweave.catalog.star import SCHEMAS, cur_export, focus_costs, focus_export, present, r2, sql, table
from billweave.model import CostFilter, Dimension
from billweave.operators import footers, insights
from billweave.operators.inbox import inbox
from billweave.operators.predicates import in_range
from billweave.operators.rules import Rules
from billweave.plans.monitor import Source, run_check, run_checks
from billweave.session import RELEASE, scratch_dir, settings, use_utc, written
from billweave.sinks.csv import write_csv
from billweave.sinks.state import StateStore
from billweave.sources import storage
from billweave.sources.exports import load_source
from billweave.sources.file_index import FileIndex, load_indexed
from billweave.sources.footers import listing
from billweave.sources.normalise import CUR_2
from billweave.sources.value_index import ValueIndex, months_loader, search_indexed
from billweave.streaming.daily_spend import daily_spend
from billweave.streaming.ingest import SeriesTable, check_available, ingest_available
from billweave.streaming.window import SeriesWindow


#: A task that has few months writes to their folders side by side, and need not sort its lines.
WRITERS = {"spark.sql.maxConcurrentOutputFileWriters": "64"}


def _write_export(raw: DataFrame, month_column: str, base: str, dealt: bool = False) -> None:
    """One folder per billing month. The rebalance hint splits months too big for one file; ``dealt`` tells that
    each task of ``raw`` has few months already."""
    months = raw.withColumn("BILLING_PERIOD", F.date_format(month_column, "yyyy-MM"))
    if not dealt:
        months = months.hint("rebalance", "BILLING_PERIOD")
    with settings(raw.sparkSession, RELEASE | (WRITERS if dealt else {})):
        months.write.mode("append").partitionBy("BILLING_PERIOD").parquet(base)


def _rewrite_month(raw: DataFrame, base: str, month: str, dealt: bool = False) -> None:
    """Deliver a month anew, in as many files as its size asks for. One task for it would also join all of it;
    ``dealt`` tells that ``raw`` is read from files, by as many tasks as these ask for."""
    with settings(raw.sparkSession, RELEASE):
        (raw if dealt else raw.hint("rebalance")).write.mode("overwrite").parquet(f"{base}/BILLING_PERIOD={month}")


# --- exports on storage ---------------------------------------------------------------------------


def _two_layouts(spark: SparkSession, d: str) -> DataFrame:
    """A source that changed from CUR 2.0 to FOCUS 1.2 at the turn of 1998, read back as one."""
    use_utc(spark)
    base = scratch_dir(spark, "export")
    turn = "timestamp_ntz'1998-01-01'"
    cur = cur_export(spark, d, tags=False)
    _write_export(cur.where(f"line_item_usage_start_date < {turn}"), "bill_billing_period_start_date", base)
    focus = focus_export(spark, d, "1.2", tags=False)
    _write_export(focus.where(f"ChargePeriodStart >= {turn}"), "BillingPeriodStart", base)
    nc = load_source(spark, base, date(1996, 1, 1), date(2001, 1, 1))
    return present(
        nc.groupBy("source_format", F.date_format("billing_period_start", "yyyy-MM").alias("month"))
        .agg(
            F.sum("billed_cost").alias("billed"),
            F.sum("amortized_cost").alias("amortized"),
            F.count("service_name").alias("with_service"),
            F.count("*").alias("row_count"),
        )
    )


register(
    "export_read_back",
    _two_layouts,
    sql(
        f"""SELECT CASE WHEN usage_start < TIMESTAMP '1998-01-01' THEN 'cur2' ELSE 'focus12' END AS source_format,
        strftime(billing_period_start, '%Y-%m') AS month, {r2('sum(billed_cost)')} AS billed,
        {r2('sum(amortized_cost)')} AS amortized, count(service_name) AS with_service, count(*) AS row_count
        FROM nc WHERE usage_start >= TIMESTAMP '1996-01-01' AND usage_start < TIMESTAMP '2001-01-01' GROUP BY 1, 2"""
    ),
)


def _mixed_files(spark: SparkSession, d: str) -> DataFrame:
    """Months whose files differ: CUR 2.0 up to the tenth, then FOCUS 1.2 without a service code, then
    FOCUS 1.2 with decimal costs."""
    use_utc(spark)
    base = scratch_dir(spark, "export")
    cur, focus = cur_export(spark, d, tags=False), focus_export(spark, d, "1.2", tags=False)
    day = F.dayofmonth("ChargePeriodStart")
    decimals = {c: F.col(c).cast("decimal(30,12)") for c in focus.columns if c.endswith("Cost")}
    _write_export(cur.where(F.dayofmonth("line_item_usage_start_date") <= 10), "bill_billing_period_start_date", base)
    _write_export(focus.where((day > 10) & (day <= 20)).drop("x_ServiceCode"), "BillingPeriodStart", base)
    _write_export(focus.where(day > 20).withColumns(decimals), "BillingPeriodStart", base)
    nc = load_source(spark, base)
    return present(
        nc.groupBy("source_format", F.date_format("billing_period_start", "yyyy-MM").alias("month")).agg(
            F.sum("billed_cost").alias("billed"), F.sum("amortized_cost").alias("amortized"), F.count("*").alias("row_count")
        )
    )


register(
    "export_mixed_files",
    _mixed_files,
    sql(
        f"""SELECT CASE WHEN day(usage_start) <= 10 THEN 'cur2' ELSE 'focus12' END AS source_format,
        strftime(billing_period_start, '%Y-%m') AS month, {r2('sum(billed_cost)')} AS billed,
        {r2('sum(amortized_cost)')} AS amortized, count(*) AS row_count FROM nc GROUP BY 1, 2"""
    ),
)


def _csv(spark, d):
    # Keys that a spreadsheet would run as formulas: every resource starts with one of the signs, or with none
    # if its number has more than five digits.
    sign = F.substring(F.lit("=+-@x"), F.length("resource_id") - 5, F.lit(1))
    nc = nc_for(spark, d).withColumn("resource_id", F.concat(sign, "resource_id"))
    path = scratch_dir(spark, "csv")
    write_csv(present(insights.comparison_table(nc, YEAR_98, YEAR_97, Dimension.RESOURCE, 50)), path)
    columns = "dimension string, cost double, previous_cost double, difference double, difference_pct double, total_pct double"
    return spark.read.schema(columns).option("header", True).option("escape", '"').csv(path)


register(
    "csv_export",
    _csv,
    sql(
        f"""SELECT CASE WHEN is_other THEN 'Other' ELSE regexp_replace(key, '^([=+@-])', '''\\1') END AS dimension,
          {r2('current')} AS cost, {r2('previous')} AS previous_cost, {r2('current - previous')} AS difference,
          {PCT} AS difference_pct, {r2('current / (SELECT sum(current) FROM j) * 100', 4)} AS total_pct
        FROM (SELECT rank > 50 AS is_other, CASE WHEN rank <= 50 THEN key END AS key,
            sum(current) AS current, sum(previous) AS previous
          FROM (SELECT *, row_number() OVER (ORDER BY current DESC, key NULLS LAST) AS rank FROM j) GROUP BY ALL)""",
        compare_cte("substr('=+-@x', length(resource_id) - 5, 1) || resource_id", IN_98, IN_97),
    ),
)

# --- scan estimates -------------------------------------------------------------------------------

SCANS = [
    [("1998-01-01", "1998-02-01")],
    [("1997-06-01", "1997-07-01"), ("1997-06-15", "1997-08-01")],
    [("2005-01-01", "2005-02-01")],
]


def _derived_index(spark, d):
    """Row-group statistics as they would be if every month were a file and every return flag a row
    group; two flags' worth of files in one year carry no statistics."""
    rows = table(spark, d, "lineitem")
    month = F.date_format("l_shipdate", "yyyy-MM")
    grouped = rows.groupBy(month.alias("file"), F.col("l_returnflag").alias("row_group")).agg(
        F.min("l_shipdate").alias("lo"),
        F.max("l_shipdate").alias("hi"),
        F.sum("l_quantity").cast("bigint").alias("bytes"),
        F.lit(4).alias("chunks"),
    )
    known = ~(F.startswith("file", F.lit("1999-1")) & (F.col("row_group") == "A"))
    return grouped.select(
        "file", "row_group", F.when(known, F.col("lo")).alias("min_ts"), F.when(known, F.col("hi")).alias("max_ts"), "bytes", "chunks"
    )


INDEX_CTE = """idx AS (SELECT strftime(l_shipdate, '%Y-%m') AS file, l_returnflag AS row_group,
  CASE WHEN NOT (strftime(l_shipdate, '%Y-%m') LIKE '1999-1%' AND l_returnflag = 'A') THEN min(l_shipdate) END AS lo,
  CASE WHEN NOT (strftime(l_shipdate, '%Y-%m') LIKE '1999-1%' AND l_returnflag = 'A') THEN max(l_shipdate) END AS hi,
  CAST(sum(l_quantity) AS BIGINT) AS bytes, 4 AS chunks FROM lineitem GROUP BY 1, 2),
hits AS (SELECT s.scan, idx.*, coalesce(
    (hi >= CAST(s.a AS TIMESTAMP) AND lo < CAST(s.b AS TIMESTAMP))
    OR (hi >= CAST(s.c AS TIMESTAMP) AND lo < CAST(s.d AS TIMESTAMP)), TRUE) AS hit
  FROM idx CROSS JOIN (VALUES (0, '1998-01-01', '1998-02-01', '1998-01-01', '1998-02-01'),
    (1, '1997-06-01', '1997-07-01', '1997-06-15', '1997-08-01'),
    (2, '2005-01-01', '2005-02-01', '2005-01-01', '2005-02-01')) s(scan, a, b, c, d)),
est AS (SELECT scan, coalesce(sum(bytes) FILTER (hit), 0) AS bytes,
    coalesce(sum(chunks) FILTER (hit), 0) + 2 * count(DISTINCT file) FILTER (hit) AS requests,
    count(*) FILTER (hit) AS row_groups, count(DISTINCT file) FILTER (hit) AS files,
    coalesce(bool_or(lo IS NULL) FILTER (hit), FALSE) AS stats_missing
  FROM hits GROUP BY scan)"""

register(
    "scan_estimate",
    lambda spark, d: footers.scan_estimate(_derived_index(spark, d), SCANS),
    f"""WITH {INDEX_CTE} SELECT CAST(scan AS INTEGER) AS scan, CAST(bytes AS BIGINT) AS bytes,
    CAST(requests AS BIGINT) AS requests, row_groups, files, stats_missing FROM est""",
)
register(
    "page_cost",
    lambda spark, d: present(
        footers.page_cost(_derived_index(spark, d), SCANS, spark, guard={"hard_limit_usd": 0.00001, "soft_limit_usd": 0.000001}),
        9,
    ),
    f"""WITH {INDEX_CTE}, t AS (SELECT sum(bytes) AS bytes, sum(requests) AS requests, bool_or(stats_missing) AS stats_missing,
      sum(bytes) / 1e9 * 0.09 + sum(requests) / 1000.0 * 0.0004 AS usd FROM est)
    SELECT TRUE AS remote, TRUE AS known, CAST(bytes AS BIGINT) AS bytes, CAST(requests AS BIGINT) AS requests,
      {r2('usd', 9)} AS usd, CASE WHEN usd >= 0.00001 THEN 'hard' WHEN usd >= 0.000001 THEN 'soft' ELSE 'none' END AS tier,
      stats_missing, {r2('0.000001', 9)} AS soft_limit_usd, {r2('0.00001', 9)} AS hard_limit_usd FROM t""",
)

_LINE_COLUMNS = ["l_shipdate", "l_extendedprice", "l_partkey", "l_linestatus"]


def _written_index(spark, d):
    """The index of real files: one for each month, of many row groups."""
    lines = table(spark, d, "lineitem").select(*_LINE_COLUMNS, F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    base = scratch_dir(spark, "months")
    writer = lines.repartition("month").write.partitionBy("month").option("parquet.block.size", 4096)
    writer.option("parquet.page.row.count.limit", 100).option("parquet.block.row.count.limit", 100).parquet(base)
    months = [e.path for e in storage.list_folder(spark, base) if e.is_dir]
    files = [e.path for m in months for e in storage.list_folder(spark, m) if e.name.endswith(".parquet")]
    return footers.footer_index(spark, files, _LINE_COLUMNS)


def _footers(spark, d):
    index = _written_index(spark, d).withColumn("month", F.regexp_extract("file", "month=([^/]+)/", 1))
    return present(
        index.groupBy("month").agg(
            F.min("min_ts").alias("min_ts"),
            F.max("max_ts").alias("max_ts"),
            F.countDistinct("file").alias("files"),
            (F.sum("chunks") == F.count("*") * len(_LINE_COLUMNS)).alias("all_columns"),
        )
    )


def _stamp(column):
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


register(
    "footer_index",
    _footers,
    f"""SELECT strftime(l_shipdate, '%Y-%m') AS month, {_stamp('min(l_shipdate)')} AS min_ts, {_stamp('max(l_shipdate)')} AS max_ts,
    1::BIGINT AS files, TRUE AS all_columns FROM lineitem GROUP BY 1""",
)
register(
    "scan_estimate_of_files",
    lambda spark, d: footers.scan_estimate(_written_index(spark, d), SCANS).select("scan", "files", "stats_missing"),
    """WITH m AS (SELECT min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY strftime(l_shipdate, '%Y-%m'))
    SELECT scan, count(*) FILTER ((hi >= a::TIMESTAMP AND lo < b::TIMESTAMP) OR (hi >= c::TIMESTAMP AND lo < d::TIMESTAMP)) AS files,
      FALSE AS stats_missing
    FROM m, (VALUES (0, '1998-01-01', '1998-02-01', '1998-01-01', '1998-02-01'),
      (1, '1997-06-01', '1997-07-01', '1997-06-15', '1997-08-01'),
      (2, '2005-01-01', '2005-02-01', '2005-01-01', '2005-02-01')) s(scan, a, b, c, d) GROUP BY scan""",
)
register(
    "data_fingerprint",
    lambda spark, d: footers.data_fingerprint(_derived_index(spark, d)),
    f"""WITH {INDEX_CTE}, h AS (SELECT md5(concat_ws('|', file, row_group, coalesce({_stamp('lo')}, '-'), coalesce({_stamp('hi')}, '-'),
      bytes::VARCHAR, chunks::VARCHAR)) AS h FROM idx)
    SELECT sha256(count(*) || '|' || sum(('0x' || h[1:15])::BIGINT::HUGEINT)::VARCHAR || '|'
      || sum(('0x' || h[16:30])::BIGINT::HUGEINT)::VARCHAR) AS fingerprint FROM h""",
)

# --- the kept file index --------------------------------------------------------------------------


def _two_deliveries(spark, d):
    """An index over two deliveries: the second one rewrites May 1998 and adds all months from July 1998 on. A
    third refresh finds nothing new. ``version`` tells by which refresh a footer was read."""
    use_utc(spark)
    base, month = scratch_dir(spark, "export"), "bill_billing_period_start_date"
    cur = cur_export(spark, d, tags=False)
    later = F.col(month) >= F.lit("1998-07-01").cast("timestamp_ntz")
    _write_export(cur.where(~later), month, base)
    index = FileIndex(spark, scratch_dir(spark, "file-index"))
    index.refresh(base)
    may = cur.where(F.col(month) == F.lit("1998-05-01").cast("timestamp_ntz"))
    _rewrite_month(may, base, "1998-05")
    _write_export(cur.where(later), month, base)
    index.refresh(base)
    rows = index.refresh(base).select("file", "version", F.inline("row_groups"))
    in_month = rows.groupBy(F.regexp_extract("file", "PERIOD=([^/]+)/", 1).alias("month"))
    return present(
        in_month.agg(
            F.min("min_ts").alias("min_ts"),
            F.max("max_ts").alias("max_ts"),
            F.max("chunks").cast("bigint").alias("columns"),
            F.min("version").cast("bigint").alias("version"),
            F.max("version").cast("bigint").alias("last_version"),
        )
    )


register(
    "footer_index_two_deliveries",
    _two_deliveries,
    f"""SELECT month, {_stamp('min(l_shipdate)')} AS min_ts, {_stamp('max(l_shipdate)')} AS max_ts, {len(footers.ESTIMATE_COLUMNS[CUR_2])}::BIGINT AS columns,
      CASE WHEN month = '1998-05' OR month >= '1998-07' THEN 2 ELSE 1 END::BIGINT AS version, version AS last_version
    FROM (SELECT strftime(l_shipdate, '%Y-%m') AS month, l_shipdate FROM lineitem) GROUP BY month""",
)

WANTED = ("1998-06-05", "1998-06-12")


def _indexed(spark, d):
    """Days of a range, from the files that can hold them: each month has three files, by day of the month."""
    use_utc(spark)
    base = scratch_dir(spark, "export")
    cur, day = cur_export(spark, d, tags=False), F.dayofmonth("line_item_usage_start_date")
    for low, high in ((1, 10), (11, 20), (21, 31)):
        _write_export(cur.where(day.between(low, high)), "bill_billing_period_start_date", base)
    start, end = map(date.fromisoformat, WANTED)
    rows = FileIndex(spark, scratch_dir(spark, "file-index")).refresh(base)
    nc = load_indexed(spark, rows, [(start, end)])
    within = nc.where(in_range(CostFilter.between(start, end)))
    by_day = within.groupBy(F.col("usage_start").cast("date").alias("day")).agg(
        F.sum("billed_cost").alias("billed"), F.sum("amortized_cost").alias("amortized"), F.count("*").alias("row_count")
    )
    return present(by_day.withColumn("files_read", F.lit(len(nc.inputFiles())).cast("bigint")))


register(
    "indexed_month_summary",
    _indexed,
    sql(
        f"""SELECT strftime(usage_start, '%Y-%m-%d') AS day, {r2('sum(billed_cost)')} AS billed,
          {r2('sum(amortized_cost)')} AS amortized, count(*) AS row_count, (SELECT count(*) FROM files
            WHERE hi >= TIMESTAMP '{WANTED[0]}' AND lo < TIMESTAMP '{WANTED[1]}') AS files_read
        FROM nc WHERE usage_start >= TIMESTAMP '{WANTED[0]}' AND usage_start < TIMESTAMP '{WANTED[1]}' GROUP BY 1""",
        """files AS (SELECT min(usage_start) AS lo, max(usage_start) AS hi FROM nc
          GROUP BY date_trunc('month', usage_start), least((day(usage_start) - 1) // 10, 2))""",
    ),
)

# --- the kept index of values ---------------------------------------------------------------------


def _values_after_rewrite(spark, d):
    """All values that lines hold after two deliveries. The first one has other services, resources and teams in
    June 1998, which the second one writes anew; it also adds all months from July 1998 on."""
    use_utc(spark)
    base, month = scratch_dir(spark, "export"), "bill_billing_period_start_date"
    cur = cur_export(spark, d, by_month=True)
    june = F.col(month) == F.lit("1998-06-01").cast("timestamp_ntz")
    later = F.col(month) > F.lit("1998-06-01").cast("timestamp_ntz")
    wrong = {c: F.concat(F.lit("wrong "), F.col(c)) for c in ("product_product_name", "line_item_resource_id")}
    wrong["resource_tags"] = F.transform_values("resource_tags", lambda _, v: F.concat(F.lit("wrong "), v))
    _write_export(cur.where(~june & ~later), month, base, dealt=True)
    # June is delivered twice and joined once; its lines are few, so they meet the customers after their orders.
    with settings(spark, RELEASE):
        in_june = written(cur_export(spark, d).where(june).hint("rebalance"), scratch_dir(spark, "june"))
    _write_export(in_june.withColumns(wrong), month, base, dealt=True)
    index = ValueIndex(spark, scratch_dir(spark, "value-index"))
    index.refresh(base)
    _rewrite_month(in_june, base, "1998-06", dealt=True)
    _write_export(cur.where(later), month, base, dealt=True)
    read = len(index.refresh(base))
    return index.counts().withColumnRenamed("n", "lines").withColumn("months_read", F.lit(read).cast("bigint"))


_VALUES = ["service_name", "account_id", "region", "availability_zone", "charge_category", "resource_id"]
_TAGS = {"Segment": "tag_segment", "Priority": "tag_priority", "Team": "tag_team"}
register(
    "distinct_values_after_rewrite",
    _values_after_rewrite,
    sql(
        """SELECT kind, tag_key, value, count(*) AS lines, (SELECT count(DISTINCT billing_period_start) FROM nc
          WHERE billing_period_start >= TIMESTAMP '1998-06-01') AS months_read FROM held GROUP BY ALL""",
        "held AS ("
        + " UNION ALL ".join(
            [f"SELECT '{c}' AS kind, CAST(NULL AS VARCHAR) AS tag_key, {c} AS value FROM nc WHERE {c} IS NOT NULL" for c in _VALUES]
            + [f"SELECT 'tag', '{key}', {c} FROM nc WHERE tag_segment IS NOT NULL" for key, c in _TAGS.items()]
        )
        + ")",
    ),
)

# Trigrams of many ids, of few, none of them, and needles too short for one; one that no id has.
NEEDLES = [" PART-1 ", "rt-19", "t-1999", "7", "99", "part_1"]


def _search_indexed(spark, d):
    use_utc(spark)
    base = scratch_dir(spark, "export")
    cur = cur_export(spark, d, tags=False, by_month=True)
    _write_export(cur, "bill_billing_period_start_date", base, dealt=True)
    index = ValueIndex(spark, scratch_dir(spark, "value-index"))
    index.refresh(base)
    load, out = months_loader(spark, base), None
    for needle in NEEDLES:
        read: list[str] = []

        def remembered(months: list[str], read: list[str] = read) -> DataFrame:
            read += months
            return load(months)

        rows = search_indexed(index, remembered, YEAR_98, needle)
        rows = rows.select(F.lit(needle).alias("needle"), "*", F.lit(len(read)).cast("bigint").alias("months_read"))
        out = rows if out is None else out.unionAll(rows)
    return present(out)


register(
    "resource_search_indexed",
    _search_indexed,
    sql(
        f"""SELECT needle, resource_id, {r2('sum(amortized_cost) FILTER (' + IN_98 + ')')} AS total, any_value(months) AS months_read
        FROM (SELECT *, (SELECT count(DISTINCT billing_period_start) FROM nc h WHERE contains(h.resource_id, n.text)) AS months
          FROM (VALUES {', '.join(f"('{n}', '{n.strip().lower()}')" for n in NEEDLES)}) n(needle, text)) w
        JOIN nc ON contains(resource_id, w.text) GROUP BY needle, resource_id HAVING count(*) FILTER ({IN_98}) > 0"""
    ),
)

# --- manifests ------------------------------------------------------------------------------------


def _manifests(spark, d):
    """Months by their number modulo 5: without a manifest, with one that names files of the folder, of a
    subfolder, of another place, and with one that cannot be parsed. Files that a manifest does not name are
    in every month: each month is also delivered a second time, without costs that count."""
    use_utc(spark)
    base, far = scratch_dir(spark, "export"), scratch_dir(spark, "elsewhere")
    cur, start = cur_export(spark, d, tags=False, by_month=True), "bill_billing_period_start_date"
    kind = F.month(start) % 5
    _write_export(cur.where(kind.isin(0, 1, 4)), start, base, dealt=True)
    months = cur.where(kind == 2).withColumn("BILLING_PERIOD", F.date_format(start, "yyyy-MM"))
    months.withColumn("run", F.lit("a b")).write.mode("append").partitionBy("BILLING_PERIOD", "run").parquet(base)
    _write_export(cur.where(kind == 3), start, far, dealt=True)
    before = [(r.folder, r.path) for r in listing(spark, [base, far]).collect()]
    # What is delivered again is read back, months together as files have them, and not joined a second time.
    first = spark.read.schema(cur.schema).option("recursiveFileLookup", True).parquet(base, far)
    stale = first.where(kind != 0).withColumn("line_item_line_item_type", F.lit("Stale"))
    # A file holds one month: a task writes to as many folders as it reads files.
    _write_export(stale, start, base, dealt=True)
    named: dict[str, list[str]] = {}
    for folder, path in before:
        month = path[len(folder) + 1 :].split("/")[0]
        inside = f"{base}/{month}/"
        named.setdefault(month, []).append(path.removeprefix(inside))
    for month, files in sorted(named.items()):
        number = int(month[-2:]) % 5
        if number:
            text = "{not json" if number == 4 else json.dumps({"dataFiles": sorted(files)})
            storage.create_marker(spark, f"{base}/{month}/Manifest.json", text)
    nc = load_source(spark, base)
    by_month = nc.groupBy(F.date_format("billing_period_start", "yyyy-MM").alias("month"))
    return present(by_month.agg(F.sum("billed_cost").alias("billed"), F.sum("amortized_cost").alias("amortized"), F.count("*").alias("row_count")))


register(
    "export_manifests",
    _manifests,
    sql(
        f"""SELECT strftime(billing_period_start, '%Y-%m') AS month, {r2('sum(billed_cost)')} AS billed,
        {r2('sum(amortized_cost)')} AS amortized, count(*) AS row_count FROM nc
        WHERE month(billing_period_start) % 5 <> 4 GROUP BY 1"""
    ),
)

# --- streams --------------------------------------------------------------------------------------


def _event_stream(spark, d):
    use_utc(spark)
    # The stream source takes a folder or a pattern.
    events = spark.readStream.schema(SCHEMAS["events"]).parquet(f"{d}/events*.parquet")
    folder = scratch_dir(spark, "stream")
    query = (
        daily_spend(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value")
        .writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{folder}/out")
    )
    query.awaitTermination()
    return present(spark.read.schema("key string, day date, total double, row_count bigint").parquet(f"{folder}/out"))


register(
    "stream_daily_spend",
    _event_stream,
    f"""SELECT event_type AS key, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, {r2('sum(value)')} AS total,
    count(*) AS row_count FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) GROUP BY ALL""",
)
register(
    "batch_daily_spend",
    lambda spark, d: present(
        daily_spend(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value")
    ),
    f"""SELECT event_type AS key, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, {r2('sum(value)')} AS total,
    count(*) AS row_count FROM events GROUP BY ALL""",
)


def _ingested(spark, d):
    use_utc(spark)
    base = scratch_dir(spark, "arriving")
    _write_export(cur_export(spark, d, tags=False), "bill_billing_period_start_date", base)
    series = SeriesTable(spark, scratch_dir(spark, "series"))
    ingest_available(series, base, scratch_dir(spark, "ingest-checkpoint")).awaitTermination()
    return present(series.read())


register(
    "stream_billing_ingest",
    _ingested,
    sql(f"SELECT scope_kind, scope_key, strftime(day, '%Y-%m-%d') AS day, {r2('cost')} AS cost FROM series", SERIES_CTE),
)

def _rewritten(spark, d):
    """Two deliveries: the second one rewrites June 1998, delivered without costs at first, in place."""
    use_utc(spark)
    base = scratch_dir(spark, "arriving")
    cur, month = cur_export(spark, d, tags=False), "bill_billing_period_start_date"
    june = F.col(month) == F.lit("1998-06-01").cast("timestamp_ntz")
    money = [f.name for f in cur.schema if f.dataType.simpleString() == "double" and f.name.endswith(("cost", "commitment", "fee"))]
    first = cur.withColumns({c: F.when(~june, F.col(c)) for c in money})
    _write_export(first, month, base)
    series, checkpoint = SeriesTable(spark, scratch_dir(spark, "series")), scratch_dir(spark, "ingest-checkpoint")
    ingest_available(series, base, checkpoint).awaitTermination()
    cur.where(june).write.mode("overwrite").parquet(f"{base}/BILLING_PERIOD=1998-06")
    ingest_available(series, base, checkpoint).awaitTermination()
    return present(series.read())


register(
    "stream_rewritten_month",
    _rewritten,
    sql(f"SELECT scope_kind, scope_key, strftime(day, '%Y-%m-%d') AS day, {r2('cost')} AS cost FROM series", SERIES_CTE),
)

# --- the check pipeline ---------------------------------------------------------------------------

CHECK_DAY = datetime(2000, 10, 1, 6)


RUN_DAYS = (CHECK_DAY - timedelta(days=7), CHECK_DAY)


def _billed_by(nc: DataFrame, now: datetime) -> DataFrame:
    return nc.where(F.col("usage_start") < F.lit(f"{now:%Y-%m-%d}").cast("timestamp_ntz"))


def _inbox_rows(store: StateStore, sources: list[str]) -> DataFrame:
    rows = inbox(store.load(), sources, CHECK_DAY.date())
    return rows.select("id", "kind", "first_day", "last_day", F.size("points").cast("bigint").alias("points"), "total_impact", "severity", "status")


def _check(spark, d):
    """Two runs a week apart over the whole table; the second one re-evaluates settled days."""
    nc = nc_for(spark, d, Dimension.SERVICE, Dimension.ACCOUNT).withColumn("amortized_cost", F.round("amortized_cost", 2))
    store = StateStore(spark, scratch_dir(spark, "state"))
    for now in RUN_DAYS:
        run_check(store, Source("star", lambda *_, now=now: _billed_by(nc, now), f"{now}"), Rules(min_delta_pct=0.5), now)
    return present(_inbox_rows(store, ["star"]))


def _check_all(spark, d):
    """The same runs over four sources at once: two layouts with a currency of their own, one without data, and
    one that the second run finds unchanged. Each run is one commit."""
    cur = nc_for(spark, d, Dimension.SERVICE, Dimension.ACCOUNT)
    focus = focus_costs(spark, d, "1.2", tags=False).withColumn("currency", F.lit("EUR"))
    tables = {"cur": cur, "focus": focus, "still": cur}
    tables = {name: nc.withColumn("amortized_cost", F.round("amortized_cost", 2)) for name, nc in tables.items()}
    store = StateStore(spark, scratch_dir(spark, "state"))
    for now in RUN_DAYS:
        sources = [Source("none", lambda *_: None, f"{now}")]
        for name, nc in tables.items():
            sources.append(Source(name, lambda *_, nc=nc, now=now: _billed_by(nc, now), "same" if name == "still" else f"{now}"))
        kinds = [o.kind for o in run_checks(store, sources, Rules(min_delta_pct=0.5), now)]
    runs = store.load().runs.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "source_id", "outcome"))), ",").alias("runs"))
    counted = _inbox_rows(store, [*tables, "none"]).withColumn("runs", runs.scalar())
    return present(counted.withColumns({"commits": F.lit(store.entry().version), "last": F.lit(",".join(kinds))}))


def _check_sql(source: str | None = None, newest: datetime = CHECK_DAY, more: str = "", oldest: str = "2000-09-15"):
    rules = Rules(min_delta_pct=0.5)
    # The runs evaluate adjoining days, from the first one's start to the newest day with data minus 2.
    within = (
        f"day >= DATE '{oldest}' AND day <= (SELECT max(day) - 2 FROM series WHERE day < DATE '{newest:%Y-%m-%d}')"
    )
    grid = grid_ctes(rules.lookback_days, rules.memory_days)
    named = "id" if source is None else f"'{source}' || substr(id, 5) AS id"
    return sql(
        f"""SELECT {named}, kind, strftime(first_day, '%Y-%m-%d') AS first_day, strftime(last_day, '%Y-%m-%d') AS last_day,
        points, {r2('total_impact')} AS total_impact,
        CASE rank WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, 'open' AS status{more} FROM merged""",
        *grid,
        findings_cte(rules).replace("WHERE kind IS NOT NULL", f"WHERE kind IS NOT NULL AND {within}"),
        ISLANDS_CTE,
    )


register("check_two_runs", _check, _check_sql())

_RUNS = ", 'cur=ok,focus=ok,none=ok,still=ok' AS runs, 2 AS commits, 'ok,ok,ok,unchanged' AS last"
register(
    "check_all_sources",
    _check_all,
    " UNION ALL ".join(
        f"SELECT * FROM ({_check_sql(name, newest, _RUNS)})"
        for name, newest in (("cur", CHECK_DAY), ("focus", CHECK_DAY), ("still", RUN_DAYS[0]))
    ),
)


# The second run comes two days after the first and evaluates all but two of its days again.
STREAM_DAYS = (datetime(2000, 9, 28, 6), datetime(2000, 9, 30, 6))
WRONG_DAYS = (date(2000, 9, 21), date(2000, 9, 25))


def _continuous(spark, d):
    """A continuous check over two deliveries. The first one charges some days of September a second time, to a
    service and an account that there are not; the second one rewrites the month, and what was found on them is
    taken back. ``before`` tells of how many such series findings were open after the first check, ``months``
    how many months' series the second one read."""
    use_utc(spark)
    base, month = scratch_dir(spark, "arriving"), "bill_billing_period_start_date"
    cur, usage = cur_export(spark, d, tags=False), F.col("line_item_usage_start_date")
    september = F.col(month) == F.lit("2000-09-01").cast("timestamp_ntz")
    nowhere = {c: F.lit("nowhere") for c in ("product_product_name", "line_item_usage_account_id")}

    def until(now: datetime) -> DataFrame:
        return cur.where(usage < F.lit(f"{now:%Y-%m-%d}").cast("timestamp_ntz"))

    twice = cur.where(usage.cast("date").between(*WRONG_DAYS)).withColumns(nowhere)
    _write_export(until(STREAM_DAYS[0]).unionByName(twice), month, base)
    table, window = SeriesTable(spark, scratch_dir(spark, "series")), SeriesWindow(spark, scratch_dir(spark, "window"))
    store, checkpoint = StateStore(spark, scratch_dir(spark, "state")), scratch_dir(spark, "ingest-checkpoint")
    rules = Rules(min_delta_pct=0.5)
    check_available(table, base, store, "star", rules, STREAM_DAYS[0], checkpoint, window).awaitTermination()
    first = window.entry()["months"]
    is_open = (F.col("scope_key") == "nowhere") & (F.col("status") == "open")
    before = store.load().anomalies.where(is_open).select("scope_kind").distinct().count()
    _rewrite_month(until(STREAM_DAYS[1]).where(september), base, "2000-09")
    check_available(table, base, store, "star", rules, STREAM_DAYS[1], checkpoint, window).awaitTermination()
    read = sum(first.get(m) != stamp for m, stamp in window.entry()["months"].items())
    rows = _inbox_rows(store, ["star"])
    return present(rows.withColumns({"before": F.lit(before).cast("bigint"), "months": F.lit(read).cast("bigint")}))


register(
    "continuous_check_two_deliveries",
    _continuous,
    _check_sql(None, STREAM_DAYS[1], ", 2::BIGINT AS before, 1::BIGINT AS months", "2000-09-19"),
)
