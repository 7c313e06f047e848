"""The storage queries on tables whose keys, months or files the given ones do not have."""

import re
import time
from pathlib import Path

import duckdb
import pytest

from billweave.catalog import QUERIES, storage_queries
from billweave.catalog.star import cur_export

from .test_catalog import TABLES, rows

# Part numbers of six and seven digits beside short ones; four years of days.
STAR = {
    "region": "SELECT i::INT AS r_regionkey, 'R' || i AS r_name FROM range(2) t(i)",
    "nation": "SELECT i::INT AS n_nationkey, 'N' || i AS n_name, (i % 2)::INT AS n_regionkey FROM range(4) t(i)",
    "customer": """SELECT i AS c_custkey, 'C' || i AS c_name, (i % 4)::INT AS c_nationkey, 1.0::DOUBLE AS c_acctbal,
      'M' || i % 3 AS c_mktsegment FROM range(20) t(i)""",
    "supplier": "SELECT i AS s_suppkey, 'S' || i AS s_name FROM range(5) t(i)",
    "part": """SELECT k AS p_partkey, 'P' || k AS p_name, 'B' || k % 3 AS p_brand, CASE WHEN k % 2 = 0 THEN 'PROMO' ELSE 'STD' END
      AS p_type, 1::INT AS p_size, 2.0::DOUBLE AS p_retailprice FROM (VALUES (7), (77), (19999), (123456), (199901), (1234567)) t(k)""",
    "orders": """SELECT i AS o_orderkey, i % 20 AS o_custkey, 'O' AS o_orderstatus, 1.0::DOUBLE AS o_totalprice,
      TIMESTAMP '1997-01-01' AS o_orderdate, '1-' || i % 2 AS o_orderpriority FROM range(100) t(i)""",
    "lineitem": """SELECT i % 100 AS l_orderkey, [7, 77, 19999, 123456, 199901, 1234567][i % 6 + 1] AS l_partkey, i % 5 AS l_suppkey,
      (i % 7)::INT AS l_linenumber, (1 + i % 50)::DOUBLE AS l_quantity, (100 + i % 997)::DOUBLE AS l_extendedprice,
      0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, ['A', 'N', 'R'][i % 3 + 1] AS l_returnflag,
      ['F', 'O'][i % 2 + 1] AS l_linestatus, TIMESTAMP '1997-01-01' + INTERVAL 1 DAY * (i % 1400) AS l_shipdate FROM range(4000) t(i)""",
    "events": "SELECT i AS event_id, TIMESTAMP '1997-01-01' AS ts, i AS user_id, 'e' AS event_type, 1.0::DOUBLE AS value, '' AS props FROM range(3) t(i)",
}


@pytest.fixture(scope="module")
def star(tmp_path_factory):
    folder, con = tmp_path_factory.mktemp("star"), duckdb.connect()
    for name in TABLES:
        con.execute(f"COPY ({STAR[name]}) TO '{folder}/{name}.parquet' (FORMAT PARQUET)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return str(folder), con


def same(df, name, con):
    cursor = con.execute(QUERIES[name].sql)
    assert rows(df.collect(), df.columns) == rows(cursor.fetchall(), [c[0] for c in cursor.description])


def test_csv_export_of_long_part_numbers(spark, star):
    folder, con = star
    same(QUERIES["csv_export"].run(spark, folder), "csv_export", con)


REWRITES = {
    "footer_index_two_deliveries": "1998-05",
    "distinct_values_after_rewrite": "1998-06",
    "continuous_check_two_deliveries": "2000-09",
}


@pytest.mark.parametrize("name", REWRITES)
def test_a_rewritten_month_is_written_by_several_tasks(spark, star, tmp_path, monkeypatch, name):
    folder, con = star
    monkeypatch.setattr(storage_queries, "scratch_dir", lambda _, purpose: f"{tmp_path}/{purpose}")
    # So that small partitions stay apart, as large ones do.
    merged = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merged, "false")
    try:
        df = QUERIES[name].run(spark, folder)
        if name != "continuous_check_two_deliveries":  # its SQL is about the days of the given tables
            same(df, name, con)
    finally:
        spark.conf.set(merged, "true")
    assert len(list(Path(tmp_path).glob(f"*/BILLING_PERIOD={REWRITES[name]}/*.parquet"))) > 1


def test_a_second_delivery_is_read_back(spark, star, monkeypatch):
    folder, con = star
    read = []
    original = storage_queries._write_export
    monkeypatch.setattr(storage_queries, "_write_export", lambda raw, *a, **k: read.append(raw.inputFiles()) or original(raw, *a, **k))
    same(QUERIES["export_manifests"].run(spark, folder), "export_manifests", con)
    assert any(folder in f for f in read[0]) and read[-1] and not any(folder in f for f in read[-1])


def test_deliveries_are_dealt_out_before_their_columns_are_made(spark, star, monkeypatch):
    folder, con = star
    dealt, rewritten = [], []
    write, rewrite = storage_queries._write_export, storage_queries._rewrite_month
    monkeypatch.setattr(storage_queries, "_write_export", lambda raw, *a, **k: dealt.append(k.get("dealt")) or write(raw, *a, **k))
    monkeypatch.setattr(storage_queries, "_rewrite_month", lambda raw, *a, **k: rewritten.extend(raw.inputFiles()) or rewrite(raw, *a, **k))
    same(QUERIES["distinct_values_after_rewrite"].run(spark, folder), "distinct_values_after_rewrite", con)
    assert dealt == [True, True, True]
    # The lines of the rewritten month were joined for the first delivery.
    assert rewritten and not any(folder in f for f in rewritten)


def test_a_dealt_line_carries_no_names_of_places(spark, star):
    folder, _ = star
    cur = cur_export(spark, folder, by_month=True)
    plan = cur._jdf.queryExecution().optimizedPlan().toString()
    moved = re.search(r"RebalancePartitions [^\n]*\n[^\n]*Project \[([^\n]*)\]\n", plan)[1]
    assert "c_nationkey" in moved and not re.search("n_name|r_name|l_orderkey|o_custkey", moved), moved
    assert sorted(map(str, cur.collect())) == sorted(map(str, cur_export(spark, folder).collect()))


def test_shuffle_files_go_with_the_delivery(spark, star, tmp_path):
    folder, _ = star

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in files.split("\n") if "/shuffle_" in f}

    before = shuffled()
    cur, month = cur_export(spark, folder, part=False, account=False, tags=False), "bill_billing_period_start_date"
    storage_queries._write_export(cur, month, f"{tmp_path}/export")
    storage_queries._rewrite_month(cur, f"{tmp_path}/export", "1997-01")
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
