"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest

from billweave.catalog import QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


#: These read the footers of files they have written from the tables, which no scan shows.
FOOTERS = ("footer_index", "scan_estimate_of_files")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DIR}/{name}.parquet')")
    return con


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sql, name):
    query = QUERIES[name]
    df = query.run(spark, DIR)
    # It reads the given tables, or what it has written from them to the scratch folder.
    read, scratch = df.inputFiles(), spark.conf.get("spark.checkpoint.dir")
    assert (read or name in FOOTERS) and all(DIR in f or scratch in f for f in read)
    got = df.collect()
    if query.sql is None:
        assert got
        return
    cursor = sql.execute(query.sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(got, df.columns) == rows(cursor.fetchall(), columns)
