"""Corpus queries against their SQL twins, on the smallest tables and on odd rows."""

import duckdb
import pytest

from billweave.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations".split()

DOCUMENTS = [
    (1, None, "en", "a", None),
    (2, "", None, None, 0),
    (3, " \n\t ", "en", None, 3),
    (4, "word " * 60, "en", "a", 300),
    (40, "word " * 60, "en", "a", 300),
    (5, " ".join(f"w{i}" for i in range(200)) + "\nline\nline\n \n \nline", "de", "b", 1),
    (6, "a b c " * 20 + " ".join(f"x{i}" for i in range(70)), "en", "a", 1),
    (7, "É  \x0b\x1c # $ % & | < > * ##" + " é" * 60, "fr", "c", 1),
    (8, "the QUICK brown fox, jumps over-the lazy dog again and again. " * 2, "en", "a", 1),
    (9, "alpha beta! " + "one two three four five six seven eight nine ten eleven", "en", "a", 1),
    (10, " ".join(f"y{i % 7000}" for i in range(20_000)), "en", "hot", 1),
]
BENCHMARK = [
    (1, "Alpha, beta"),
    (2, "quick brown fox jumps over the lazy dog again and again the quick"),
    (3, None),
    (4, "..."),
    (10, "one two three four five six seven eight nine ten"),
    (10, "two three four five six seven eight nine ten eleven"),
    (11, "alpha BETA"),
]
PAGES = [
    (1, None),
    (2, "no scheme/net/"),
    (3, "http://a.net"),
    (4, "http://A.NET/x?y#z"),
    (5, "https://example.net/en/1"),
    (6, "https://sub.EXAMPLE.net/en/"),
    (7, "https://notexample.net/en/"),
    (8, "http://example.com/de/a?b=://"),
    (9, "http://example.com/DE/a"),
    (10, "ftp://x.org/fr/"),
    (11, "http://org/fr/1"),
    (12, "http://x.org:80/fr/1"),
    (13, "http://user@x.net/fr"),
    (14, "://net/"),
    (15, "http://"),
    (16, "http://casino.example.com/play/now"),
    (17, "http://help.x.com/cart/checkout"),
    (18, "http://x.com/cart/checkout"),
    (19, "http://x.com/banner/top.GIF?1"),
    (20, "http://x.com/\n/adserver/\n"),
    (21, "http://a.net?x=/"),
    (21, "http://a.net?x=/"),
    (22, "http://ads.example.net/en/1"),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("odd"))
    make = {
        "documents": (DOCUMENTS, "doc_id long, text string, lang string, source string, n_chars long"),
        "benchmark": (BENCHMARK, "item_id long, text string"),
        "pages": ([(i, u, "<p>x") for i, u in PAGES], "page_id long, url string, html string"),
        "labels": ([(4, 1, 0), (5, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int"),
        "conversations": ([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string"),
    }
    for name, (rows, schema) in make.items():
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{base}/{name}.parquet")
    return base


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in records)


def compare(spark, name, base):
    con = duckdb.connect()
    for t in TABLES:
        inside = "/*.parquet" if base != DIR else ""
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{base}/{t}.parquet{inside}')")
    df = QUERIES[name].run(spark, base)
    cursor = con.execute(QUERIES[name].sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.collect(), df.columns) == rows(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_small_tables(spark, name):
    compare(spark, name, DIR)


@pytest.mark.parametrize("name", ["op2_url_filter", "op4_quality_rules", "op7_decontamination", "op11_merkle_manifest", "op12_periodic_runs"])
def test_odd_rows(spark, odd, name):
    compare(spark, name, odd)


def test_benchmark_items_without_an_id(spark, odd, tmp_path):
    for t in TABLES:
        table = spark.read.parquet(f"{odd}/{t}.parquet")
        if t == "benchmark":
            table = table.unionAll(spark.createDataFrame([(None, "W7, w8"), (None, "alpha beta"), (None, "a b c")], table.schema))
        table.write.parquet(f"{tmp_path}/{t}.parquet")
    compare(spark, "op7_decontamination", str(tmp_path))


@pytest.mark.parametrize("name", QUERIES)
def test_odd_and_empty_tables_give_a_row_for_each_row(spark, odd, tmp_path, name):
    for t in TABLES:
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES[name].run(spark, str(tmp_path)).count() == 0
    table = {"op1": "pages", "op2": "pages", "op10": "conversations"}.get(name.split("_")[0], "documents")
    assert QUERIES[name].run(spark, odd).count() == spark.read.parquet(f"{odd}/{table}.parquet").count()


@pytest.mark.parametrize("name", ["op2_url_filter", "op4_quality_rules"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name].run(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
