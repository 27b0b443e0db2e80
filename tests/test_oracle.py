"""Each query against its SQL, as multisets of rows, on two numbers of shuffle partitions."""

import duckdb
import pytest

from tidewater.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(x):
    return repr(round(x, 9)) if isinstance(x, float) else str(x)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cur = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(map(shown, r)) for r in cur.fetchall())
    assert sorted(tuple(shown(r[n]) for n in names) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["q2_max_per_bank", "q3_below_avg_fraction", "q4_scatter_gather_accounts", "q5_count_converted"])
def test_any_number_of_partitions(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, registry.QUERIES[name](spark, "/root/testdata/sf0.01").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


@pytest.mark.parametrize(("name", "rows"), [("q1_low_amount", 3793), ("q2_max_per_bank", 25), ("q3_below_avg_fraction", 10), ("q4_scatter_gather_accounts", 88)])
def test_known_sizes(spark, name, rows):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.01").count() == rows


def test_q5_known_value(spark):
    assert registry.QUERIES["q5_count_converted"](spark, "/root/testdata/sf0.01").first()["size"] == 13
