"""Every registered query of the claim graph against its SQL in DuckDB, and the shape of the driver's contract."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from attestry import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def normal(rows):
    return sorted(str(tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_its_sql(spark, con, name):
    df = Q.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    cur = con.execute(Q.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = normal(tuple(dict(zip(names, r, strict=True))[c] for c in cols) for r in cur.fetchall())
    assert normal(tuple(r[c] for c in cols) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["walk_visits", "claims_tally", "content_chunks"])
def test_results_do_not_depend_on_partitions(spark, name):
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(normal(Q.QUERIES[name](spark, DATA).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


def test_contract(spark):
    assert {*entry.oracle_sql()} <= {*entry.queries()}
    assert entry.entry(spark).count() > 0
