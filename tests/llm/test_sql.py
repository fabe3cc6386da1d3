"""Queries that SQL can say as well, against DuckDB on whole tables."""

import duckdb
import pytest

from attestry.llm import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = Q.queries()[name](spark, DATA)
    cur = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    cols = sorted(names)
    assert cols == sorted(df.columns)
    want = sorted(str(tuple(dict(zip(names, r, strict=True))[c] for c in cols)) for r in cur.fetchall())
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == want
