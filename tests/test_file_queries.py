"""Each query of the sources, on the smallest tables, against its SQL."""

import pytest

from pagewright.file_queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n, f in QUERIES.items() if f.__module__.endswith("file_queries")))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF), con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = lambda data: sorted(data, key=str)
    assert rows(tuple(r) for r in got.select(*columns).collect()) == rows(want.fetchall())
