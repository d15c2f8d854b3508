"""The operators' queries that SQL can express against DuckDB."""

import pytest

from graphloom.llm import queries


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_oracle(spark, name, sf):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for table in ("conversations", "pages", "documents"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf{sf}/{table}.parquet'")
    out = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    got = queries.QUERIES[name](spark, f"/root/testdata/sf{sf}").select(*names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(out.fetchall(), key=repr)
