"""Each registered query of the graph operators against its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from graphloom import queries

SIZES = os.environ.get("QUERY_SF", "0.001").split(",")


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(v, 9) + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("sf", SIZES)
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name, sf):
    folder = f"/root/testdata/sf{sf}"
    df = queries.QUERIES[name](spark, folder)
    got = rows(df.columns, df.collect())
    if name not in queries.ORACLE_SQL:
        assert got
        return
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    out = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, out.fetchall())
    assert len(got) == len(want)
    assert got == want
