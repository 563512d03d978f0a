import os

import duckdb
import pytest

from geowarden.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_like_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    rows = sorted(map(repr, (tuple(r[c] for c in sorted(got.columns)) for r in got.collect())))
    if name not in ORACLE:
        assert rows
        return
    found = db.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    at = [names.index(c) for c in sorted(names)]
    assert rows == sorted(repr(tuple(r[k] for k in at)) for r in found.fetchall())
    if os.environ.get("SHOW_ROWS"):
        print(name, len(rows))
