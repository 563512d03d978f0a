import duckdb
import pytest

import __spark_entry__
from geowarden.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(ORACLE))
def test_like_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    found = con.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    rows = sorted(repr(tuple(r[c] for c in names)) for r in got.collect())
    assert rows == sorted(map(repr, found.fetchall()))


def test_every_operator_is_registered():
    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(ORACLE) <= set(__spark_entry__.oracle_sql())
