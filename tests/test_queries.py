"""Every query of the engine against its SQL, over the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from loomdex.plans import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", list(q.QUERIES))
def test_query(spark, duck, name):
    got = q.QUERIES[name](spark, SF).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name not in q.SQL:
        assert len(got)
        return
    want = duck.sql(q.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def rows(frame):
        return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))

    assert rows(got) == rows(want)
