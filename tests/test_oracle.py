"""Every query with an SQL twin gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from lotwise.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: x.isoformat() if hasattr(x, "isoformat") else round(float(x), 6) if isinstance(x, float) else x
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=str), sorted(columns)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_as_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    answer = duck.execute(Q.SQL[name])
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(answer.fetchall(), [d[0] for d in answer.description])
