"""Queries of this folder with an SQL twin give the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from lotwise.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["op2_ngram_jaccard_join", "op11_minhash_near_dedup", "op13_ranked_lexical_search"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = Q.queries()[name](spark, SF)
    columns = sorted(df.columns)
    answer = con.execute(f"select {', '.join(columns)} from ({Q.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(answer) and answer
