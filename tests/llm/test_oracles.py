"""The SQL of operators 11 to 13 gives the rows of their queries."""

import os

import pytest

from seriesmith.llm import registry

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are not here")
@pytest.mark.parametrize("name, table", [("op11_conversations", "conversations"), ("op12_suffix_dedup", "documents"), ("op13_hard_negatives", "embeddings")])
def test_sql_agrees(spark, name, table):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    got = registry.QUERIES[name](spark, SF_DIR)
    want = con.execute(registry.ORACLES[name])
    columns = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(want.fetchall())
