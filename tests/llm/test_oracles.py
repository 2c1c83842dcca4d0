"""The queries that have SQL against DuckDB."""

import duckdb
import pytest

from lamellar.llm import queries
from tests.test_queries import TABLES, rows_of


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    out = db.execute(queries.ORACLES[name])
    names = [x[0] for x in out.description]
    assert got == rows_of(names, out.fetchall())
