"""Every query of the table layer against its SQL in DuckDB."""

import datetime
import math

import duckdb
import pytest

from lamellar.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v) if not isinstance(v, (int, str, type(None))) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    if name not in registry.ORACLES:
        assert got[1]
        return
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = db.execute(registry.ORACLES[name])
    names = [x[0] for x in out.description]
    assert got == rows_of(names, out.fetchall())
