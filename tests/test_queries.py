"""Every query of the engine against its SQL on the smallest tables."""

import duckdb
import pytest

from palimpsest.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name not in ORACLES:
        assert got.num_rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name]).to_arrow_table()
    names = sorted(want.schema.names)
    assert sorted(got.schema.names) == names
    rows = [sorted(map(repr, t.select(names).to_pylist())) for t in (got, want)]
    assert rows[0] == rows[1]
