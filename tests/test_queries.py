"""Every query against its SQL twin, on the smallest tables; those without one must give rows."""

import os

import duckdb
import pytest

from parlance.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.select(*sorted(got.columns)).collect()]
    if name not in ORACLES:
        assert rows
        return
    rel = con.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    want = [tuple(r[names.index(c)] for c in sorted(names)) for r in rel.fetchall()]
    assert sorted(got.columns) == sorted(names)
    assert sorted(rows, key=repr) == sorted(want, key=repr)
