"""Every query with SQL against the checking database, on the smallest tables."""

import os

import duckdb
import pytest

from skyquarry import scan_queries  # noqa: F401  (adds to QUERIES)
from skyquarry.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def norm(rows, names):
    def text(v):
        return "NULL" if v is None else f"{v:.6f}" if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    want = db.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert norm(got, df.columns) == norm(want.fetchall(), names)
