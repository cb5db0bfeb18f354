"""Every registered query of the engine against its SQL on DuckDB, as the driver compares them."""

import math

import duckdb
import pytest

from lumenframe.plans import suite

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        return (2, "nan") if isinstance(v, float) and math.isnan(v) else (2, f"{float(v):.9g}")
    return (3, str(v))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_query(spark, duck, name):
    got = suite.QUERIES[name](spark, SF)
    if name not in suite.ORACLES:
        assert got.count() > 0
        return
    want = duck.sql(suite.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    a = sorted(tuple(norm(r[c]) for c in names) for r in got.collect())
    at = [want.columns.index(c) for c in names]
    b = sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())
    assert len(a) == len(b)
    bad = [(x, y) for x, y in zip(a, b) if x != y and not all(p == q or (p[0] == q[0] == 2 and math.isclose(float(p[1]), float(q[1]), rel_tol=1e-6, abs_tol=1e-9)) for p, q in zip(x, y))]
    assert not bad, bad[:3]
