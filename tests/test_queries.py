"""Every registered query of the engine against its SQL, on the smallest tables."""

import math

import pytest

from stepwright.plans import more, queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6))
    return a == b


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    order = lambda rows: sorted(rows, key=lambda r: repr([x if not isinstance(x, float) else round(x, 3) for x in r]))
    left = order(tuple(r[c] for c in columns) for r in got.collect())
    right = order(want.select(*[f'"{c}"' for c in columns]).fetchall())
    assert len(left) == len(right)
    assert all(same(x, y) for p, q in zip(left, right) for x, y in zip(p, q))


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL])
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
