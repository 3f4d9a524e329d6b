"""Every registered query of the retrieval engine against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from lexloom.plans import catalog
from lexloom.sources import tables

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in tables.NAMES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def plain(rows):
    """Rows in any order, with their types: a decimal is no double; doubles to nine digits, as sums have no fixed order."""

    def fix(x):
        if isinstance(x, float):
            return float(f"{x:.9g}")
        if hasattr(x, "asDict"):
            return fix(x.asDict())
        if isinstance(x, dict):
            return tuple((k, fix(v)) for k, v in sorted(x.items()))
        return tuple(map(fix, x)) if isinstance(x, (list, tuple)) else x

    return sorted(repr(tuple(map(fix, r))) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    if name in catalog.oracle_sql():
        want = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
        assert got == plain(want)
