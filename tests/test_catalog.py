"""Every query against its SQL on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quern.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as from '{p}'")
    return c


def plain(row, names):
    x = {n: (round(v, 6) if isinstance(v, float) and math.isfinite(v) else v) for n, v in zip(names, row, strict=True)}
    return tuple((k, str(v)) for k, v in sorted(x.items()))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    rows = sorted(plain(r, df.columns) for r in df.collect())
    if name not in catalog.oracle_sql():
        assert rows
        return
    got = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(plain(r, names) for r in got.fetchall())
    assert rows == want


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() > 0
