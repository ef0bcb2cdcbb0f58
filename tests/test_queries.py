"""Registered queries against their SQL twins on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from lexatlas.plans import exchange

registry = exchange.registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canonical(frame: pd.DataFrame) -> list[str]:
    def value(v):
        if v is None or v is pd.NA or v != v:
            return None
        if isinstance(v, bool):
            return v
        return round(float(v), 7) if isinstance(v, (int, float)) else str(v)

    cols = sorted(frame.columns)
    return sorted(str(tuple(map(value, r))) for r in frame[cols].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
