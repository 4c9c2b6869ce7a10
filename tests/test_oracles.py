"""Every query against its SQL equivalent on the small tables."""

import os

import pandas as pd
import pytest

from loamline import registry

DATA = os.environ.get("LOAMLINE_DATA", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    rows = df.astype(object).where(df.notna(), None).values.tolist()
    text = lambda v: f"{v:.6f}" if isinstance(v, float) else str(pd.Timestamp(v)) if hasattr(v, "year") else str(v)
    return sorted(tuple(text(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    want = duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    assert plain(got) == plain(want)
