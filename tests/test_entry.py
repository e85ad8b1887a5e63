"""The contract with the driver, and the twins on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
CORE, SQL = entry._core()


def rows(df):
    def plain(v):
        if v is None or (isinstance(v, float) and np.isnan(v)):
            return None
        if isinstance(v, (list, np.ndarray)):
            return list(v)
        if isinstance(v, (float, np.floating)):  # pandas widens whole numbers that may be null
            return int(v) if float(v).is_integer() else float(v)
        return int(v) if isinstance(v, (int, np.integer)) and not isinstance(v, bool) else v

    return sorted(repr(tuple(plain(r[k]) for k in sorted(df.columns))) for r in df.to_dict("records"))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(CORE))
def test_twin(spark, duck, name):
    got = CORE[name](spark, SMALL).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_has_what_it_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
