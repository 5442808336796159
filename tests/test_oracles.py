"""Every catalogued query against its SQL, and those without SQL for rows and schema."""

import numpy as np
import pytest

from gridloom import catalog
from tests.conftest import SF

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert len(got) == len(want)
    got, want = (df[columns].sort_values(columns, ignore_index=True) for df in (got, want))
    for c in columns:
        a, b = got[c], want[c]
        if a.dtype.kind in "fiu" and b.dtype.kind in "fiu":
            assert np.isclose(a.astype(float), b.astype(float), rtol=1e-9, atol=1e-9, equal_nan=True).all(), c
        elif a.dtype.kind == "f" or b.dtype.kind == "f":
            assert np.isclose(a.astype("float64"), b.astype("float64"), equal_nan=True).all(), c
        else:
            assert ((a == b) | (a.isna() & b.isna())).all(), c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    same(QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).fetch_df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns
    df.toPandas()


def test_flagship_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
