"""Every query that has SQL, against DuckDB on the smallest tables; the others run and keep their schema."""

import pytest
from conftest import DATA, compare

from brocade.plans import control, problems, reference

CORE = problems.QUERIES | reference.QUERIES | control.QUERIES
SQL = problems.SQL | reference.SQL | control.SQL
#: Too few listings at this size to learn every unit form from; compared at larger sizes by the driver.
LARGER = {"p2_found", "p2_amounts"}


@pytest.mark.parametrize("name", sorted(SQL.keys() - LARGER))
def test_sql(spark, duck, name):
    compare(spark, duck, CORE[name], SQL[name])


@pytest.mark.parametrize("name", sorted(CORE.keys() - SQL.keys()))
def test_runs(spark, name):
    df = CORE[name](spark, DATA)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()
