import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from brocade.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def same(value):
    """A value as both engines would print it."""
    from decimal import Decimal

    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, Decimal)):
        return f"{float(value):.9g}"
    if getattr(value, "tzinfo", None) is not None:
        value = value.replace(tzinfo=None)
    return str(value)


def compare(spark, duck, query, sql):
    """Row multisets of a query and its SQL on the smallest tables."""
    from collections import Counter

    df = query(spark, DATA)
    rel = duck.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    left = Counter(tuple(same(r[n]) for n in names) for r in df.collect())
    at = [rel.columns.index(n) for n in names]
    right = Counter(tuple(same(r[i]) for i in at) for r in rel.fetchall())
    assert left == right
