"""Every registered query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from lodestone.plans import catalog, registry  # noqa: F401

DIR = "/root/testdata/sf0.001"


def rows(found):
    return sorted(tuple("\0" if x is None else f"{x:.5f}" if isinstance(x, float) else str(x) for x in r) for r in found)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{DIR}/{f}'")
    df = registry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    expected = con.execute(sql)
    names = [c[0] for c in expected.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows(df.select(*columns).collect()) == rows([[r[i] for i in at] for r in expected.fetchall()])
