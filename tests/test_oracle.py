"""Every query with SQL against DuckDB on the smallest tables, and every other one for running at all."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from inkfold.plans import registry
from inkfold.sources.session import ship

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in v.items())
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


def compare(df, sql, folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    rows, want = df.collect(), con.sql(sql)
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert Counter(str([norm(r[c]) for c in cols]) for r in rows) == Counter(str([norm(r[i]) for i in at]) for r in want.fetchall())
    return rows


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](ship(spark), DIR)
    assert compare(df, registry.ORACLE_SQL[name], DIR) if name in registry.ORACLE_SQL else df.collect()
