"""Every query of the core against its SQL on the smallest tables."""

import glob
import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from quillspark.plans import registry

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(SF + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in registry.ORACLE_SQL:
        r = con.execute(registry.ORACLE_SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        assert got == Counter(tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall())


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(registry.QUERIES) > 60
    assert entry.entry(spark).limit(5).count() == 5


@pytest.mark.parametrize("name,source", [("parse_tags", "documents"), ("loss_asof_all", "events")])
def test_whole_tables_are_read(spark, name, source):
    assert registry.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{source}.parquet").count()
