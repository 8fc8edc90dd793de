"""Every query of the core against its SQL on the smallest tables, and the driver contract."""

import importlib
import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

CORE = [importlib.import_module(f"tidemark.plans.{m}") for m in ("core_queries", "relational_queries", "analytics_queries")]
SQL = {k: s for m in CORE for k, s in m.SQL.items()}


def plain(v):
    if v is None or v != v and not isinstance(v, float):
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v if isinstance(v, (bool, int)) else str(v)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in os.listdir(small):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{small}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    done = duck.execute(SQL[name])
    names = [c[0] for c in done.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted(repr([plain(r[i]) for i in order]) for r in done.fetchall())


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {f"p{n}_found" for n in (1, 3, 4, 5)} <= set(queries)
    assert entry.entry(spark).schema == entry.entry(spark).schema


def test_the_core_stands_without_the_llm_part():
    code = "import sys; sys.modules['tidemark.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p2_found' not in e.queries(); assert not [m for m in sys.modules if m.startswith('tidemark.llm.')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)), timeout=120)
