"""Every registered query against its SQL on the smallest tables, compared as sets of rows."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry_module

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    cur = duck.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=key)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_every_sql_has_a_query_and_entry_has_rows(spark):
    assert set(SQL) <= set(QUERIES)
    assert entry_module.entry(spark).count() > 0


def test_the_rest_stands_without_the_llm_package():
    import pathlib
    import re

    root = pathlib.Path(entry_module.__file__).parent / "lastro"
    outside = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert not [p for p in outside if re.search(r"\b(from|import)\s+lastro\.llm", p.read_text())]
