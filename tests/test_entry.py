"""The registered queries against DuckDB on the smallest tables."""

import math

import duckdb
import numpy as np
import pytest

from chronoseg.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return [plain(x) for x in v]
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v


def as_set(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_agrees_with_sql(spark, duck, name):
    f, sql = QUERIES[name]
    got = f(spark, DATA)
    want = duck.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert as_set(got.columns, got.collect()) == as_set(names, want.fetchall())


def test_every_query_has_sql():
    assert all(sql for _, sql in QUERIES.values())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 156
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_what_the_optional_queries_need():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(QUERIES)), "False"]
