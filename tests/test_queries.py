"""Every query runs; those with SQL give the same rows as DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = sorted(n for n in entry.queries() if not (n.startswith("op") or n == "pipeline"))


def norm(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    out = []
    for r in rows:
        out.append(tuple("" if r[i] is None else f"{r[i]:.6g}" if isinstance(r[i], float) else str(r[i]) for i in order))
    return sorted(out), sorted(names)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = norm(df.collect(), df.columns)
    if name in entry.oracle_sql():
        cur = duck.execute(entry.oracle_sql()[name])
        assert got == norm(cur.fetchall(), [d[0] for d in cur.description])
    else:
        assert got[0]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
