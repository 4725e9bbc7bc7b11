"""Every query of the library itself against its SQL text on the smallest tables."""

import decimal
import math

import duckdb
import pytest

import clausewise.program_queries  # noqa: F401 (adds its queries)
from clausewise.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 5) + 0.0
    return v if isinstance(v, (bool, int)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    res = db.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(dict(zip(names, r))[c]) for c in cols) for r in res.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 26
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and len(names) >= len(QUERIES)


def test_oracles_return_rows():
    """A query that returns nothing proves nothing; agg_empty is about just that."""
    db = duckdb.connect()
    for t in TABLES.split():
        db.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    assert [n for n, sql in sorted(ORACLES.items()) if n != "agg_empty" and not db.execute(f"select count(*) from ({sql})").fetchone()[0]] == []


def test_recursion_covers_all_parts(spark, db):
    """The recursive queries reach every part, and same_generation derives pairs by its recursive rule."""
    (edges,) = db.execute("select count(distinct p_partkey) from part where p_partkey % 100 > 0").fetchone()
    assert edges > 40
    assert QUERIES["recursion_closure"](spark, SF).select("x").distinct().count() == edges
    pairs = QUERIES["recursion_same_generation"](spark, SF)
    siblings = "x - x % 100 + (x % 100 - 1) div 3 = y - y % 100 + (y % 100 - 1) div 3"
    assert pairs.filter(f"not ({siblings})").count() > 0
