"""Every registered query with SQL against DuckDB, on the smallest tables."""

import datetime
from pathlib import Path

import duckdb
import pytest

from orgloom.plans import queries_core, queries_more, queries_store, queries_text
from orgloom.plans.registry import Tables

BOOKS = (queries_core.Q, queries_text.Q, queries_store.Q, queries_more.Q)
NAMES = [(book, name) for book in BOOKS for name in book.sql]


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else str(p) + '/*.parquet'}'")
    return con


@pytest.mark.parametrize(("book", "name"), NAMES, ids=[n for _, n in NAMES])
def test_matches_sql(spark, sf_dir, duck, book, name):
    got = book.plans[name](Tables(spark, sf_dir))
    want = duck.execute(book.sql[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    rows = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in order) for r in want.fetchall())
