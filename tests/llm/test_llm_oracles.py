"""The queries of this package that have SQL, against DuckDB."""

from pathlib import Path

import duckdb
import pytest

from orgloom.llm import queries


@pytest.mark.parametrize("name", queries.ORACLES)
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else str(p) + '/*.parquet'}'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(str(r[c]) for c in names) for r in got.collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())
