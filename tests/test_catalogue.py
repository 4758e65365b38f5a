"""Every query of the catalogue against its SQL in DuckDB, row for row."""

import math

import duckdb
import pytest

from framelake.catalogue import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v + 0.0:.9g}"
    return str(v) if v is not None else None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in ORACLE:
        assert rows
        return
    answer = duck.execute(ORACLE[name])
    names = [x[0] for x in answer.description]
    assert sorted(names) == columns
    expected = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in answer.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in rows) == expected


def test_every_statement_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
