"""Every query with SQL against DuckDB, over whole tables."""

import math

import duckdb
import pytest

from tallyloom import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in got), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, duck, name):
    made = catalogue.QUERIES[name](spark, SF)
    told = duck.sql(catalogue.ORACLES[name])
    assert sorted(made.columns) == sorted(told.columns)
    ours = rows(made.columns, [tuple(r) for r in made.collect()])
    assert ours == rows(told.columns, told.fetchall())
    assert ours


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
