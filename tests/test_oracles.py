"""Every registered query against its DuckDB SQL on the smallest test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from catalog.fixtures import TABLES
from catalog.registry import QUERIES
from scripts.check_oracles import compare

NAMES = sorted(set(entry.queries()) & set(QUERIES))


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf_dir, name):
    text, ok = compare(spark, con, sf_dir, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "type", "path", "method", "evidence_chars"] and df.count() > 0
