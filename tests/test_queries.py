"""Every query of the name-confusion operators against DuckDB, or for its rows where SQL can't tell."""

import math
import os

import duckdb
import pytest

from namewarden.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return str(v) if hasattr(v, "year") else v


def rows(frame, columns):
    return sorted(str([plain(v) for v in r]) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        assert len(found.columns) > 0
        return
    wanted = duck.sql(ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found, sorted(found.columns)) == rows(wanted, sorted(found.columns))
