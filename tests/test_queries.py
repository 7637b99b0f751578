"""The registered queries run on the smallest tables and equal their SQL."""

from pathlib import Path

import pytest

import __spark_entry__
from seqengine.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr(tuple(round(v, 4) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert plain(want) == plain(got.select(columns).collect())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_rows(spark, name):
    """All values are computed: a count alone would prune the columns, and with them the kernels."""
    rows = QUERIES[name](spark, FOLDER).collect()
    assert rows and all(v is not None for r in rows for v in r)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["lang", "token_id", "token"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
