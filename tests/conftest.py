from __future__ import annotations

import glob
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf() -> str:
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    """A value as both engines can give it."""
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, (int, float)) or type(v).__module__ == "numpy" or type(v).__name__ == "Decimal":
        return round(float(v), 6) + 0.0
    return str(v)


@pytest.fixture(scope="session")
def same(spark, sf, duck):
    """Asserts that a query and its SQL give the same columns and rows."""

    def check(query, statement: str) -> None:
        got = query(spark, sf)
        want = duck.execute(statement)
        names = [d[0] for d in want.description]
        assert sorted(got.columns) == sorted(names)
        order = sorted(names)
        mine = sorted(repr([plain(r[c]) for c in order]) for r in got.collect())
        theirs = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in want.fetchall())
        assert mine == theirs

    return check
