from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def canon(value):
    import datetime
    import decimal

    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value) + 0.0:.6g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(x) for x in value) + "]"
    return value.isoformat() if isinstance(value, datetime.datetime) else str(value)


@pytest.fixture(scope="session")
def same(duck):
    """Asserts that a DataFrame and a SQL text have equal rows, in any order."""

    def check(df, sql):
        columns = sorted(df.columns)
        own = sorted(tuple(canon(row[c]) for c in columns) for row in df.collect())
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        rows = sorted(tuple(canon(row[names.index(c)]) for c in columns) for row in result.fetchall())
        assert own == rows

    return check
