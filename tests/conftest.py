"""One local session for all tests."""

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.01"


@pytest.fixture(scope="session")
def sql():
    """sql(folder, query): rows of a query in DuckDB as dictionaries."""
    import duckdb

    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

    def run(folder: str, query: str) -> list[dict]:
        con = duckdb.connect()
        for name in names:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
        found = con.execute(query)
        columns = [c[0] for c in found.description]
        return [dict(zip(columns, row, strict=True)) for row in found.fetchall()]

    return run


@pytest.fixture(scope="session")
def same_rows():
    """same_rows(df, rows): the DataFrame has these rows (dictionaries), in any order."""

    def check(df, rows: list[dict]) -> None:
        columns = sorted(df.columns)
        shown = lambda values: tuple(repr(v) for v in values)
        got = sorted(shown(r) for r in df.select(*columns).collect())
        assert not rows or sorted(rows[0]) == columns
        assert got == sorted(shown(r[c] for c in columns) for r in rows)

    return check
