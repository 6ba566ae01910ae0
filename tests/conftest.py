import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for path in Path(DATA).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.fixture(scope="session")
def make(spark):
    """A table from tuples."""
    return lambda rows, ddl: spark.createDataFrame(rows, ddl)


def plain(value):
    """A value in the form in which both engines give it."""
    if value is None or value != value:
        return "NULL"
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(round(float(value), 9) + 0.0)
    return repr(value)


def same_rows(query, sql, spark, duck):
    found = query(spark, DATA)
    names = sorted(found.columns)
    wanted = duck.execute(sql)
    assert names == sorted(d[0] for d in wanted.description)
    order = [[d[0] for d in wanted.description].index(n) for n in names]
    right = sorted(tuple(plain(r[i]) for i in order) for r in wanted.fetchall())
    left = sorted(tuple(plain(r[n]) for n in names) for r in found.collect())
    assert left == right
