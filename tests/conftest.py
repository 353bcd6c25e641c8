import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    with tempfile.TemporaryDirectory() as shared:
        session = (
            SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", shared).getOrCreate()
        )
        session.sparkContext.setLogLevel("ERROR")
        yield session
        session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def same_rows(spark, sf_dir, query, sql):
    """Run a query on Spark and its SQL on DuckDB, and compare all rows."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    show = lambda v: "~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(tuple(show(r[n]) for n in names) for r in df.collect())
    answer = con.sql(sql)
    assert sorted(answer.columns) == names
    at = [answer.columns.index(n) for n in names]
    want = sorted(tuple(show(r[i]) for i in at) for r in answer.fetchall())
    assert got == want
    return got


@pytest.fixture(scope="session")
def compare(spark, sf_dir):
    return lambda query, sql: same_rows(spark, sf_dir, query, sql)
