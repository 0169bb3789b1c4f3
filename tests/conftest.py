import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def normal(frame, columns):
    import pandas as pd

    def cell(v):
        return "~" if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v) else f"{v:.8g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def agree(spark, duck):
    def check(query, sql):
        got, want = query(spark, SF).toPandas(), duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        assert normal(got, columns) == normal(want, columns)

    return check
