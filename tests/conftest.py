import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test data")
    return SMALL


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(small):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return c


def same_rows(df, c, sql):
    """Rows and columns of a DataFrame and of SQL, whatever their order."""
    a, b = df.toPandas(), c.sql(sql).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    # Nullable whole numbers look alike on both sides.
    x, y = (t[cols].convert_dtypes().astype(str).sort_values(cols).reset_index(drop=True) for t in (a, b))
    assert x.equals(y), (x[(x != y).any(axis=1)].head() if len(x) == len(y) else (len(x), len(y)))
