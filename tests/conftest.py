import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


def oracle_rows(sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def plain(v):
    """A value in a form that both engines share."""
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        v = float(v)
        return "nan" if v != v else f"{v:.9g}" if v else "0"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    return f"{float(v):.9g}" if isinstance(v, int) and abs(v) < 1 << 50 else str(v)


def same_rows(df, sql, sf_dir):
    """Spark's rows and DuckDB's, columns by name, in one order."""
    columns, expected = oracle_rows(sql, sf_dir)
    assert sorted(columns) == sorted(df.columns)
    names = sorted(columns)
    left = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    right = sorted(tuple(plain(r[columns.index(n)]) for n in names) for r in expected)
    assert left == right


def rows(df):
    return [tuple(r) for r in df.collect()]
