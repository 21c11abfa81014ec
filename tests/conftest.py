import datetime
import decimal
import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    return str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def duck(tiny):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return repr(round(float(x), 6))
    if isinstance(x, list):
        return str([plain(v) for v in x])
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


@pytest.fixture(scope="session")
def same(spark, duck, tiny):
    """Asserts that a query and its SQL give the same rows, whatever their order."""

    def check(query, sql):
        df = query(spark, tiny)
        names = sorted(df.columns)
        got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
        cursor = duck.execute(sql)
        found = [d[0] for d in cursor.description]
        assert sorted(found) == names
        want = sorted(tuple(plain(r[found.index(c)]) for c in names) for r in cursor.fetchall())
        assert got == want

    return check
