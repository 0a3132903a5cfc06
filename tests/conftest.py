import datetime
import glob
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    def shown(x):
        if x is None or x != x:
            return None
        if isinstance(x, datetime.date):  # dates and timestamps alike
            return datetime.datetime(x.year, x.month, x.day, *((x.hour, x.minute, x.second, x.microsecond) if isinstance(x, datetime.datetime) else ())).isoformat()
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    def compare(df, sql):
        cols = sorted(df.columns)
        ours = sorted((tuple(shown(r[c]) for c in cols) for r in df.collect()), key=str)
        them = duck.sql(sql)
        assert sorted(them.columns) == cols
        order = [them.columns.index(c) for c in cols]
        assert ours == sorted((tuple(shown(r[i]) for i in order) for r in them.fetchall()), key=str)

    return compare
