import glob
import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parents[1]))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    at = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{at}/checkpoints").config("spark.sql.warehouse.dir", f"{at}/warehouse").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {Path(p).stem} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def rows(df):
    """Rows of a pandas frame with columns in order of their names, comparable between engines."""
    df = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    plain = lambda x: "~" if x is None else round(float(x), 6) if isinstance(x, float) else x
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="session")
def same(spark, sf, duck):
    def check(query, sql):
        got, want = query(spark, sf).toPandas(), duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)

    return check
