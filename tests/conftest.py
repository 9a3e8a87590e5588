import os
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (str(ROOT), os.environ.get("PYTHONPATH")) if x)

import duckdb
import pandas as pd
import pytest
from shared import SMALL
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def plain(frame):
    """Rows as sorted tuples of text, columns by name; whole numbers look alike whatever their type."""
    frame = frame[sorted(frame.columns)]

    def show(x):
        if pd.api.types.is_scalar(x) and pd.isna(x):
            return None
        if isinstance(x, float):
            return str(int(x)) if x == int(x) else repr(round(x, 9))
        return str(x)

    return sorted((tuple(show(x) for x in row) for row in frame.astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(query, sql):
        a, b = query(spark, SMALL).toPandas(), duck.execute(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        assert plain(a) == plain(b)

    return check
