import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from corpusmill.deploy import ship, sweep_scratch

    ship(session)
    yield session
    sweep_scratch(session)
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(value):
    """One form of a value from either engine."""
    import datetime
    import math

    import numpy as np
    import pandas as pd

    if isinstance(value, np.ndarray | list | tuple):
        return [plain(v) for v in value]
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool | np.bool_):
        return bool(value)
    if isinstance(value, int | np.integer):
        return int(value)
    if isinstance(value, float | np.floating):
        return int(value) if float(value).is_integer() else float(value)
    if isinstance(value, pd.Timestamp | datetime.date):
        return str(value)[:10]
    return value


def rows_of(frame):
    cols = sorted(frame.columns)
    return sorted(str([plain(v) for v in row]) for row in frame[cols].values.tolist())
