import glob
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return db


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def same(found, wanted) -> None:
    """Two pandas frames hold the same rows, in any order."""
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    one, two = (sorted(map(repr, frame[columns].itertuples(index=False))) for frame in (found, wanted))
    assert one == two


@pytest.fixture(scope="session")
def equal():
    return same
