"""One session for all tests, and a small copy of the given tables."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def small(tmp_path_factory):
    """The tables with 110 documents, 60 pages and 120 vectors."""
    import duckdb

    folder = tmp_path_factory.mktemp("small")
    for name in TABLES:
        least = {"documents": "doc_id < 110", "pages": "page_id < 60", "embeddings": "vec_id < 120"}.get(name, "TRUE")
        duckdb.sql(f"COPY (SELECT * FROM '{DATA}/{name}.parquet' WHERE {least}) TO '{folder}/{name}.parquet'")
    return str(folder)


@pytest.fixture(scope="session")
def sql(small):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def rows_of(frame):
    """Rows of a pandas frame as sorted text tuples, columns by name."""
    frame = frame[sorted(frame.columns)]
    show = lambda v: "null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in frame.astype(object).itertuples(index=False, name=None))
