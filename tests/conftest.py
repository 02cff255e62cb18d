import glob
import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("CAIRN_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    """Holds a query against its SQL over the small tables, as multisets of rows."""

    def check(query, sql):
        df = query(spark, DATA)
        names = sorted(df.columns)
        mine = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
        cursor = duck.execute(sql)
        at = [x[0] for x in cursor.description]
        assert sorted(at) == names
        theirs = Counter(tuple(plain(r[at.index(c)]) for c in names) for r in cursor.fetchall())
        assert mine == theirs

    return check


@pytest.fixture(scope="session")
def docs(spark):
    """Builds documents from (collection, path, title, text[, active]) rows, ids from 1."""
    import hashlib

    def make(rows):
        out = []
        for i, r in enumerate(rows, 1):
            active = r[4] if len(r) > 4 else True
            digest = hashlib.sha256(r[3].encode()).hexdigest() if r[3] is not None else None
            out.append((i, r[0], r[1], r[2], digest, r[3], "2025-01-01T00:00:00Z", "2025-01-01T00:00:00Z", active))
        return spark.createDataFrame(out, "doc_id bigint, collection string, path string, title string, hash string, text string, created_at string, modified_at string, active boolean")

    return make
