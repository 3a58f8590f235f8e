import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    scratch = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{scratch}/shared").config("spark.local.dir", scratch).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def oracle():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")

    def rows(sql, columns):
        r = con.execute(sql)
        names = [d[0] for d in r.description]
        assert sorted(names) == sorted(columns)
        return sorted((tuple(plain(x[names.index(c)]) for c in sorted(columns)) for x in r.fetchall()), key=str)

    return rows


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v if v is None or isinstance(v, (int, bool, str)) else str(v)
