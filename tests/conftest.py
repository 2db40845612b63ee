import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.executorEnv.PYTHONPATH", str(ROOT))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.addPyFile(_zipped())
    yield session


def _zipped() -> str:
    import tempfile
    import zipfile

    path = Path(tempfile.mkdtemp()) / "tested_package.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted((ROOT / "sparkloom").rglob("*.py")):
            out.write(file, file.relative_to(ROOT))
    return str(path)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, list):
        return tuple(map(plain, value))
    return 0.0 if value == 0 and isinstance(value, float) else value


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    got = con.execute(sql)
    have = [d[0] for d in got.description]
    names = sorted(have)
    return names, sorted((tuple(plain(r[have.index(n)]) for n in names) for r in got.fetchall()), key=repr)
