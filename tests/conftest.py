import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    from tellstone.session import local_session

    session = local_session("*", "tests", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    if not DATA.is_dir():
        pytest.skip("no test data")
    return str(DATA)


@pytest.fixture(scope="session")
def duck(folder):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for file in DATA.glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def plain(value):
    """Values that compare across engines: floats to six digits, lists for arrays."""
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    return value


def check_against_sql(spark, folder, duck, query, sql):
    df = query(spark, folder)
    columns = sorted(df.columns)
    got = sorted(str([plain(v) for v in row]) for row in df.select(*columns).collect())
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(str([plain(row[i]) for i in at]) for row in result.fetchall())
