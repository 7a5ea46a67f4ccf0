import os
import sys
from pathlib import Path

import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    session = local_session("8", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def same_rows(spark_df, other) -> bool:
    """Rows and columns are equal, whatever their order; floats to nine digits."""

    def plain(df):
        df = df[sorted(df.columns)]
        # A column of whole numbers with nulls is one of floats in pandas.
        text = lambda v: "NULL" if v is None or pd.isna(v) else str(int(v)) if isinstance(v, float) and v.is_integer() else f"{v:.9g}" if isinstance(v, float) else str(v)
        return sorted(tuple(text(v) for v in row) for row in df.itertuples(index=False))

    mine = spark_df.toPandas()
    return sorted(mine.columns) == sorted(other.columns) and plain(mine) == plain(other)


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p / '*.parquet' if p.is_dir() else p}')")
    return con
