import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    os.environ["PYTHONPATH"] = f"{Path(__file__).parent.parent}:{os.environ.get('PYTHONPATH', '')}"
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(shared))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def same_as_sql(sf):
    """Compare a frame with what DuckDB makes of SQL over the same tables."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")

    def rows(pdf, columns):
        clean = lambda v: None if v is None or (not isinstance(v, (list, bytes)) and pd.isna(v)) else (int(v) if float(v).is_integer() else round(float(v), 6)) if isinstance(v, float) else v
        return sorted(repr([clean(v) for v in r]) for r in pdf[columns].astype(object).itertuples(index=False))

    def check(df, sql):
        ours, theirs = df.toPandas(), con.execute(sql).df()
        columns = sorted(ours.columns)
        assert columns == sorted(theirs.columns)
        a, b = rows(ours, columns), rows(theirs, columns)
        assert len(a) == len(b)
        assert [x.replace("np.", "") for x in a] == [x.replace("np.", "") for x in b]

    return check
