import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(frame) -> list[str]:
    """Rows as sorted text, the columns by name."""
    columns = sorted(frame.columns)
    out = []
    for row in frame[columns].astype(object).itertuples(index=False):
        out.append("|".join(repr(float(v)) if isinstance(v, float) or type(v).__name__.startswith("float") else repr(int(v)) if type(v).__name__.startswith(("int", "uint")) else repr(v) for v in row))
    return sorted(out)


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(query, sql: str) -> None:
        got, want = query(spark, SF).toPandas(), duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)

    return check
