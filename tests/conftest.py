import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(shared))
        .getOrCreate()
    )
    s.sparkContext.setCheckpointDir(str(shared))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB over a folder of the driver's tables, those that are there."""

    def connect(folder: str) -> duckdb.DuckDBPyConnection:
        con = duckdb.connect()
        for t in TABLES:
            p = Path(folder, f"{t}.parquet")
            if p.exists():
                con.execute(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
        return con

    return connect


@pytest.fixture(scope="session")
def same_rows():
    def cell(v):
        if v is None or str(v) in ("NaT", "<NA>", "nan", "NaN"):
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        if isinstance(v, int | float) or type(v).__name__.startswith(("int", "uint", "float", "Decimal")):
            return repr(round(float(v), 6) + 0.0)
        return str(list(v)) if hasattr(v, "tolist") else str(v)

    def check(a, b):
        cols = sorted(a.columns)
        assert cols == sorted(b.columns)
        rows = lambda q: sorted(tuple(cell(v) for v in r) for r in q[cols].itertuples(index=False))
        assert rows(a) == rows(b)

    return check
