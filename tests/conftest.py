from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from siftline.session import drop_written, session

    s = session("local[4]", "tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    drop_written(s)
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


def same(spark_df, duck_df) -> bool:
    """Equal as multisets of rows, numbers to five places."""

    def norm(x):
        x = x[sorted(x.columns)].copy()
        for c in x.columns:
            x[c] = x[c].astype(float).round(5) if x[c].dtype.kind in "fiu" else x[c].astype(str)
        return x.sort_values(list(x.columns)).reset_index(drop=True)

    a, b = norm(spark_df), norm(duck_df)
    return list(a.columns) == list(b.columns) and a.equals(b)


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"create view {f[:-8]} as select * from '{data}/{f}'")
    return c
