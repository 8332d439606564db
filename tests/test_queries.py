"""Registered queries against DuckDB over the smallest tables, and the driver's contract."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from quiverspark import queries as registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if hasattr(value, "__len__") and not isinstance(value, str):
        return [plain(v) for v in value]
    if value is None or value is pd.NA or value != value:
        return None
    return value.item() if hasattr(value, "item") else value


def comparable(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(str([plain(v) for v in r]) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    if name in registry.oracle_sql():
        names, got = comparable(found.toPandas())
        wanted_names, wanted = comparable(duck.execute(registry.oracle_sql()[name]).df())
        assert names == wanted_names
        assert [g.replace(".0", "") for g in got] == [w.replace(".0", "") for w in wanted]
    else:
        assert found.count() > 0


def test_entry_works_without_the_training_data_operators(tmp_path):
    copy = tmp_path / "repo"
    subprocess.run(["cp", "-r", str(ROOT / "quiverspark"), str(ROOT / "__spark_entry__.py"), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "quiverspark/llm"), str(copy)], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYTHONPATH": str(tmp_path)})
