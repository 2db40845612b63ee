"""Registered queries against their SQL, and that the rest runs without the optional text operators."""

import shutil
import subprocess
import sys

import pytest
from conftest import ROOT, SF, rows_of, rows_of_sql

from sparkloom.plans import catalogue

ORACLES = [n for n in sorted(catalogue.ORACLE_SQL) if not n.startswith("measure_") or n == "measure_all_axes"]


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_sql(spark, duck, name):
    assert rows_of(catalogue.QUERIES[name](spark, SF)) == rows_of_sql(duck, catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["em_fit", "shared_origins", "streamed_daily_counts", "calibrate_temporal", "fused_report"])
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_text_operators(tmp_path):
    """With the folders of the text operators and the pipeline gone, the rest imports."""
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "sparkloom", tmp_path / "sparkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_entry_without_a_library_of_the_text_operators():
    code = (
        "import sys; sys.modules['xxhash'] = None\n"
        "import __spark_entry__ as e; assert e.queries() and 'pipeline' not in e.queries()"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
