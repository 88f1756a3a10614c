import os
import subprocess
import sys

from tests.conftest import ROOT


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 8
    assert set(e.oracle_sql()) <= set(e.queries())


def test_queries_start_from_any_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()
import __spark_entry__ as e
print('ROWS', e.queries()['column_gcd'](s, '/root/testdata/sf0.001').count())
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable})
    assert "ROWS 3" in out.stdout, out.stderr[-2000:]
