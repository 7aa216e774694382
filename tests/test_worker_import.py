"""The contract must work from a caller that is not started in the repository
(Python workers then find the package only because prepare() ships it)."""
import os
import subprocess
import sys
import tempfile

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
import __spark_entry__ as E
print("ROWS", E.queries()["stream_throttled"](spark, {SF!r}).count())
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_pandas_udf_query_from_foreign_cwd():
    cwd = tempfile.mkdtemp(prefix="feedyard-caller-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True,
                         text=True, timeout=600)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
    assert int(out.stdout.split("ROWS")[1].split()[0]) > 0
