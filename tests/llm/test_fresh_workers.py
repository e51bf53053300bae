"""A step's Python worker may be a new one that no earlier step has used, as on an executor that joins late."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

RUN = """
import sys
from pyspark.sql import SparkSession
from tidewatch.llm.queries import QUERIES

spark = SparkSession.builder.master("local[4]").config("spark.python.worker.reuse", "false").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
got = QUERIES[sys.argv[1]](spark, "/root/testdata/sf0.001")
assert len(got.collect()) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
"""


@pytest.mark.parametrize("name", ["op10_suffix_dedup", "op11_token_alignment"])
def test_no_step_needs_what_another_has_imported(name):
    repo = str(Path(__file__).parents[2])
    done = subprocess.run([sys.executable, "-c", RUN, name], capture_output=True, text=True, timeout=600, cwd=repo, env={**os.environ, "PYTHONPATH": repo})
    assert done.returncode == 0, done.stderr[-2000:]
