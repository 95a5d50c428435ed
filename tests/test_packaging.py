"""Jobs with Python in tasks must run when executors cannot import the package
(driver started from another folder, no PYTHONPATH for workers)."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
from inkwell.operators import enrich

class Client(enrich.Classifier):
    def classify(self, row, attempt):
        return {{a: v[0] for a, v in enrich.ENUMS.items()}}

docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
out = enrich.classify_rows(docs, ["C", "D"], {{"C": Client()}}, backoff_base=0)
print("ROWS", out.count(), out.where("error is null").count())
"""


def test_classifier_runs_without_package_on_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True,
                         text=True, timeout=600)
    assert "ROWS 400 200" in out.stdout, out.stderr[-2000:]
