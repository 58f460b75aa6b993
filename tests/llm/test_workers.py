"""Executors need the libraries that an operator names, not this package."""

import os
import subprocess
import sys

from tests.conftest import ROOT

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from bathyspark.session import local_session
import __spark_entry__ as E
spark = local_session(cores=2, shuffle_partitions=2)
assert spark.range(1).mapInPandas(lambda b: (p.assign(id=len(sys.modules.keys() & {{"bathyspark"}})) for p in b), "id long").first()[0] == 0
for name in ("op1_decontamination", "op4_language_id", "op8_quality", "op11_hard_negatives", "op12_spelling", "op13_line_dedup"):
    print(name, E.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_queries_run_where_workers_lack_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.count("op") == 6
