"""The queries on workers that cannot import the package: only the driver's path has it."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from tidemark.session import local_session
from tidemark.llm import queries

spark = local_session(2, shuffle_partitions=2)
def absent(batches):
    import importlib.util
    for pdf in batches:
        yield pdf.assign(id=int(importlib.util.find_spec("tidemark") is not None))
assert spark.range(1).mapInPandas(absent, "id long").first()[0] == 0
for name, query in queries.QUERIES.items():
    query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("done", name)
"""


def test_queries_run_without_the_package_on_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, timeout=900,
                         capture_output=True, text=True)
    assert ran.returncode == 0, ran.stderr[-3000:]
    assert ran.stdout.count("done") == 13
