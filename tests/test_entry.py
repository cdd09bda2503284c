"""The driver's contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in e.queries()))"


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_subpackage(tmp_path):
    for name in ("semnet", "__spark_entry__.py"):
        src, dst = os.path.join(ROOT, name), tmp_path / name
        if os.path.isdir(src):
            shutil.copytree(src, dst, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, dst)
    got = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    assert int(got[0]) > 100 and int(got[1]) > 100 and got[2] == "0"
