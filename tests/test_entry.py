"""The driver's contract, with and without the folders that it may delete."""

from __future__ import annotations

import pathlib
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_contract(spark):
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert sql.keys() <= found.keys()
    assert __spark_entry__.entry(spark).count() > 0


def test_rest_stands_alone(tmp_path):
    ignored = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=ignored)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q) and e.oracle_sql().keys() <= q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, timeout=100)
