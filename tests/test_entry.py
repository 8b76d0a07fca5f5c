"""The driver's contract, with and without the optional subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_has_rows(spark):
    if os.path.isdir(__spark_entry__.SMOKE_DIR):
        assert __spark_entry__.entry(spark).count() == 3


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/reasonflow", tmp_path / "reasonflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'metrics_by_variant' in q and 'pipeline' not in q; print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120, check=True)
    assert int(out.stdout) > 50
