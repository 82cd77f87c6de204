"""The rest works where the corpus subpackage and its tests, and perhaps the pipeline, are deleted."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
CODE = """
import __spark_entry__ as e
from tessella.session import local_session

q, sql = e.queries(), e.oracle_sql()
assert "shade_regions" in q and "shade_regions" in sql
assert not [n for n in [*q, *sql] if n.startswith("op") and n[2].isdigit() or n == "pipeline"]
assert e.entry(local_session(2)).limit(1).count() == 1
print("whole")
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, pipeline):
    there = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(REPO / "tessella", tmp_path / "tessella", ignore=there)
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    if pipeline and (REPO / "corpus_pipeline.py").exists():
        shutil.copy(REPO / "corpus_pipeline.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, timeout=600, env={"PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(tmp_path), "PYTHONPATH": str(tmp_path)})
    assert "whole" in done.stdout, done.stderr[-2000:]
