"""The driver contract with and without the optional text operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as E

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_oracles_belong_to_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_imports_without_the_text_operators(tmp_path):
    shutil.copytree(os.path.join(ROOT, "flockscope"), tmp_path / "flockscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path, capture_output=True,
                          text=True, check=True, env=os.environ | {"PYTHONPATH": ""})
    names = said.stdout.split()
    assert "daily_keyword_counts" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
