"""The entry module: its names, and that it works without the llm subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from loomdex.plans import queries as q

REPO = Path(entry.__file__).parent


def test_names():
    assert set(q.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert len(q.SQL) >= 100


def test_without_llm(tmp_path):
    for name in ("loomdex", "__spark_entry__.py"):
        source = REPO / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "loomdex/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in e.queries() if n[2:3].isdigit()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == len(q.QUERIES) and int(out[1]) == len(q.SQL) and out[2] == "False"
    # a folder that is left over but empty changes nothing
    (tmp_path / "loomdex/llm/__pycache__").mkdir(parents=True)
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split() == out


def test_nothing_outside_llm_imports_it():
    for path in (REPO / "loomdex").rglob("*.py"):
        if "llm" not in path.relative_to(REPO / "loomdex").parts:
            assert "loomdex.llm" not in path.read_text(), path
