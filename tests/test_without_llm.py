"""The library, its queries and entry points don't need the training-data operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_imports_without_them(tmp_path):
    shutil.copytree(ROOT / "shelfline", tmp_path / "shelfline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; names = e.queries(); assert len(names) > 50 and 'pipeline' not in names and not any(n.startswith('op') for n in names); assert set(e.oracle_sql()) <= set(names)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"} | {k: v for k, v in __import__("os").environ.items() if k not in ("PYTHONPATH",)})


def test_other_tests_run_without_them(tmp_path):
    """All other tests can be collected, and some run, in a copy without the operators, their tests and the pipeline."""
    ignored = shutil.ignore_patterns("llm", "__pycache__", ".git")
    for name in ("shelfline", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=ignored)
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for args in (["--collect-only", "tests"], ["tests/test_functions.py", "tests/test_queries.py::test_entry_points"]):
        subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *args], cwd=tmp_path, check=True, env=env, stdout=subprocess.DEVNULL, timeout=300)


def test_nothing_else_imports_them():
    for path in (ROOT / "shelfline").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "shelfline.llm" not in path.read_text(), path
