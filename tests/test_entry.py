"""The driver's functions with and without the llm subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [["quiremill/llm"], ["corpus_pipeline.py"], ["quiremill/llm", "corpus_pipeline.py"]])
def test_works_without_llm(tmp_path, gone):
    """Queries, SQL and the collection of the other tests, in a copy that lacks the folders."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in [*gone, "tests/llm"]:
        at = copy / name
        if at.is_dir():
            shutil.rmtree(at)
        else:
            at.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); assert 'pipeline' not in q; print(len(q))"
    env = os.environ | {"PYTHONPATH": str(copy)}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 100
    done = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stdout
