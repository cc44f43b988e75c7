"""The training-data subpackage can be taken out."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 50; print(sorted(n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline'))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_subpackage(tmp_path, pipeline):
    """With the folders deleted, and corpus_pipeline.py left or deleted as well, the entry
    points work, and the other tests are found."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *([] if pipeline else ["corpus_pipeline.py"])))
    run = lambda *args: subprocess.run([sys.executable, "-B", *args], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    listed = run("-c", LIST)
    assert listed.returncode == 0 and listed.stdout.strip().endswith("[]"), listed.stderr
    found = run("-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider")
    assert found.returncode == 0 and "test_engine.py" in found.stdout, found.stdout + found.stderr


def test_other_import_errors_are_not_hidden(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    if not (copy / "corpusloom" / "llm").is_dir():
        pytest.skip("taken out here")
    with open(copy / "corpus_pipeline.py", "a") as f:
        f.write("\nimport no_such_module\n")
    got = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=copy, capture_output=True, text=True)
    assert got.returncode != 0 and "no_such_module" in got.stderr
